"""The schema compiler on values that are right and wrong in each keyword."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.json_schema import first_error, schema_of

CASES = [
    ({"type": "string"}, ['"a"', "5", "null", "[]"], [None, "$: not of type string", "$: not of type string", "$: not of type string"]),
    ({"type": "integer"}, ["5", "5.0", "5.5", '"5"', "true"], [None, None] + ["$: not of type integer"] * 3),
    ({"type": ["number", "null"]}, ["5", "5.5", "1e3", "null", "true", "12345678901234567890"], [None] * 4 + ["$: not of type number or null", None]),
    ({"type": "boolean"}, ["true", "false", "0"], [None, None, "$: not of type boolean"]),
    ({"enum": ["a", 1, None]}, ['"a"', "1", "null", '"b"'], [None, None, None, "$: not in enum"]),
    ({"const": {"a": 1}}, ['{"a":1}', "{}"], [None, "$: not in const"]),
    ({"minLength": 2, "maxLength": 3}, ['"ab"', '"éé"', '"a"', '"abcd"', "5"], [None, None, "$: too short", "$: too long", None]),
    ({"pattern": "^POL-"}, ['"POL-1"', '"x"', "7"], [None, "$: does not match", None]),
    ({"minimum": 2, "maximum": 5}, ["2", "5.0", "1.9", "6", '"x"'], [None, None, "$: too small", "$: too large", None]),
    ({"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": 2}, ['["a"]', "[]", '["a","b","c"]', '["a",5]', "{}"], [None, "$: too few items", "$: too many items", "$[1]: not of type string", "$: not of type array"]),
    ({"required": ["a", "b"]}, ['{"a":1,"b":null}', '{"a":1}', "{}", "[]"], [None, "$: b is missing", "$: a is missing", None]),
    ({"properties": {"a": {"type": "string"}}, "additionalProperties": False}, ['{"a":"x"}', "{}", '{"a":5}', '{"z":1,"b":2,"a":"x"}'], [None, None, "$.a: not of type string", "$: b is unknown"]),
    ({"additionalProperties": {"type": "integer"}}, ['{"a":1}', '{"b":1,"a":"x"}'], [None, "$.a: not of type integer"]),
    ({"type": "object", "properties": {"x": {"type": "object", "required": ["y"], "properties": {"y": {"items": {"properties": {"z": {"minimum": 0}}}}}}}},
     ['{"x":{"y":[{"z":1},{"z":-1}]}}', '{"x":{}}', '{"x":5}', '{}'], ["$.x.y[1].z: too small", "$.x: y is missing", "$.x: not of type object", None]),
    (True, ["5"], [None]), (False, ["5"], ["$: not allowed"]), ({"format": "date-time"}, ["5"], [None]),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_keywords(spark, n):
    schema, texts, want = CASES[n]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.e for r in df.select("i", first_error(schema, F.col("t")).alias("e")).orderBy("i").collect()] == want


def test_what_is_not_json(spark):
    df = spark.createDataFrame([(None,), ("",), ("{",), ("{}",)], "t string")
    assert [r.e for r in df.select(first_error({}, F.col("t")).alias("e")).collect()] == ["$: not JSON"] * 3 + [None]


def test_unknown_types_and_quotes_are_errors():
    with pytest.raises(ValueError):
        first_error({"type": "text"}, F.col("t"))
    with pytest.raises(ValueError):
        first_error({"required": ["it's"]}, F.col("t"))


def test_a_frame_fits_its_own_schema(spark, sf):
    for name in ("events", "documents", "embeddings", "orders"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        schema = schema_of(df.schema, False)
        assert json.loads(json.dumps(schema))["type"] == "object"
        rows = df.select(F.to_json(F.struct(*df.columns)).alias("t"))
        assert rows.where(first_error(schema, F.col("t")).isNotNull()).count() == 0
        other = schema | {"properties": schema["properties"] | {df.columns[0]: {"type": "boolean"}}}
        assert rows.where(first_error(other, F.col("t")) != f"$.{df.columns[0]}: not of type boolean").count() == 0

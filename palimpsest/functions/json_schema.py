"""JSON Schema as column expressions over VARIANT: the first error of a value as text.

A schema is compiled once, when the plan is made; rows are checked in the JVM. Known keywords: type (a name or several), enum, const,
minLength, maxLength, pattern, minimum, maximum, minItems, maxItems, items, required, properties, additionalProperties (true, false or a
schema). Others, such as format and description, state nothing. A keyword for values of another type says nothing about a value.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is(kind: Column, value: Column, name: str) -> Column:
    number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    match name:
        case "string":
            return kind == "STRING"
        case "boolean":
            return kind == "BOOLEAN"
        case "null":
            return kind == "VOID"
        case "object":
            return kind.startswith("OBJECT")
        case "array":
            return kind.startswith("ARRAY")
        case "number":
            return number
        case "integer":
            return number & (F.try_variant_get(value, "$", "double") == F.floor(F.try_variant_get(value, "$", "double")))
    raise ValueError(f"unknown type: {name}")


def _errors(schema: dict | bool, value: Column, path: Column) -> Column:
    """The first error of value, a VARIANT that is there, or null."""
    if isinstance(schema, bool):
        return F.lit(None).cast("string") if schema else F.concat(path, F.lit(": not allowed"))
    kind = F.schema_of_variant(value)
    said = lambda text: F.concat(path, F.lit(f": {text}"))
    out: list[Column] = []
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        right = _is(kind, value, names[0])
        for name in names[1:]:
            right = right | _is(kind, value, name)
        out.append(F.when(~right, said(f"not of type {' or '.join(names)}")))
    for word, allowed in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if allowed is not None:
            texts = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in allowed]
            out.append(F.when(~F.to_json(value).isin(texts), said(f"not in {word}")))
    text, number = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")), F.when(_is(kind, value, "number"), F.try_variant_get(value, "$", "double"))
    limits = [("minLength", F.length(text), -1, "too short"), ("maxLength", F.length(text), 1, "too long"), ("minimum", number, -1, "too small"), ("maximum", number, 1, "too large")]
    if {"items", "minItems", "maxItems"} & schema.keys():
        items = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
        limits += [("minItems", F.size(items), -1, "too few items"), ("maxItems", F.size(items), 1, "too many items")]
    for word, found, sign, error in limits:
        if word in schema:
            over = found < F.lit(schema[word]) if sign < 0 else found > F.lit(schema[word])
            out.append(F.when(found.isNotNull() & over & (found >= 0 if "Items" in word else F.lit(True)), said(error)))
    if "pattern" in schema:
        out.append(F.when(~text.rlike(schema["pattern"]), said("does not match")))
    fields, here = schema.get("properties", {}), kind.startswith("OBJECT")
    field = lambda name: F.try_variant_get(value, f"$['{name}']", "variant")
    for name in [*schema.get("required", []), *fields]:
        if "'" in name:
            raise ValueError(f"a name with a quote: {name}")
    for name in schema.get("required", []):
        out.append(F.when(here & field(name).isNull(), said(f"{name} is missing")))
    rest = schema.get("additionalProperties", True)
    if rest is not True:
        entries = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, _: ~k.isin(list(fields)) if fields else F.lit(True))
        if rest is False:
            out.append(F.when(here & (F.size(entries) > 0), F.concat(path, F.lit(": "), F.array_min(F.map_keys(entries)), F.lit(" is unknown"))))
        else:
            found = F.transform(F.array_sort(F.map_keys(entries)), lambda k: _errors(rest, F.element_at(entries, k), F.concat(path, F.lit("."), k)))
            out.append(F.when(here, F.get(F.array_compact(found), F.lit(0))))
    for name, part in fields.items():
        out.append(F.when(here & field(name).isNotNull(), _errors(part, field(name), F.concat(path, F.lit(f".{name}")))))
    if "items" in schema:
        found = F.transform(items, lambda x, i: _errors(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        out.append(F.get(F.array_compact(found), F.lit(0)))
    return F.coalesce(*out) if out else F.lit(None).cast("string")


def first_error(schema: dict | bool, text: Column) -> Column:
    """What is wrong with a JSON text by the schema, as `path: error`; null where it is valid. Null and what isn't JSON are `$: not JSON`."""
    value = F.try_parse_json(text)
    return F.when(value.isNull(), "$: not JSON").otherwise(_errors(schema, value, F.lit("$")))


def schema_of(kind, nullable: bool = True) -> dict:  # noqa: ANN001
    """The JSON Schema of values of a Spark type as `to_json` writes them."""
    from pyspark.sql import types as T

    match kind:
        case T.StructType():
            out = {"type": "object", "properties": {f.name: schema_of(f.dataType, f.nullable) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable], "additionalProperties": False}
        case T.ArrayType():
            out = {"type": "array", "items": schema_of(kind.elementType, kind.containsNull)}
        case T.MapType():
            out = {"type": "object", "additionalProperties": schema_of(kind.valueType, kind.valueContainsNull)}
        case T.BooleanType():
            out = {"type": "boolean"}
        case T.IntegralType():
            out = {"type": "integer"}
        case T.NumericType():
            out = {"type": "number"}
        case _:
            out = {"type": "string"}
    return out | {"type": [out["type"], "null"]} if nullable else out

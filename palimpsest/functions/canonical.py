"""Canonical JSON of any nested value: keys sorted at every level, no spaces, ASCII only, numbers as Python writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value written once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(text: Column) -> Column:
    """A text as a JSON string; all that isn't printable ASCII as lower-case escapes of UTF-16 units."""
    return F.concat(F.lit('"'), _let(_let(text, _escaped), _ascii), F.lit('"'))


def _escaped(text: Column) -> Column:
    body = F.regexp_replace(text, r'(["\\])', r"\\$1")
    for char, short in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        body = F.replace(body, F.lit(char), F.lit(f"\\{short}"))
    return body


def _ascii(body: Column) -> Column:
    # Character by character; one beyond the first 65,536 is two units.
    unit = lambda u: F.concat(F.lit("\\u"), F.lower(u))
    units = lambda c: _let(F.hex(F.encode(c, "UTF-16BE")), lambda h: F.concat(unit(h.substr(1, 4)), F.when(F.length(h) > 4, unit(h.substr(5, 4))).otherwise("")))
    each = F.transform(F.split(body, ""), lambda c: F.when(c.rlike("^[ -~]$"), c).otherwise(units(c)))
    return F.when(body.rlike(r"[^ -~]"), F.array_join(each, "")).otherwise(body)


def number(x: Column) -> Column:
    """A double in its shortest form that reads back the same: plain where its first digit stands for 10^-4 to 10^15, else with an exponent of two digits or more."""

    def parts(text: Column) -> Column:
        mantissa, power = F.substring_index(text, "E", 1), F.when(text.contains("E"), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
        whole = F.substring_index(mantissa, ".", 1)
        return F.struct(F.replace(mantissa, F.lit("."), F.lit("")).alias("digits"), (power + F.length(whole) - 1).alias("exponent"))

    def bare(p: Column) -> Column:  # without zeros in front, which move the first digit's exponent, and behind
        lead = F.length(p["digits"]) - F.length(F.ltrim(p["digits"], F.lit("0")))
        return F.struct(F.trim(p["digits"], F.lit("0")).alias("digits"), (p["exponent"] - lead).alias("exponent"))

    def shorter(p: Column) -> Column:  # older JVMs write up to two digits too many: a digit less is taken if it reads back the same
        fewer = F.call_function("div", p["digits"].cast("long") + 5, F.lit(10)).cast("string")

        def chosen(few: Column) -> Column:
            n = F.length(p["digits"])
            back = F.concat(few, F.lit("E"), (p["exponent"] - n + 2).cast("string")).cast("double")
            other = F.struct(F.rtrim(few, F.lit("0")).alias("digits"), (p["exponent"] + F.length(few) - n + 1).alias("exponent"))
            return F.when((n > 1) & (back == F.abs(x)), other).otherwise(p)

        return _let(fewer, chosen)

    def written(p: Column) -> Column:
        digits, exponent, n = p["digits"], p["exponent"], F.length(p["digits"])
        size = F.abs(exponent).cast("string")
        point = F.when(n == 1, digits).otherwise(F.concat(digits.substr(1, 1), F.lit("."), digits.substr(F.lit(2), n)))
        science = F.concat(point, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        large = F.when(n > exponent + 1, F.concat(digits.substr(F.lit(1), exponent + 1), F.lit("."), digits.substr(exponent + 2, n))).otherwise(F.concat(digits, F.repeat(F.lit("0"), exponent + 1 - n), F.lit(".0")))
        return F.when((exponent < -4) | (exponent >= 16), science).when(exponent < 0, small).otherwise(large)

    finite = (F.abs(x) > 0) & (F.abs(x) < float("inf"))
    body = F.when(x == 0, "0.0").when(finite, _let(_let(_let(_let(parts(F.abs(x).cast("string")), bare), shorter), shorter), written)).otherwise("Infinity")
    sign = F.when((x < 0) | ((x == 0) & (x.cast("string") == "-0.0")), "-").otherwise("")
    return F.when(F.isnan(x), "NaN").otherwise(F.concat(sign, body))


def canonical(value: Column, kind: T.DataType) -> Column:
    """value, of a type made of structs, arrays, maps of texts, texts, numbers, booleans, dates and times, as canonical JSON; null is null.

    Dates, times and decimals become texts. Floats are written as the doubles they equal.
    """
    match kind:
        case T.StructType():
            fields = sorted(kind.fields, key=lambda f: f.name)
            parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(value[f.name], f.dataType)) for f in fields]
            out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        case T.ArrayType():
            out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
        case T.MapType(keyType=T.StringType()):
            entries = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(quoted(k), F.lit(":"), canonical(F.element_at(value, k), kind.valueType)))
            out = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
        case T.StringType():
            out = quoted(value)
        case T.FractionalType() if not isinstance(kind, T.DecimalType):
            out = number(value.cast("double"))
        case T.DateType() | T.DecimalType():
            out = quoted(value.cast("string"))
        case T.TimestampType() | T.TimestampNTZType():
            out = quoted(F.when(F.date_format(value, "SSSSSS") == "000000", F.date_format(value, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")))
        case T.BooleanType() | T.IntegralType():
            out = value.cast("string")
        case _:
            raise ValueError(f"no canonical form: {kind.simpleString()}")
    return F.coalesce(F.when(value.isNotNull(), out), F.lit("null"))

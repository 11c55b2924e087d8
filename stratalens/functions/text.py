"""The classes of types, the text form of values, and literals in a column's own type."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_INSTANT = re.compile(r"[\d\s:.+\-TZ/]+", re.IGNORECASE)
_RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def kind_of(dtype: T.DataType) -> str:
    """numeric, temporal, nested or other."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "temporal"
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return "nested"
    return "other"


def real_text(c: Column) -> Column:
    """The shortest digits of a floating-point number, plain from 1e-4 up to 1e16 and with an exponent of two digits or more elsewhere. Decimals are made of these same digits, so they only move the point."""
    s = c.cast("string")
    plain = F.rtrim(c.cast("decimal(38,21)").cast("string"), F.lit("0"))
    e = F.split_part(s, F.lit("E"), F.lit(2)).cast("int")
    digits = F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), "\\.0$", "")
    far = F.concat(digits, F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    near = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    return F.when(F.contains(s, F.lit("E")), F.when((F.abs(c) >= 1e-4) & (F.abs(c) < 1e16), near).otherwise(far)).when(F.isnan(c) | F.startswith(s, F.lit("Inf")) | F.startswith(s, F.lit("-Inf")), F.when(F.isnan(c), "nan").when(c > 0, "inf").otherwise("-inf")).otherwise(s)


#: The characters that the text of a value of these types can have.
_ALPHABETS = {T.ByteType: "-0123456789", T.ShortType: "-0123456789", T.IntegerType: "-0123456789", T.LongType: "-0123456789", T.DoubleType: "-+.0123456789einfa", T.FloatType: "-+.0123456789einfa", T.DecimalType: "-.0123456789eE+", T.BooleanType: "truefals", T.DateType: "-+0123456789", T.TimestampNTZType: "-+:. 0123456789", T.TimestampType: "-+:. 0123456789"}


def can_contain(dtype: T.DataType, text: str) -> bool:
    """Whether any value's text can have this one in it, in any case; where it can't, a search needn't read the column."""
    alphabet = _ALPHABETS.get(type(dtype))
    return alphabet is None or set(text.lower()) <= set(alphabet.lower())


def text_form(c: Column, dtype: T.DataType) -> Column:
    """A value as text: nested ones as JSON with their null fields, floating-point numbers by their shortest digits."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return real_text(c)
    return c.cast("string")


def typed_literal(raw: str, dtype: T.DataType) -> Column | None:
    """raw as a literal of a numeric or temporal type, so that comparisons reach the scan; None where it doesn't look like one. Whole-number columns take the literal rounded half away from zero; a temporal text that isn't one gives a null."""
    v, kind = raw.strip(), kind_of(dtype)
    if not v:
        return None
    if kind == "numeric":
        if not NUMBER.fullmatch(v):
            return None
        if bits := _RANGES.get(type(dtype)):
            whole = int(Decimal(v).quantize(Decimal(1), ROUND_HALF_UP))
            if not -(1 << bits) <= whole < 1 << bits:
                raise ValueError(f"{v} is out of the range of {dtype.simpleString()}")
            return F.lit(whole).cast(dtype)
        return F.lit(v).cast(dtype)
    if kind == "temporal" and _INSTANT.fullmatch(v):
        return F.lit(v.replace("/", "-")).try_cast(dtype)
    return None

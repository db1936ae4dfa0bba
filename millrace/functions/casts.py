"""Casts with the value rules of Python's ``int``, ``float``, ``bool`` and ``str``, built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ..errors import SpecError

_DIGITS = r"\d+(_\d+)*"
_INT_TEXT = rf"^\s*[+-]?{_DIGITS}\s*$"
_FLOAT_TEXT = (
    rf"^\s*[+-]?(({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))\s*$"
)
_CAST_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType()}
_FRACTIONAL = (T.FloatType, T.DoubleType)


def _null(data_type: T.DataType) -> Column:
    return F.lit(None).cast(data_type)


def truthy(value: Column, data_type: T.DataType) -> Column:
    """Truth value of a non-null value: zero and empty are false, everything else is true. NULL stays NULL."""
    if isinstance(data_type, T.BooleanType):
        return value
    if isinstance(data_type, T.NumericType):
        return value != F.lit(0)
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.length(value) > 0
    if isinstance(data_type, (T.ArrayType, T.MapType)):
        return F.when(value.isNotNull(), F.size(value) > 0)
    return F.when(value.isNotNull(), F.lit(True))


def python_str(value: Column, data_type: T.DataType) -> Column:
    """Text of a value, with ``True`` / ``False`` and the float notation 1e+16 rather than 1.0E16."""
    if isinstance(data_type, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(data_type, _FRACTIONAL):
        text = value.cast("string")
        size = F.abs(value)
        mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
        power = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
        sign = F.when(power < 0, "e-").otherwise("e+")
        exponent = F.concat(mantissa, sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
        exponent = F.when(F.abs(power) >= 100, F.concat(mantissa, sign, F.abs(power).cast("string"))).otherwise(exponent)
        plain = F.regexp_replace(value.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
        return (
            F.when(F.isnan(value), "nan")
            .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
            .when(~text.contains("E"), text)
            .when((size >= 1e-4) & (size < 1e16), plain)
            .otherwise(exponent)
        )
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(value)
    return value.cast("string")


def _to_int(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return F.when(value.rlike(_INT_TEXT), F.replace(F.trim(value), F.lit("_"), F.lit("")).try_cast("bigint"))
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return value.try_cast("bigint")
    return _null(T.LongType())


def _to_float(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return F.when(value.rlike(_FLOAT_TEXT), F.replace(F.trim(value), F.lit("_"), F.lit("")).try_cast("double"))
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return value.try_cast("double")
    return _null(T.DoubleType())


def cast_column(value: Column, data_type: T.DataType, to: str, on_error: str = "null") -> Column:
    """``value`` as int, float, bool or str.

    ``on_error`` says what a value that does not convert becomes: ``null`` keeps the column typed,
    ``keep`` leaves the original text in place (the column is then a string), ``fail`` stops the query.
    """
    if on_error not in ("null", "keep", "fail"):
        raise SpecError(f"on_error must be null, keep or fail, not {on_error!r}")
    if to == "bool":
        return truthy(value, data_type)
    if to == "str":
        return python_str(value, data_type)
    if to not in _CAST_TYPES:
        raise SpecError(f"unknown cast target {to!r}")
    result = _to_int(value, data_type) if to == "int" else _to_float(value, data_type)
    if on_error == "keep":
        return F.coalesce(python_str(result, _CAST_TYPES[to]), python_str(value, data_type))
    if on_error == "fail":
        message = F.concat(F.lit(f"cannot cast to {to}: "), python_str(value, data_type))
        return F.when(value.isNotNull() & result.isNull(), F.raise_error(message).cast(_CAST_TYPES[to])).otherwise(result)
    return result

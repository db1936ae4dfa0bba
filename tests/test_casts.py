import math

import pytest
from conftest import rows

from millrace.errors import SpecError
from millrace.functions import cast_column
from millrace.columns import col
from millrace.operators import type_cast

TEXTS = [None, "12", " 42 ", "3.7", "1_000", "x", "", "+5", "-0", "1e5", ".5", "5.", "inf", "-Infinity", "nan", "1.0d", "0x10", "1__0", "1_0.5", "True"]
NUMBERS = [None, 0.0, -0.9, 3.99, -3.99, 1e16, 1.5e16, 12345678.9, 1e7, 123456789012345.0, 1e-4, 1.2e-5, 1e-10, 1e100, -2.5e-7, float("nan"), float("inf"), float("-inf"), 0.1]


def python_cast(value, kind):
    try:
        return {"int": int, "float": float, "bool": bool, "str": str}[kind](value)
    except (ValueError, OverflowError, TypeError):
        return None


def same(got, want):
    if isinstance(want, int) and not isinstance(want, bool) and abs(want) >= 2**63:
        return got is None
    if isinstance(want, float) and math.isnan(want):
        return isinstance(got, float) and math.isnan(got)
    return got == want


@pytest.mark.parametrize("kind", ["int", "float", "bool", "str"])
@pytest.mark.parametrize("values, data_type", [(TEXTS, "string"), (NUMBERS, "double"), ([None, 0, 7, -3], "long"), ([None, True, False], "boolean")])
def test_values_convert_as_in_python(spark, kind, values, data_type):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {data_type}")
    got = {r["i"]: r["c"] for r in df.select("i", cast_column(col("v"), df.schema["v"].dataType, kind).alias("c")).collect()}
    wrong = [(v, got[i]) for i, v in enumerate(values) if not same(got[i], None if v is None else python_cast(v, kind))]
    assert not wrong


def test_failures_can_keep_the_text_or_stop(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,)], "v string")
    assert rows(type_cast(df, {"v": "int"}, on_error="keep")) == [("12",), ("x",), (None,)]
    with pytest.raises(Exception, match="cannot cast to int: x"):
        type_cast(df, {"v": "int"}, on_error="fail").collect()
    with pytest.raises(SpecError):
        type_cast(df, {"v": "int"}, on_error="explode")


def test_unknown_fields_and_types_are_ignored(spark):
    df = spark.createDataFrame([("12",)], "v string")
    assert type_cast(df, {"gone": "int", "v": "uuid"}).schema == df.schema


def test_dates_do_not_become_numbers(spark):
    df = spark.sql("SELECT DATE'2024-01-02' AS d, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS t")
    assert type_cast(df, {"d": "int", "t": "float"}).first() == (None, None)
    assert type_cast(df, {"d": "str", "t": "bool"}).first() == ("2024-01-02", True)

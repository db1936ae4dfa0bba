"""Segmented scans beside plain windows, with keys that lie in many pieces."""

import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from millrace.errors import SpecError
from millrace.operators import Segments


@pytest.fixture(scope="module")
def data(spark):
    """One key holds half the rows, some have one, one is NULL; values and order hold NULLs and ties."""
    out = []
    for i in range(2000):
        key = "hot" if i % 2 else (None if i % 14 == 0 else f"k{i % 600}")
        out.append((key, None if i % 41 == 0 else (i * 7919) % 311, i, None if i % 5 == 0 else i % 97))
    return spark.createDataFrame(out, "key string, at long, id long, v long").repartition(5)


def plain(data, *columns):
    w = Window.partitionBy("key").orderBy(F.col("at").asc_nulls_first(), "id")
    return rows(data.select("key", "at", "id", "v", *[c.over(w) if not isinstance(c, tuple) else c[0].over(c[1](w)) for c in columns]))


UP = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)


def test_running_kinds(data):
    got = Segments(data, ["key"], ["at"], tie=["id"], pieces=13).running(
        {"s": ("sum", "v"), "c": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "x": ("bit_xor", "v"), "f": ("first", "v"), "l": ("last", "v")}
    )
    want = [(f("v"), UP) for f in (F.sum, F.count, F.min, F.max, F.bit_xor)]
    want += [(f("v", ignorenulls=True), UP) for f in (F.first, F.last)]
    assert rows(got.frame()) == plain(data, *want)


def test_numbers_ranks_and_totals(data):
    s = Segments(data, ["key"], ["at"], tie=["id"], pieces=13).row_number("n").rank("r", dense="d").total({"all": ("sum", "v"), "many": ("count", F.lit(1))})
    w = Window.partitionBy("key").orderBy(F.col("at").asc_nulls_first())
    whole = Window.partitionBy("key")
    want = data.select(
        "key", "at", "id", "v", F.row_number().over(w.orderBy(F.col("at").asc_nulls_first(), "id")),
        F.rank().over(w), F.dense_rank().over(w), F.sum("v").over(whole), F.count("*").over(whole),
    )
    assert rows(s.frame()) == rows(want)


@pytest.mark.parametrize("block", [7, 100_000])
def test_moving_frames_and_shifts(data, block):
    s = Segments(data, ["key"], ["at"], tie=["id"], pieces=13)
    got = s.moving(6, 2, {"m": F.avg("v"), "c": F.count("*")}, block).shift({"back": ("v", 3, -1), "ahead": ("id", -2, None)}, block)
    near = lambda w: w.rowsBetween(-6, 2)
    assert rows(got.frame()) == plain(data, (F.avg("v"), near), (F.count("*"), near), F.lag("v", 3, -1), F.lead("id", 2))


def test_descending_order_without_keys(data):
    got = Segments(data, [], ["-at", "id"], tie=["id"], pieces=9).row_number("n").running({"s": ("sum", "v")}).frame()
    w = Window.orderBy(F.col("at").desc_nulls_last(), "id")
    assert rows(got) == rows(data.select("*", F.row_number().over(w), F.sum("v").over(UP(w))))


def test_one_key_of_equal_rows_is_split(spark):
    same = spark.range(5000).select(F.lit("a").alias("key"), F.lit(1).alias("at"))
    s = Segments(same, ["key"], ["at"], pieces=8)
    sizes = [r["count"] for r in s._rows.groupBy("_segment_piece").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    assert rows(s.row_number("n").frame(), "n") == rows(spark.range(1, 5001))


def test_empty_and_clashing_names(spark, data):
    assert Segments(data.limit(0), ["key"], ["at"], tie=["id"]).row_number().rank().moving(1, 1, {"m": F.sum("v")}).frame().count() == 0
    with pytest.raises(SpecError):
        Segments(data.withColumn("_segment_piece", F.lit(1)), ["key"], ["at"])
    with pytest.raises(SpecError):
        Segments(data, ["key"], ["at"], tie=["id"]).running({"m": ("median", "v")})


def test_carried_rows_are_few_and_broadcast(data):
    s = Segments(data, ["key"], ["at"], tie=["id"], pieces=13)
    assert s._edges.count() <= 13
    names = s.row_number("n").frame()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in names and "SortMergeJoin" not in names

import pytest
from conftest import plan, rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.errors import SpecError
from millrace.operators import asof_join, asof_join_scan, range_join, sql_transform, top_k_per_group

small = st.one_of(st.none(), st.integers(0, 2))
left_rows = st.lists(st.tuples(small, st.one_of(st.none(), st.integers(-5, 30))), min_size=1, max_size=12)
right_rows = st.lists(st.tuples(small, st.one_of(st.none(), st.integers(-5, 30)), st.integers(0, 9)), max_size=12)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(left_rows, right_rows, st.sampled_from([3.0, 10.0, 1000.0]))
def test_asof_join_against_every_pair(spark, lefts, rights, width):
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(lefts)], "i long, k long, at long")
    right = spark.createDataFrame(rights, "k long, at long, v long")
    got = dict(rows(asof_join(left, right, ["k"], "at", ["v"], width), "i", "v"))
    for i, (k, at) in enumerate(lefts):
        earlier = [(t, v) for key, t, v in rights if None not in (k, at, key, t) and key == k and t <= at]
        assert got[i] == (max(earlier)[1] if earlier else None)
    assert len(got) == len(lefts)


def test_time_slices_ignore_the_session_zone(spark):
    left = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ'2024-03-31 03:10:00' AS at")
    right = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ'2024-03-31 02:50:00' AS at, 7 AS v")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert rows(asof_join(left, right, ["k"], "at", ["v"], 1800), "v") == [(7,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    with pytest.raises(SpecError):
        asof_join(left, right.selectExpr("k", "CAST(at AS TIMESTAMP) AS at", "v"), ["k"], "at", ["v"], 1800)


def test_a_hot_key_is_cut_into_slices(spark):
    left = spark.range(1000).selectExpr("1L AS k", "id AS at")
    right = spark.range(0, 1000, 10).selectExpr("1L AS k", "id AS at", "id AS v")
    joined = asof_join(left, right, ["k"], "at", ["v"], slice_width=50)
    assert joined.where("v = floor(at / 10) * 10").count() == 1000
    assert "hashpartitioning(k#" in plan(joined) and "_slice#" in plan(joined).split("Window")[1]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 40), max_size=10), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=6), st.sampled_from([1.0, 7.0, 100.0]))
def test_range_join_against_every_pair(spark, points, ranges, width):
    p = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "i long, x long")
    r = spark.createDataFrame([(j, lo, hi) for j, (lo, hi) in enumerate(ranges)], "j long, lo long, hi long")
    joined = range_join(p, r, "x", "lo", "hi", width)
    want = sorted(((i, j) for i, x in enumerate(points) for j, (lo, hi) in enumerate(ranges) if lo <= x < hi), key=repr)
    assert rows(joined, "i", "j") == want
    outer = rows(range_join(p, r, "x", "lo", "hi", width, how="left"), "i")
    assert {i for (i,) in outer} == set(range(len(points)))


def test_range_join_is_an_equi_join(spark):
    r = spark.range(10).selectExpr("id * 5 AS lo", "id * 5 + 5 AS hi")
    text = plan(range_join(spark.range(100), r, "id", "lo", "hi", 5))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_top_k(spark):
    df = spark.range(100).selectExpr("id % 2 AS g", "id AS v")
    top = top_k_per_group(df, ["g"], [F.col("v").desc()], 2)
    assert rows(top) == [(0, 96, 2), (0, 98, 1), (1, 97, 2), (1, 99, 1)]
    assert plan(top).index("WindowGroupLimit") < plan(top).index("Exchange") < plan(top).rindex("WindowGroupLimit")


def test_approximate_aggregates_stay_close(spark):
    df = spark.range(20000).selectExpr("id % 5000 AS v")
    got = sql_transform(df, "SELECT approx_count_distinct(v) AS n, approx_percentile(v, 0.5) AS m FROM data").first()
    assert abs(got["n"] - 5000) < 500 and abs(got["m"] - 2500) < 50


def test_range_join_refuses_forms_that_repeat_ranges(spark):
    r = spark.createDataFrame([(0, 40)], "lo long, hi long")
    for how in ("right", "full"):
        with pytest.raises(SpecError):
            range_join(spark.range(3), r, "id", "lo", "hi", 10, how=how)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(left_rows, right_rows)
def test_asof_scan_against_every_pair(spark, lefts, rights):
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(lefts)], "i long, k long, at long")
    right = spark.createDataFrame(rights, "k long, at long, v long")
    got = dict(rows(asof_join_scan(left, right, ["k"], "at", ["v"]), "i", "v"))
    for i, (k, at) in enumerate(lefts):
        earlier = [(t, v) for key, t, v in rights if None not in (k, at, key, t) and key == k and t <= at]
        assert got[i] == (max(earlier)[1] if earlier else None)
    assert len(got) == len(lefts)


def test_asof_scan_reads_each_side_once_and_splits_a_hot_key(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    left = spark.range(1000).selectExpr("1L AS k", "id AS at").mapInPandas(seen, "k long, at long")
    right = spark.range(0, 1000, 10).selectExpr("1L AS k", "id AS at", "id AS v").mapInPandas(seen, "k long, at long, v long")
    joined = asof_join_scan(left, right, ["k"], "at", ["v"])
    assert joined.where("v = floor(at / 10) * 10").count() == 1000
    assert read.value == 1100

"""Interval joins and exact quantiles beside plain versions."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.errors import SpecError
from millrace.operators import exact_quantiles, interval_join
from millrace.operators.intervals import cover
from workload.relational import sql_join_range_outer


def test_covers_are_few_blocks_and_hold_each_point_once(spark):
    rng = random.Random(1)
    spans = [(a, a + n) for a in range(1, 20) for n in range(1, 20)] + [(1, (1 << 61) - 1), (1 << 60, (1 << 60) + 1)]
    spans += [tuple(sorted((rng.randrange(1, 1 << 40), rng.randrange(1, 1 << 40)))) for _ in range(50)]
    spans = [(a, b) for a, b in spans if a < b]
    got = spark.createDataFrame(spans, "a long, b long").select("a", "b", cover(F.col("a"), F.col("b")).alias("c")).collect()
    for r in got:
        blocks = sorted((k << p, (k + 1) << p) for p, k in r.c)
        assert blocks[0][0] == r.a and blocks[-1][1] == r.b
        assert all(x[1] == y[0] for x, y in zip(blocks, blocks[1:]))
        assert len(blocks) <= 2 * max(1, (r.b - r.a).bit_length())


def brute(points, ranges, how):
    out, hit = [], set()
    for p in points:
        own = [i for i, r in enumerate(ranges) if r[0] == p[0] and p[0] is not None and p[2] is not None and (r[2] is None or r[2] <= p[2]) and (r[3] is None or p[2] < r[3])]
        hit |= set(own)
        if how == "left_semi":
            out += [p] if own else []
        elif how == "left_anti":
            out += [] if own else [p]
        else:
            out += [(*p, *ranges[i][1:]) for i in own]
            if not own and how in ("left", "full"):
                out.append((*p, None, None, None))
    if how in ("right", "full"):
        out += [(r[0], None, None, *r[1:]) for i, r in enumerate(ranges) if i not in hit]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_joins_with_open_empty_and_repeated_ranges(spark, how):
    rng = random.Random(how)
    points = [(rng.choice(["a", "b", None]), i % 50, rng.choice([None, rng.randrange(-60, 60)])) for i in range(70)]
    ranges = [(rng.choice(["a", "b", "c", None]), i % 20, rng.choice([None, rng.randrange(-60, 60)]), rng.choice([None, rng.randrange(-60, 60)])) for i in range(40)]
    left, right = spark.createDataFrame(points, "g string, id long, at int"), spark.createDataFrame(ranges, "g string, rid long, low long, high int")
    got = interval_join(left, right, "at", "low", "high", how, on=["g"])
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(points, ranges, how)


def test_dates_timestamps_and_refusals(spark):
    days = spark.createDataFrame([(date(2024, 1, d),) for d in range(1, 11)], "d date")
    spans = spark.createDataFrame([(1, date(2024, 1, 3), date(2024, 1, 5)), (2, date(2024, 1, 9), None)], "r int, low date, high date")
    assert sorted((r.r, r.d.day) for r in interval_join(days, spans, "d", "low", "high").collect()) == [(1, 3), (1, 4), (2, 9), (2, 10)]
    start = datetime(2024, 1, 1)
    times = spark.createDataFrame([(start + timedelta(microseconds=i),) for i in range(5)], "t timestamp_ntz")
    span = spark.createDataFrame([(start + timedelta(microseconds=1), start + timedelta(microseconds=3))], "low timestamp_ntz, high timestamp_ntz")
    assert interval_join(times, span, "t", "low", "high").count() == 2
    assert interval_join(days.limit(0), spans, "d", "low", "high", "full").count() == 2
    assert interval_join(days, spans.limit(0), "d", "low", "high", "full").count() == 10
    for bad in (lambda: interval_join(days, spans, "d", "low", "r"), lambda: interval_join(days, spans, "d", "low", "high", "cross"), lambda: interval_join(spans.withColumn("low", F.col("low")), spans, "low", "low", "high")):
        with pytest.raises(SpecError):
            bad()


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("by", [["rid"], ["g", "rid"]])
def test_totals_of_the_joined_rows_by_columns_of_the_ranges(spark, how, by):
    rng = random.Random(how)
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *range(50)]), rng.choice([None, rng.randrange(-60, 60)])) for _ in range(70)]
    ranges = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(9)]), rng.choice([None, rng.randrange(-60, 60)]), rng.choice([None, rng.randrange(-60, 60)])) for _ in range(40)]
    left, right = spark.createDataFrame(points, "g string, id long, at int"), spark.createDataFrame(ranges, "g string, rid long, low long, high int")
    totals = {"n": ("count", "id"), "ids": ("sum", "id"), "least": ("min", "id"), "last": ("max", "at")}
    met = defaultdict(list)
    for g, i, at, rid, *_ in brute(points, ranges, how):
        met[(g, rid) if len(by) == 2 else (rid,)].append((i, at))
    some = lambda f, values: f(values) if (values := [v for v in values if v is not None]) else None
    want = [(*k, len([i for i, _ in v if i is not None]), some(sum, [i for i, _ in v]), some(min, [i for i, _ in v]), some(max, [at for _, at in v])) for k, v in met.items()]
    got = interval_join(left, right, "at", "low", "high", how, on=["g"], by=by, totals=totals)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(want, key=repr)
    for one, other in ((left.limit(0), right), (left, right.limit(0))):
        plain = interval_join(one, other, "at", "low", "high", how, on=["g"]).groupBy(*by).agg(F.count("id").alias("n"), F.sum("id").alias("ids"), F.min("id").alias("least"), F.max("at").alias("last"))
        assert sorted(map(repr, interval_join(one, other, "at", "low", "high", how, on=["g"], by=by, totals=totals).collect())) == sorted(map(repr, plain.collect()))


def test_totals_refused(spark):
    left, right = spark.createDataFrame([(1, 2)], "id long, at int"), spark.createDataFrame([(1, 1, 3)], "rid long, low int, high int")
    n = {"n": ("count", "id")}
    for how, by, totals in (("left_semi", ["rid"], n), ("inner", [], n), ("inner", ["id"], n), ("inner", ["rid"], None), ("inner", ["rid"], {"n": ("first", "id")}), ("inner", ["rid"], {"n": ("count", "rid")})):
        with pytest.raises(SpecError):
            interval_join(left, right, "at", "low", "high", how, by=by, totals=totals)


def shuffled(df):
    """Rows that a run of ``df`` writes to shuffles."""
    df.collect()

    def rows(node):
        inner = [node.executedPlan()] if "AdaptiveSparkPlanExec" in node.getClass().getName() else [node.plan()] if "QueryStageExec" in node.getClass().getName() else []
        inner += [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().apply("shuffleRecordsWritten").value() if "ShuffleExchangeExec" in node.getClass().getName() else 0
        return own + sum(map(rows, inner))

    return rows(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def sorted_joins(spark):
    """Joins as of tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_points_of_few_places_are_not_shuffled_in_pairs(spark, sorted_joins):
    left = spark.range(2000).select("id", (F.col("id") % 3).alias("at"))
    right = spark.range(200).select(F.col("id").alias("rid"), F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    met = interval_join(left, right, "at", "low", "high", "full")
    assert met.count() == 400_000 > 10 * shuffled(met)


def test_orders_in_ranges_are_counted_without_their_pairs(spark, sorted_joins, tmp_path):
    n, m, start = 3000, 400, date(1992, 1, 1)
    days = [start + timedelta(days=i * 13 % 2600) for i in range(n)]
    spark.createDataFrame([(i, datetime(d.year, d.month, d.day, i % 24)) for i, d in enumerate(days)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(m).select((F.col("id") * 50).alias("s_suppkey")).union(spark.range(7).select(F.col("id") + 1)).write.parquet(str(tmp_path / "supplier.parquet"))
    got = sql_join_range_outer(spark, str(tmp_path))
    want, hit = {}, set()
    for k in [i * 50 for i in range(m)] + [i + 1 for i in range(7)]:
        low = start + timedelta(days=k * 37 % 2400)
        high = low + timedelta(days=k % 20) if k % 50 else date.max
        own = [i for i, d in enumerate(days) if low <= d < high]
        hit |= set(own)
        want[k] = (k, len(own), min(own, default=None), max(own, default=None))
    alone = [i for i in range(n) if i not in hit]
    want = [*want.values(), *([(None, len(alone), min(alone), max(alone))] if alone else [])]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(want, key=repr)
    assert sum(r[1] for r in want) > 5 * shuffled(got)


@pytest.mark.parametrize("bins, limit", [(4, 3), (4096, 10_000)])
def test_quantiles_of_uneven_groups(spark, bins, limit):
    rng = random.Random(4)
    data = [("hot", rng.choice([1.5, rng.gauss(0, 1e6), rng.random() * 1e-9])) for _ in range(600)]
    data += [(None, float(i)) for i in range(11)] + [("one", 7.0), ("same", 2.0), ("same", 2.0), ("same", 2.0), ("none", None), ("odd", float("nan")), ("odd", 1.0)]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(data, "g string, x double"), ["g"], "x", shares, bins, limit)
    by = defaultdict(list)
    for g, x in data:
        if x is not None and x == x:
            by[g].append(x)
    want = {(g, s): float(np.quantile(v, s)) for g, v in by.items() for s in shares}
    found = {(r.g, r.share): r.quantile for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], rel=1e-12, abs=1e-300) for k in want)


def test_quantiles_of_whole_tables_and_types(spark):
    df = spark.range(1, 101).select(F.col("id").cast("decimal(30,2)").alias("d"), F.lit(1).alias("low"))
    assert [r.quantile for r in exact_quantiles(df, [], "d", [0.5], 3, 2).collect()] == [50.5]
    assert exact_quantiles(df.limit(0), ["low"], "d", [0.5]).count() == 0
    with pytest.raises(SpecError):
        exact_quantiles(df, [], "d", [2.0])
    close = spark.createDataFrame([(2**60 + i,) for i in range(40)], "v long")  # beyond what doubles tell apart
    assert exact_quantiles(close, [], "v", [0.5], 8, 3).first().quantile == float(2**60 + 20)

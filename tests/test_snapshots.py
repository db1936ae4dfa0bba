"""Versioned tables: replacement and upserts that are whole or not there."""

import os
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.errors import SpecError
from millrace.sinks import snapshots as S


def numbered(spark, n, value, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("k"), F.concat(F.lit("g"), F.col("id") % 7).alias("g"), F.lit(value).alias("v"))


def stamps(path):
    found = {}
    for folder, _, names in os.walk(f"{path}/data"):
        for name in names:
            if name.endswith(".parquet"):
                found[f"{os.path.basename(folder)}/{name}"] = os.stat(f"{folder}/{name}").st_mtime_ns
    return found


def test_upsert_rewrites_only_files_that_hold_a_key(spark, where):
    path = where("t")
    S.upsert_snapshot(numbered(spark, 4000, 1), path, ["k"], ["v"], batch_size=500)
    first = S.snapshot(spark, path)
    assert len(first.files) >= 4
    before = stamps(path)
    time.sleep(0.02)
    change = numbered(spark, 10, 2, start=20).unionByName(numbered(spark, 5, 2, start=9000)).unionByName(numbered(spark, 10, 0, start=20))
    assert S.upsert_snapshot(change, path, ["k"], ["v"], batch_size=500) == 2
    second = S.snapshot(spark, path)
    kept = set(first.files) & set(second.files)
    assert len(set(first.files) - kept) == 1
    assert {n: t for n, t in stamps(path).items() if n in kept} == {n: before[n] for n in kept}
    want = numbered(spark, 4000, 1).where("k < 20 OR k >= 30").unionByName(numbered(spark, 10, 2, start=20)).unionByName(numbered(spark, 5, 2, start=9000))
    assert rows(S.read_snapshot(spark, path)) == rows(want)
    assert rows(S.read_snapshot(spark, path, 1)) == rows(numbered(spark, 4000, 1))


def test_new_keys_inside_a_range_rewrite_nothing(spark, where):
    path = where("t")
    S.upsert_snapshot(numbered(spark, 1000, 1).where("k % 2 = 0"), path, ["k"], ["v"])
    old = set(S.snapshot(spark, path).files)
    S.upsert_snapshot(numbered(spark, 9, 1, start=501).where("k % 2 = 1"), path, ["k"], ["v"])
    assert old < set(S.snapshot(spark, path).files)
    assert S.read_snapshot(spark, path).count() == 505


def test_source_is_read_once_and_composite_keys_with_nulls(spark, where):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    source = numbered(spark, 300, 1).mapInPandas(seen, "k long, g string, v int").withColumn("g", F.when(F.col("k") % 50 > 0, F.col("g")))
    S.upsert_snapshot(source, where("t"), ["g", "k"], ["v"])
    assert read.value == 300
    assert S.upsert_snapshot(numbered(spark, 300, 5), where("t"), ["g", "k"], ["v"]) == 2
    got = rows(S.read_snapshot(spark, where("t")))
    assert got == rows(numbered(spark, 300, 5).unionByName(numbered(spark, 300, 1).where("k % 50 = 0").withColumn("g", F.lit(None).cast("string"))))


def test_replace_reads_itself_and_keeps_schema(spark, where):
    path = where("t")
    S.replace_snapshot(numbered(spark, 50, 1), path)
    S.replace_snapshot(S.read_snapshot(spark, path).where("k < 10"), path)
    assert S.read_snapshot(spark, path).count() == 10
    S.replace_snapshot(numbered(spark, 3, 7).drop("g"), path, keep_schema=True)
    assert rows(S.read_snapshot(spark, path)) == [(0, None, 7), (1, None, 7), (2, None, 7)]
    with pytest.raises(SpecError):
        S.replace_snapshot(numbered(spark, 3, 7).withColumn("more", F.lit(1)), path, keep_schema=True)
    S.append_snapshot(numbered(spark, 2, 8), path)
    assert S.read_snapshot(spark, path).count() == 5
    S.replace_snapshot(numbered(spark, 0, 1), path)
    assert S.read_snapshot(spark, path).count() == 0
    gone = S.vacuum(spark, path)
    assert gone and S.read_snapshot(spark, path).columns == ["k", "g", "v"]


@pytest.mark.parametrize("stop", ["_write_data", "_commit", "_create", "after"])
def test_a_job_that_stops_leaves_the_old_or_the_new_table(spark, where, monkeypatch, stop):
    path = where("t")
    S.replace_snapshot(numbered(spark, 20, 1), path)
    old, new = rows(numbered(spark, 20, 1)), rows(numbered(spark, 30, 2))

    def fail(*_, **__):
        raise RuntimeError("stopped")

    if stop == "after":
        real = S._create
        monkeypatch.setattr(S, "_create", lambda *a: (real(*a), fail()))
    else:
        monkeypatch.setattr(S, stop, fail)
    with pytest.raises(RuntimeError):
        S.replace_snapshot(numbered(spark, 30, 2), path)
    monkeypatch.undo()
    assert rows(S.read_snapshot(spark, path)) == (new if stop == "after" else old)
    S.replace_snapshot(numbered(spark, 30, 2), path)  # the repeated job
    assert rows(S.read_snapshot(spark, path)) == new
    S.vacuum(spark, path)
    assert rows(S.read_snapshot(spark, path)) == new


def test_two_writers_and_bad_requests(spark, where):
    path = where("t")
    S.append_snapshot(numbered(spark, 5, 1), path)
    base = S.snapshot(spark, path)
    S.append_snapshot(numbered(spark, 5, 2), path)
    with pytest.raises(S.ConflictError):
        S._commit(spark, path, base, base.schema, (), [], (), None)
    S.append_snapshot(numbered(spark, 5, 3), path, transaction="x")
    S.append_snapshot(numbered(spark, 6, 4), path, transaction="x")  # repeated, and by now there is more to read
    assert [r["v"] for r in S.read_snapshot(spark, path).groupBy("v").count().orderBy("v").collect()] == [1, 2, 4]
    assert S.read_snapshot(spark, path).count() == 16
    with pytest.raises(SpecError):
        S.read_snapshot(spark, where("absent"))
    with pytest.raises(SpecError):
        S.snapshot(spark, path, 9)
    with pytest.raises(SpecError):
        S.upsert_snapshot(numbered(spark, 5, 1), path, ["k"], ["v"])
    with pytest.raises(SpecError):
        S.append_snapshot(numbered(spark, 5, 1).withColumn("more", F.lit(1)), path)
    with pytest.raises(SpecError):
        S.upsert_snapshot(spark.range(3).select(F.col("id").cast("double").alias("k")), where("d"), ["k"], ["k"])

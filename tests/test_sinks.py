import json
import os

import pytest
from conftest import plan, rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.errors import MissingConnectorError, SpecError
from millrace.session import path_exists
from millrace.sinks import (
    check_constraints,
    ensure_target,
    latest_per_key,
    merge_rows,
    read_partitioned,
    read_runs,
    replace_files,
    require_constraints,
    split_rejects,
    truncate_files,
    upsert_files,
    write_files,
    write_json_arrays,
    write_partitioned,
    write_run,
    write_singer,
    write_streams,
    write_vendor,
    write_with_quarantine,
)
from millrace.sinks.files import restore
from millrace.sinks.jdbc import write_options
from millrace.sinks.vendor import vendor_write_options


def files(path, suffix):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(suffix) and not f.startswith("."))


def test_batches_limit_rows_per_file(spark, where):
    write_files(spark.range(0, 1050, 1, 1), where("p"), batch_size=500)
    assert len(files(where("p"), ".parquet")) == 3
    with pytest.raises(SpecError):
        write_files(spark.range(1), where("x"), "xml")


def test_parquet_compression(spark, where):
    write_files(spark.range(5), where("s"))
    write_files(spark.range(5), where("n"), compression="none")
    assert all("snappy" in f for f in files(where("s"), ".parquet"))
    assert not any("snappy" in f for f in files(where("n"), ".parquet"))


def test_csv_columns_in_name_order_and_nested_as_json(spark, where):
    write_files(spark.sql("SELECT 1 AS z, array(1, 2) AS a, ' pad ' AS m"), where("c"), "csv", sort_columns=True)
    text = open(files(where("c"), ".csv")[0]).read()
    assert text.splitlines()[0] == "a,m,z"
    assert '"[1,2]"' in text and " pad " in text


def test_jsonl_keeps_null_keys(spark, where):
    write_files(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), where("j"), "jsonl")
    assert json.loads(open(files(where("j"), ".json")[0]).read()) == {"a": 1, "b": None}


def test_json_arrays_hold_one_batch_each(spark, where):
    write_json_arrays(spark.range(0, 25, 1, 1), where("a"), batch_size=10)
    sizes = sorted(len(json.load(open(f))) for f in files(where("a"), ".txt"))
    assert sizes == [5, 10, 10]
    write_json_arrays(spark.range(0, 25, 1, 1), where("b"), batch_chars=80)
    assert len(files(where("b"), ".txt")) > 2
    assert spark.read.option("multiLine", True).json(where("b")).count() == 25


def test_partition_values_are_cleaned(spark, where):
    df = spark.createDataFrame([(1, "a b"), (2, "c/d"), (3, None)], "id long, k string")
    write_partitioned(df, where("p"), ["k"])
    assert sorted(d for d in os.listdir(where("p")) if "=" in d) == ["k__dir=None", "k__dir=a_b", "k__dir=c_d"]
    assert rows(read_partitioned(spark, where("p")), "id", "k") == rows(df, "id", "k")


def test_streams_by_name_and_by_column(spark, where):
    write_streams({"a": spark.range(2), "b": spark.range(3)}, where("n"))
    assert spark.read.parquet(where("n") + "/b").count() == 3
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, _stream string")
    write_streams(df, where("c"))
    assert rows(spark.read.parquet(where("c") + "/_stream=y"), "id") == [(2,)]


def test_replacing_what_is_read_and_recovering(spark, where):
    path = where("t")
    write_files(spark.range(4), path)
    replace_files(spark.read.parquet(path).where("id > 1"), path)
    assert rows(spark.read.parquet(path)) == [(2,), (3,)]
    os.rename(path, path + "__previous")  # a job stopped between the two renames
    restore(spark, path)
    assert rows(spark.read.parquet(path)) == [(2,), (3,)]
    assert not path_exists(spark, path + "__previous")


def test_replacing_without_a_rename(spark, where):
    path = where("t")
    write_files(spark.range(4), path)
    replace_files(spark.read.parquet(path).where("id > 1"), path, by_rename=False)
    assert rows(spark.read.parquet(path)) == [(2,), (3,)]
    replace_files(spark.range(1), path, reads_target=False, by_rename=False)
    assert rows(spark.read.parquet(path)) == [(0,)]


def test_truncate_keeps_the_schema(spark, where):
    path = where("t")
    write_files(spark.sql("SELECT 1L AS a, 'x' AS b"), path)
    truncate_files(spark.sql("SELECT CAST(7 AS INT) AS a"), path)
    assert spark.read.parquet(path).dtypes == [("a", "bigint"), ("b", "string")]
    assert rows(spark.read.parquet(path)) == [(7, None)]
    with pytest.raises(SpecError):
        truncate_files(spark.sql("SELECT 1 AS zz"), path)


def test_ensure_target_leaves_an_existing_one(spark, where):
    schema = spark.range(1).schema
    assert ensure_target(spark, where("e"), schema)
    assert spark.read.parquet(where("e")).count() == 0
    write_files(spark.range(2), where("e"))
    assert not ensure_target(spark, where("e"), schema)
    assert spark.read.parquet(where("e")).count() == 2


def test_repeated_runs_add_nothing(spark, where):
    for run, n in ((1, 3), (2, 2), (2, 4)):
        write_run(spark.range(n), where("r"), run)
    assert read_runs(spark, where("r")).count() == 7


def test_latest_per_key_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS v")
    latest = latest_per_key(df, ["k"], ["v"])
    assert rows(latest) == [(0, 99), (1, 97), (2, 98)]
    text = plan(latest)
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")
    with pytest.raises(SpecError):
        latest_per_key(df, [], ["v"])


def test_null_keys_are_all_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 1), (1, 5)], "k long, v long")
    assert rows(latest_per_key(df, ["k"], ["v"])) == [(1, 5), (None, 1), (None, 2)]


def test_merge_keeps_untouched_duplicates(spark):
    target = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "k long, v string")
    latest = spark.createDataFrame([(2, "z")], "k long, v string")
    assert rows(merge_rows(target, latest, ["k"])) == [(1, "a"), (1, "b"), (2, "z")]


def test_partitioned_upsert_leaves_other_partitions_alone(spark, where):
    path = where("u")
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 1)], "p string, k long, v long")
    write_files(df, path, partition_by=["p"])
    before = files(path + "/p=b", ".parquet")
    new = spark.createDataFrame([("a", 2, 9), ("c", 5, 5)], "p string, k long, v long")
    upsert_files(new, path, ["p", "k"], ["v"], partition_by=["p"])
    assert rows(spark.read.parquet(path), "p", "k", "v") == [("a", 1, 1), ("a", 2, 9), ("b", 1, 1), ("c", 5, 5)]
    assert files(path + "/p=b", ".parquet") == before


def test_partition_names_that_look_like_numbers_stay_text(spark, where):
    path = where("u")
    write_files(spark.createDataFrame([("01", 1, 1), (None, 3, 3)], "p string, k long, v long"), path, partition_by=["p"])
    new = spark.createDataFrame([("01", 1, 2), ("1", 1, 3), (None, 4, 4)], "p string, k long, v long")
    upsert_files(new, path, ["p", "k"], ["v"], partition_by=["p"])
    got = rows(spark.read.schema("p string, k long, v long").parquet(path), "p", "k", "v")
    assert got == sorted([("01", 1, 2), ("1", 1, 3), (None, 3, 3), (None, 4, 4)], key=repr)


batches = st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=6), min_size=1, max_size=3)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(batches)
def test_upserts_match_a_dict(spark, tmp_path_factory, data):
    path, model = str(tmp_path_factory.mktemp("upsert") / "t"), {}
    for batch in data:
        upsert_files(spark.createDataFrame(batch, "k long, v long"), path, ["k"], ["v"])
        incoming = {}
        for k, v in batch:
            incoming[k] = max(v, incoming.get(k, v))
        model.update(incoming)
    assert rows(spark.read.parquet(path)) == sorted(model.items(), key=repr)


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (1, "c")], "k long, v string")
    got = {(r[0], r[1]): r[2] for r in check_constraints(df, ["v"], ["k"]).collect()}
    assert got == {("not_null", "v"): 1, ("not_null", "k"): 1, ("primary_key", "k"): 2}
    with pytest.raises(ValueError, match="primary_key"):
        require_constraints(df, primary_key=["k"])
    require_constraints(spark.range(3), primary_key=["id"])
    assert [r[2] for r in check_constraints(df.limit(0), ["v"], ["k"]).collect()] == [0, 0, 0]


def test_quarantine_splits_every_row(spark, where):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1), (None, None)], "id long, v long")
    good, bad = split_rejects(df, ["id"], {"positive": "v > 0"})
    assert rows(good, "id") == [(1,)]
    assert rows(bad, "_reject_reason") == [("id is null; positive",), ("positive",), ("positive",)]
    assert write_with_quarantine(df, where("g"), where("b"), ["id"], {"positive": "v > 0"}) == (1, 3)
    assert write_with_quarantine(df.where("false"), where("g2"), where("b2"), ["id"]) == (0, 0)


def test_singer_log_layout(spark, where):
    df = spark.sql("SELECT 1L AS id, CAST(NULL AS STRING) AS n, array(1) AS v, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS t")
    write_singer(df, where("s"), "u", ["id"], {"at": 1})
    assert [d for d in sorted(os.listdir(where("s")))] == ["0-schema", "1-records", "2-state"]
    lines = [json.loads(r[0]) for r in spark.read.text(where("s") + "/*").collect()]
    schema = next(m for m in lines if m["type"] == "SCHEMA")
    assert schema["key_properties"] == ["id"]
    assert schema["schema"]["properties"]["t"] == {"type": "string", "format": "date-time"}
    assert next(m for m in lines if m["type"] == "RECORD")["record"]["n"] is None
    assert next(m for m in lines if m["type"] == "STATE")["value"] == {"at": 1}


def test_jdbc_write_options(spark):
    df = spark.sql("SELECT 1 AS a, 'x' AS b, true AS c")
    config = {"type": "oracle", "dsn": "h/x", "table": "t", "user": "u", "batch_size": 50}
    options = write_options(df, config)
    assert options["createTableColumnTypes"] == "`b` VARCHAR(4000)" and options["batchsize"] == "50" and options["dbtable"] == "t"
    assert "createTableColumnTypes" not in write_options(df, {"type": "mysql", "host": "h", "database": "d", "table": "t"})
    with pytest.raises(SpecError):
        write_options(df, {"type": "mysql", "host": "h", "database": "d"})


def test_vendor_write_options(spark):
    big = {"type": "bigquery", "project_id": "p", "dataset_id": "d", "table": "t"}
    assert vendor_write_options(big)["writeMethod"] == "direct"
    snow = {"type": "snowflake", "account": "a", "username": "u", "password": "p", "database": "d", "schema": "s", "table": "t"}
    assert vendor_write_options(snow, "truncate")["truncate_table"] == "on"
    with pytest.raises(SpecError):
        vendor_write_options(big, "upsert")
    with pytest.raises(MissingConnectorError):
        write_vendor(spark.range(1), big)


def test_quarantine_judges_each_row_once(spark, where):
    """A hook that answers differently every time still puts each row in one place."""
    seen = spark.sparkContext.accumulator(0)

    def hook(batches):
        import random

        for b in batches:
            seen.add(len(b))
            b["v"] = [random.choice([-1, 1]) for _ in range(len(b))]
            yield b

    df = spark.range(400).withColumn("v", F.lit(0)).mapInPandas(hook, "id long, v int")
    good, bad = write_with_quarantine(df, where("g"), where("b"), checks={"positive": "v > 0"})
    assert seen.value == 400 and good + bad == 400
    kept, rejected = spark.read.parquet(where("g")), spark.read.parquet(where("b"))
    assert (kept.count(), rejected.count()) == (good, bad)
    assert sorted(r[0] for r in kept.select("id").union(rejected.select("id")).collect()) == list(range(400))
    assert kept.where("v < 0").isEmpty() and rejected.where("v > 0").isEmpty()


def test_json_arrays_by_partition_with_compression(spark, where):
    df = spark.range(60).selectExpr("id", "CASE WHEN id % 3 > 0 THEN id % 3 END AS p", "'x' AS t")
    write_files(df, where("j"), "json", partition_by=["p"], compression="gzip", batch_size=7)
    names = files(where("j"), ".txt.gz")
    assert len(names) >= 9 and all("/p=" in n for n in names)
    back = spark.read.schema("id long, t string, p long").option("multiLine", True).json(where("j"))
    assert rows(back, "id", "p", "t") == rows(df)
    assert max(r["count"] for r in back.groupBy(F.input_file_name()).count().collect()) == 7
    with pytest.raises(SpecError):
        write_files(df, where("k"), "json", partition_by=["absent"])

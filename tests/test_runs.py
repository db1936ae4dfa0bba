import json
from datetime import date, datetime, timezone

import pytest
from conftest import SF, plan, rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.errors import SpecError
from millrace.plans import RunSpec, State, StateStore, after_cursor, after_cursor_lenient, build, run, sync_plan
from millrace.plans.incremental import next_cursor, parse_cursor, stepped_back
from millrace.runlog import RunLog
from millrace.sinks import read_snapshot, read_runs, write_files
from millrace.sources import mongo_predicate


def spec(source, target, **more):
    destination = {"type": "local_file", "file_path": target, "table_name": "t", **more.pop("destination", {})}
    base = {"name": "n", "source_config": {"type": "local_file", "file_path": source, "table_name": "t"}, "destination_config": destination}
    return RunSpec.from_dict({**base, **more})


def chain(*steps):
    return {"transformers": [{"type": name, "config": config} for name, config in steps]}


def test_strict_and_lenient_cursors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], "n long, s string")
    assert rows(after_cursor(df, "n", 1), "n") == [(2,)]
    assert after_cursor(df, "n", None).count() == 3
    assert rows(after_cursor_lenient(df, "n", 1), "n") == [(2,), (None,)]
    assert after_cursor_lenient(df, "gone", 1).count() == 3
    assert after_cursor_lenient(df, "s", 5).count() == 3  # text against a number: cannot be compared
    assert rows(after_cursor_lenient(df, "s", "a"), "s") == [("b",), (None,)]
    assert after_cursor_lenient(df, None, 1).count() == 3


def test_cursor_reaches_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(after_cursor(orders, "o_orderdate", datetime(1998, 1, 1)))
    assert "GreaterThan(o_orderdate,1998-01-01T00:00)" in text and "Exchange" not in text and "Sort" not in text


@pytest.mark.parametrize(
    "data_type, value",
    [("long", 5), ("double", 0.1), ("string", "x y"), ("date", date(2024, 2, 3)), ("timestamp_ntz", datetime(2024, 2, 3, 4, 5, 6, 789012)), ("boolean", True)],
)
def test_cursors_survive_saving(spark, data_type, value):
    df = spark.createDataFrame([(value,), (None,)], f"c {data_type}")
    text = df.agg(next_cursor(df, "c")).first()[0]
    assert parse_cursor(text, df.schema["c"].dataType) == value
    assert after_cursor(df, "c", parse_cursor(text, df.schema["c"].dataType)).count() == 0


def test_cursors_do_not_depend_on_the_session_zone(spark):
    moments = [datetime(2024, 3, 31, 2, 30, 0, 5), datetime(2024, 1, 1)]  # the first does not exist in Berlin
    for data_type in ("timestamp_ntz", "timestamp"):
        rows_in = [(m if data_type == "timestamp_ntz" else m.replace(tzinfo=timezone.utc),) for m in moments]
        df = spark.createDataFrame(rows_in, f"c {data_type}")
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        try:
            text = df.agg(next_cursor(df, "c")).first()[0]
            assert parse_cursor(text, df.schema["c"].dataType) == rows_in[0][0]
            assert after_cursor(df, "c", parse_cursor(text, df.schema["c"].dataType)).count() == 0
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_state_store(spark, where):
    store = StateStore(spark, where("state"))
    assert store.load("p", "s") == State("p", "s")
    store.save(State("p", "s").advanced("c", "5", 10))
    store.save(store.load("p", "s").advanced("c", None, 0))
    store.save(State("q", "s").advanced("c", "99", 1))
    state = store.load("p", "s")
    assert (state.cursor_value, state.run, state.last_record_count, state.total_records_synced) == ("5", 2, 0, 10)


def test_sync_modes():
    assert sync_plan("full_refresh", "c") == (False, "overwrite")
    assert sync_plan("append", None) == (False, "append")
    assert sync_plan("incremental", "c") == (True, "append")
    assert sync_plan("upsert", None) == (False, "upsert")
    with pytest.raises(SpecError):
        sync_plan("incremental", None)
    with pytest.raises(SpecError):
        sync_plan("mirror", None)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 50), unique=True, min_size=1, max_size=20), st.lists(st.integers(0, 50), max_size=3))
def test_incremental_runs_add_up_to_one_full_read(spark, tmp_path_factory, keys, cuts):
    base = tmp_path_factory.mktemp("inc")
    landing, target, store = str(base / "landing"), str(base / "target"), StateStore(spark, str(base / "state"))
    one = spec(landing, target, sync_mode="incremental", cursor_field="k")
    low = -1
    for cut in [*sorted(cuts), 50]:
        arrived = [(k,) for k in keys if low < k <= cut]
        if arrived:
            write_files(spark.createDataFrame(arrived, "k long"), landing)
        low = max(low, cut)
        if arrived or store.load("n", "t").run:
            run(spark, one, store, raise_errors=True)
    assert rows(read_runs(spark, target + "/t")) == sorted([(k,) for k in keys], key=repr)
    assert store.load("n", "t").total_records_synced == len(keys)


def test_a_run_lost_before_its_state_was_saved_adds_no_duplicates(spark, where):
    write_files(spark.range(5), where("in"))
    store = StateStore(spark, where("state"))
    one = spec(where("in"), where("out"), sync_mode="incremental", cursor_field="id")
    assert run(spark, one, None, raise_errors=True).records_written == 5  # nothing saved: as if it died there
    write_files(spark.range(5, 8), where("in"))
    result = run(spark, one, store, raise_errors=True)
    assert result.records_written == 8 and result.cursor_value == "7"
    assert read_runs(spark, where("out") + "/t").count() == 8
    assert run(spark, one, store, raise_errors=True).records_written == 0
    assert store.load("n", "t").cursor_value == "7"


def test_counts_are_taken_in_the_same_pass(spark, where):
    write_files(spark.range(100), where("in"))
    steps = chain(("filter_rows", {"predicate": "id >= 40"}), ("noop", {}), ("filter_rows", {"predicate": "id % 2 == 0"}))
    result = run(spark, spec(where("in"), where("out"), transform_config=steps), raise_errors=True)
    assert (result.records_read, result.records_processed, result.records_written) == (100, 60 + 60 + 30, 30)
    assert [(o.operator_name, o.records_in, o.records_out) for o in result.operators] == [
        ("local_file", 100, 100), ("filter_rows", 100, 60), ("noop", 60, 60), ("filter_rows", 60, 30), ("local_file", 30, 30),
    ]
    lean = run(spark, spec(where("in"), where("out"), transform_config=steps), metrics="written", raise_errors=True)
    assert lean.records_written == 30 and len(lean.operators) == 1


def test_counts_of_steps_spark_leaves_out(spark, where):
    write_files(spark.range(10), where("in"))
    for text, written in (("SELECT * FROM data WHERE 1 = 0", 0), ("SELECT a.id FROM data a JOIN data b ON a.id = b.id", 10), ("SELECT a.id FROM data a JOIN (SELECT id FROM data WHERE id < 0) b USING (id)", 0)):
        steps = chain(("duckdb_sql_transformer", {"sql_query": text}))
        result = run(spark, spec(where("in"), where("out"), transform_config=steps), raise_errors=True)
        assert (result.records_read, result.records_written) == (10, written)


def test_a_source_can_be_refreshed_in_place(spark, where):
    write_files(spark.range(10), where("out") + "/t")
    steps = chain(("filter_rows", {"predicate": "id > 6"}))
    result = run(spark, spec(where("out") + "/t", where("out"), transform_config=steps), raise_errors=True)
    assert (result.records_read, result.records_written) == (10, 3)
    assert rows(spark.read.parquet(where("out") + "/t")) == [(7,), (8,), (9,)]


def test_quarantine_counts(spark, where):
    write_files(spark.range(10), where("in"))
    target = {"quarantine": {"path": where("bad"), "checks": {"small": "id < 7"}}}
    result = run(spark, spec(where("in"), where("out"), destination=target), raise_errors=True)
    assert (result.records_read, result.records_written, result.records_failed) == (10, 7, 3)
    assert spark.read.parquet(where("bad")).count() == 3


@pytest.mark.parametrize("write_mode, want", [(None, [0, 1]), ("append", [0, 0, 1, 1]), ("overwrite", [0, 1]), ("truncate", [0, 1])])
def test_write_modes_override_the_sync_mode(spark, where, write_mode, want):
    write_files(spark.range(2), where("in"))
    write_files(spark.range(2), where("out") + "/t")
    run(spark, spec(where("in"), where("out"), destination={"write_mode": write_mode}), raise_errors=True)
    assert [r[0] for r in rows(spark.read.parquet(where("out") + "/t"))] == want


@pytest.mark.parametrize(
    "sync_mode, write_mode",
    [("incremental", "overwrite"), ("incremental", "truncate"), ("append", "overwrite"), ("append", "upsert"), ("upsert", "append"), ("upsert", "replace")],
)
def test_write_modes_that_would_lose_or_double_rows_are_refused(spark, where, sync_mode, write_mode):
    write_files(spark.range(2), where("in"))
    write_files(spark.range(2), where("out") + "/t")
    target = {"write_mode": write_mode, "keys": ["id"], "order_by": ["id"]}
    result = run(spark, spec(where("in"), where("out"), sync_mode=sync_mode, cursor_field="id", destination=target))
    assert result.status == "failed" and "does not fit" in result.error
    assert spark.read.parquet(where("out") + "/t").count() == 2


def test_rows_without_a_cursor_value_are_appended_once(spark, where):
    store = StateStore(spark, where("state"))
    one = spec(where("in"), where("out"), sync_mode="incremental", cursor_field="c")
    write_files(spark.createDataFrame([(None,), (float("nan"),)], "c double"), where("in"))
    for late, total in ((None, 2), (None, 2), (1.0, 3), (None, 3)):
        if late:
            write_files(spark.createDataFrame([(late,)], "c double"), where("in"))
        run(spark, one, store, raise_errors=True)
        assert read_runs(spark, where("out") + "/t").count() == total


def test_a_mistyped_filter_fails_and_leaves_the_target(spark, where):
    write_files(spark.sql("SELECT 1L AS id, 'x' AS s"), where("in"))
    assert run(spark, spec(where("in"), where("out"))).status == "completed"
    for predicate in ("idd > 0", "id > '0'", "s < 1"):
        result = run(spark, spec(where("in"), where("out"), transform_config=chain(("filter_rows", {"predicate": predicate}))))
        assert result.status == "failed"
        assert spark.read.parquet(where("out") + "/t").count() == 1


def test_runs_and_plain_files_do_not_mix(spark, where):
    write_files(spark.range(3), where("in"))
    assert run(spark, spec(where("in"), where("out"), sync_mode="incremental", cursor_field="id")).status == "completed"
    assert "numbered runs" in run(spark, spec(where("in"), where("out"), sync_mode="append")).error
    assert run(spark, spec(where("in"), where("out"))).status == "completed"
    assert "numbered runs" in run(spark, spec(where("in"), where("out"), sync_mode="incremental", cursor_field="id")).error
    assert spark.read.parquet(where("out") + "/t").count() == 3


def test_lookback_on_dates_is_rounded_up():
    assert stepped_back(date(2024, 1, 10), 36 * 3600) == date(2024, 1, 8)
    assert stepped_back(date(2024, 1, 10), 3600) == date(2024, 1, 9)


def test_lookback_takes_late_rows(spark, where):
    store = StateStore(spark, where("state"))
    target = {"keys": ["id"], "order_by": ["at"]}
    one = spec(where("in"), where("out"), sync_mode="upsert", cursor_field="at", lookback=5, destination=target)
    for late in ([(1, 10), (2, 20)], [(3, 18), (4, 14), (2, 20)]):
        write_files(spark.createDataFrame(late, "id long, at long"), where("in"))
        run(spark, one, store, raise_errors=True)
    assert rows(spark.read.parquet(where("out") + "/t"), "id") == [(1,), (2,), (3,)]
    write_files(spark.createDataFrame([(7, 17)], "id long, at long"), where("in2"))
    moved = spec(where("in2"), where("out"), sync_mode="upsert", cursor_field="at", lookback=5, destination=target)
    run(spark, moved, store, raise_errors=True)
    assert store.load("n", "t").cursor_value == "20"  # a late row does not move the cursor back
    with pytest.raises(SpecError):
        spec(where("in"), where("out"), sync_mode="incremental", cursor_field="at", lookback=5)


def test_declared_constraints_stop_a_write(spark, where):
    write_files(spark.range(3), where("in"))
    keyed = {"constraints": {"not_null": ["id"], "primary_key": ["id"]}}
    one = spec(where("in"), where("out"), sync_mode="append", destination=keyed)
    assert run(spark, one).status == "completed"
    again = run(spark, one)
    assert again.status == "failed" and "primary_key(id): 3 rows" in again.error
    assert spark.read.parquet(where("out") + "/t").count() == 3
    assert run(spark, spec(where("in"), where("out"), destination=keyed)).status == "completed"


def test_cursor_with_a_document_filter(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "n long, s string")
    assert rows(after_cursor(df.where(mongo_predicate({"s": "a"})), "n", 1)) == [(2, "a")]


def test_upsert_spec(spark, where):
    write_files(spark.sql("SELECT 1L AS k, 'old' AS v UNION ALL SELECT 2L, 'old'"), where("out") + "/t")
    write_files(spark.sql("SELECT 2L AS k, 'new' AS v UNION ALL SELECT 3L, 'new'"), where("in"))
    one = spec(where("in"), where("out"), sync_mode="upsert", destination={"keys": ["k"], "order_by": ["v"]})
    assert run(spark, one, raise_errors=True).records_written == 2
    assert rows(spark.read.parquet(where("out") + "/t")) == [(1, "old"), (2, "new"), (3, "new")]
    assert run(spark, spec(where("in"), where("out"), sync_mode="upsert")).status == "failed"


@pytest.mark.parametrize("format", ["parquet", "jsonl", "csv", "json"])
def test_specs_move_every_format(spark, where, format):
    write_files(spark.sql("SELECT 1L AS a, 'x' AS b"), where("in"), format)
    source = {"type": "local_file", "file_path": where("in"), "format": format, "schema_ddl": "a long, b string"}
    one = RunSpec.from_dict({"name": "f", "source_config": source, "destination_config": {"type": "s3", "bucket": where("out"), "scheme": "", "prefix": "p", "stream": "s", "format": format}})
    assert run(spark, one, raise_errors=True).records_written == 1
    back = RunSpec.from_dict({"name": "f", "source_config": {"type": "s3", "bucket": where("out"), "scheme": "", "prefix": "p", "stream": "s", "format": format, "schema_ddl": "a long, b string"}, "destination_config": {"type": "singer", "file_path": where("log")}})
    assert rows(build(spark, back)) == [(1, "x")]
    assert run(spark, back, raise_errors=True).records_written == 1


def test_spec_shapes_and_errors():
    connections = {1: {"type": "local_file", "file_path": "/a", "batch_size": 5}, 2: {"type": "postgresql", "host": "h"}}
    one = RunSpec.from_dict(
        {"name": "n", "source_connection_id": 1, "destination_connection_id": 2, "source_config": {"file_path": "/b/x.parquet", "replication_key": "k"}, "destination_config": {"table": "t"}},
        connections,
    )
    assert one.source["file_path"] == "/b/x.parquet" and one.source["batch_size"] == 5 and one.cursor_field == "k"
    assert one.stream == "x" and one.sync_mode == "full_refresh"
    good = {"name": "n", "source_config": {"type": "local_file"}, "destination_config": {"type": "local_file"}}
    for bad in ({**good, "name": ""}, {**good, "schedule_cron": "* * *"}, {**good, "source_config": {"type": "fax"}}, {**good, "source_config": {"type": "s3", "batch_size": 0}}):
        with pytest.raises(SpecError):
            RunSpec.from_dict(bad)


def test_failed_runs_are_reported_and_logged(spark, where):
    absent = run(spark, spec(where("nothing"), where("out")))
    assert absent.status == "failed" and "PATH_NOT_FOUND" in absent.error
    write_files(spark.range(1), where("one"))
    result = run(spark, spec(where("one"), where("out"), transform_config=chain(("duckdb_sql_transformer", {"sql_query": "SELECT nope FROM data"}))))
    assert result.status == "failed" and "nope" in result.error
    log = RunLog(spark, where("log"))
    assert log.runs().count() == 0
    write_files(spark.range(3), where("in"))
    done = run(spark, spec(where("in"), where("out")))
    assert [log.record(result), log.record(done, "corr")] == [1, 2]
    assert rows(log.runs(), "run_number", "status", "total_loaded") == [(1, "failed", 0), (2, "completed", 3)]
    assert rows(log.operator_runs().where(F.col("correlation_id") == "corr"), "step", "operator_type") == [(0, "extract"), (1, "load")]


def test_specs_come_from_json(spark, where):
    write_files(spark.range(3), where("in"))
    text = json.dumps(
        {
            "name": "j",
            "source_config": {"type": "local_file", "file_path": where("in"), "table_name": "t"},
            "destination_config": {"type": "local_file", "file_path": where("out")},
            "transform_config": {"transformers": [{"type": "compute_expression", "config": {"field": "twice", "expression": "id * 2"}}]},
            "sync_mode": "full_refresh",
        }
    )
    run(spark, RunSpec.from_dict(json.loads(text)), raise_errors=True)
    assert rows(spark.read.parquet(where("out") + "/t")) == [(0, 0), (1, 2), (2, 4)]


def test_building_pushes_filters_into_the_scan(spark):
    one = spec(f"{SF}/lineitem.parquet", "/unused", transform_config=chain(("filter_rows", {"predicate": "l_quantity < 5"}), ("drop_fields", {"fields": ["l_tax"]})))
    text = plan(build(spark, one))
    assert "LessThan(l_quantity,5.0)" in text and "l_tax" not in text.split("ReadSchema")[1]


def test_rejects_are_replaced_with_the_rows(spark, where):
    write_files(spark.range(10), where("in"))
    target = {"quarantine": {"path": where("bad"), "checks": {"small": "id < 7"}}}
    for _ in range(2):
        run(spark, spec(where("in"), where("out"), destination=target), raise_errors=True)
    assert spark.read.parquet(where("bad")).count() == 3
    assert spark.read.parquet(where("out") + "/t").count() == 7


def test_snapshot_destinations(spark, where):
    write_files(spark.range(10), where("in"))
    target = {"layout": "snapshots", "quarantine": {"path": where("bad"), "checks": {"small": "id < 7"}}}
    for _ in range(2):
        result = run(spark, spec(where("in"), where("out"), destination=target), raise_errors=True)
    assert (result.records_written, result.records_failed) == (7, 3)
    assert rows(read_snapshot(spark, where("out") + "/t")) == [(i,) for i in range(7)]
    target = {"layout": "snapshots", "keys": ["id"], "order_by": ["id"]}
    run(spark, spec(where("in"), where("up"), sync_mode="upsert", cursor_field="id", destination=target), raise_errors=True)
    assert read_snapshot(spark, where("up") + "/t").count() == 10
    again = spec(where("up") + "/t", where("copy"))
    again.source["layout"] = "snapshots"
    run(spark, again, raise_errors=True)
    assert spark.read.parquet(where("copy") + "/t").count() == 10
    refused = {"layout": "snapshots", "partition_by": ["id"]}
    assert run(spark, spec(where("in"), where("no"), destination=refused)).status == "failed"


def test_rows_that_tie_with_the_cursor_arrive_once(spark, where):
    def arrive(*values):
        write_files(spark.createDataFrame(list(values), "at int, v string"), where("in"))

    store = StateStore(spark, where("state"))
    sync = spec(where("in"), where("out"), sync_mode="incremental", cursor_field="at", keep_ties=True)
    arrive((1, "a"), (2, "b"), (2, "b"), (2, None))
    run(spark, sync, store, raise_errors=True)
    arrive((2, "late"), (2, "b"), (1, "too late"))
    assert run(spark, sync, store, raise_errors=True).records_written == 2
    assert run(spark, sync, store, raise_errors=True).records_written == 0
    arrive((2, None), (3, "c"))
    run(spark, sync, store, raise_errors=True)
    arrive((2, "past"), (3, "c"))
    assert run(spark, sync, store, raise_errors=True).records_written == 1
    want = [(1, "a"), (2, "b"), (2, "b"), (2, "b"), (2, "late"), (2, None), (2, None), (3, "c"), (3, "c")]
    assert sorted([tuple(r) for r in read_runs(spark, where("out") + "/t").collect()], key=repr) == sorted(want, key=repr)
    with pytest.raises(SpecError):
        spec(where("in"), where("out"), sync_mode="upsert", cursor_field="at", keep_ties=True)

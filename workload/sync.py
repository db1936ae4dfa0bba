"""Cursor reads, saved state and sync modes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import sql_transform
from millrace.plans import RunSpec, StateStore, after_cursor, after_cursor_lenient, run
from millrace.session import work_path
from millrace.sinks import read_runs, write_files

from .registry import query, table

SPLIT = "o_orderdate < DATE'1998-01-01'"


@query("inc_strict", "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-30 00:00:00'")
def inc_strict(spark, sf):
    return after_cursor(table(spark, sf, "orders"), "o_orderdate", datetime(1998, 6, 30))


@query(
    "inc_lenient",
    """
    SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.quality > 0 OR l.quality IS NULL
    """,
)
def inc_lenient(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return after_cursor_lenient(labelled.select("doc_id", "quality"), "quality", 0)


@query(
    "inc_query",
    """
    SELECT o_custkey, MAX(o_orderdate) AS last_order, COUNT(*) AS orders FROM orders
    GROUP BY o_custkey HAVING MAX(o_orderdate) > TIMESTAMP '2001-07-01 00:00:00'
    """,
)
def inc_query(spark, sf):
    grouped = sql_transform(
        table(spark, sf, "orders"),
        "SELECT o_custkey, MAX(o_orderdate) AS last_order, COUNT(*) AS orders FROM data GROUP BY o_custkey",
    )
    return after_cursor(grouped, "last_order", datetime(2001, 7, 1))


def _spec(source: str, target: str, **more) -> RunSpec:
    destination = {"type": "local_file", "file_path": target, "table_name": "orders", **more.pop("destination", {})}
    return RunSpec.from_dict(
        {
            "name": "orders",
            "source_config": {"type": "local_file", "file_path": source, "table_name": "orders"},
            "destination_config": destination,
            **more,
        }
    )


@query("inc_two_runs", "SELECT * FROM orders")
def inc_two_runs(spark, sf):
    """The second run meets everything the first one saw and later rows; only the later ones are added."""
    orders = table(spark, sf, "orders")
    landing, target = work_path(spark, "landing"), work_path(spark, "target")
    store = StateStore(spark, work_path(spark, "state"))
    spec = _spec(landing, target, sync_mode="incremental", cursor_field="o_orderdate")
    write_files(orders.where(SPLIT), landing)
    run(spark, spec, store, raise_errors=True)
    write_files(orders.where(f"NOT {SPLIT}"), landing)
    run(spark, spec, store, raise_errors=True)
    return read_runs(spark, f"{target}/orders")


@query("inc_ties", "SELECT * FROM orders")
def inc_ties(spark, sf):
    """Rows of the greatest date arrive in two parts, the second after the first was read; a third run meets nothing new."""
    orders = table(spark, sf, "orders")
    last = orders.agg(F.max("o_orderdate")).first()[0]
    late = (F.col("o_orderdate") == F.lit(last)) & (F.col("o_orderkey") % 2 == 0)
    landing, target = work_path(spark, "landing"), work_path(spark, "target")
    store = StateStore(spark, work_path(spark, "state"))
    spec = _spec(landing, target, sync_mode="incremental", cursor_field="o_orderdate", keep_ties=True)
    write_files(orders.where(~late), landing)
    run(spark, spec, store, raise_errors=True)
    write_files(orders.where(late), landing)
    for _ in range(2):
        run(spark, spec, store, raise_errors=True)
    return read_runs(spark, f"{target}/orders")


@query("inc_null_cursor", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def inc_null_cursor(spark, sf):
    """Three runs over one source: rows without a cursor value are appended once."""
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality")
    landing, target = work_path(spark, "landing"), work_path(spark, "target")
    store = StateStore(spark, work_path(spark, "state"))
    write_files(labelled, landing)
    for _ in range(3):
        run(spark, _spec(landing, target, sync_mode="incremental", cursor_field="quality"), store, raise_errors=True)
    return read_runs(spark, f"{target}/orders")


@query("inc_layouts", "SELECT * FROM orders")
def inc_layouts(spark, sf):
    """An append between two incremental runs is refused and leaves the target as it was."""
    orders = table(spark, sf, "orders")
    landing, target = work_path(spark, "landing"), work_path(spark, "target")
    store = StateStore(spark, work_path(spark, "state"))
    spec = _spec(landing, target, sync_mode="incremental", cursor_field="o_orderdate")
    write_files(orders.where(SPLIT), landing)
    run(spark, spec, store, raise_errors=True)
    if run(spark, _spec(landing, target, sync_mode="append")).status != "failed":
        raise AssertionError("an append beside numbered runs was accepted")
    write_files(orders.where(f"NOT {SPLIT}"), landing)
    run(spark, spec, store, raise_errors=True)
    return read_runs(spark, f"{target}/orders")


@query("sync_full", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sync_full(spark, sf):
    """A second full refresh replaces the first."""
    target = work_path(spark, "target")
    chain = {"transformers": [{"type": "drop_fields", "config": {"fields": ["o_orderstatus", "o_orderdate", "o_orderpriority"]}}]}
    spec = _spec(f"{sf}/orders.parquet", target, transform_config=chain)
    for _ in range(2):
        run(spark, spec, metrics="written", raise_errors=True)
    return spark.read.parquet(f"{target}/orders")


@query("sync_append", "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders")
def sync_append(spark, sf):
    """Every append run adds the whole source again."""
    target = work_path(spark, "target")
    for _ in range(2):
        run(spark, _spec(f"{sf}/orders.parquet", target, sync_mode="append"), metrics="written", raise_errors=True)
    return spark.read.parquet(f"{target}/orders").select("o_orderkey", "o_orderstatus")


@query(
    "sync_upsert",
    """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= DATE '1997-01-01' THEN 'late' ELSE 'early' END AS seen, o_orderdate
    FROM orders
    """,
)
def sync_upsert(spark, sf):
    """Two keyed runs over overlapping sources: the later run's rows replace the earlier ones."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    target = work_path(spark, "target")
    for name, part in (("early", SPLIT), ("late", "o_orderdate >= DATE'1997-01-01'")):
        landing = work_path(spark, "landing")
        write_files(orders.where(part), landing)
        spec = _spec(
            landing,
            target,
            sync_mode="upsert",
            destination={"keys": ["o_orderkey"], "order_by": ["o_orderdate"]},
            transform_config={"transformers": [{"type": "add_constant", "config": {"field": "seen", "value": name}}]},
        )
        run(spark, spec, raise_errors=True)
    return spark.read.parquet(f"{target}/orders")

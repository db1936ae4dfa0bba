"""Sources: every format is written with a sink and read back, so the rows must come out unchanged."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.session import work_path
from millrace.sinks import write_files, write_singer
from millrace.sources import mongo_predicate, read_files, read_prefix, read_singer, record_count
from millrace.streaming import run_arriving_files
from millrace.sinks import read_runs

from .registry import query, table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


@query("src_parquet", "SELECT * FROM lineitem")
def src_parquet(spark, sf):
    return read_files(spark, f"{sf}/lineitem.parquet")


@query("src_csv", "SELECT * FROM documents")
def src_csv(spark, sf):
    documents = table(spark, sf, "documents")
    path = work_path(spark, "csv")
    write_files(documents, path, "csv")
    return read_files(spark, path, "csv", schema=documents.schema)


@query("src_json_array", "SELECT * FROM orders")
def src_json_array(spark, sf):
    orders = table(spark, sf, "orders")
    path = work_path(spark, "json")
    write_files(orders, path, "json", batch_size=5000)
    return read_files(spark, path, "json", schema=orders.schema)


@query("src_jsonl", "SELECT * FROM events")
def src_jsonl(spark, sf):
    events = table(spark, sf, "events")
    path = work_path(spark, "jsonl")
    write_files(events, path, "jsonl")
    return read_files(spark, path, "jsonl", schema=events.schema)


@query("src_glob", "SELECT * FROM conversations")
def src_glob(spark, sf):
    path = work_path(spark, "mixed")
    turns = table(spark, sf, "conversations")
    write_files(turns.where("role = 'user'"), path, "parquet")
    write_files(turns.where("role <> 'user'"), path, "parquet")
    write_files(turns, path, "jsonl")  # same directory, other extension: not matched
    return read_files(spark, path, "parquet", glob="*.parquet")


@query("src_prefix", "SELECT * FROM orders")
def src_prefix(spark, sf):
    bucket = work_path(spark, "bucket")
    orders = table(spark, sf, "orders")
    for status in ("F", "O", "P"):
        write_files(orders.where(F.col("o_orderstatus") == status), f"{bucket}/landing/orders/{status}/part", "parquet")
    return read_prefix(spark, bucket, "landing/", "orders", scheme="")


@query("src_singer", "SELECT * FROM conversations")
def src_singer(spark, sf):
    turns = table(spark, sf, "conversations")
    path = work_path(spark, "singer")
    write_singer(turns, path, "conversations", ["conv_id", "turn"])
    noise = turns.select(F.concat(F.lit('{"type": "RECORD", "stream": "conversations", "record": {"conv_id": '), "conv_id").alias("value"))
    noise.write.mode("append").text(f"{path}/1-records")  # cut-off lines
    return read_singer(spark, f"{path}/*", "conversations")


@query("src_document_filter", "SELECT * FROM events WHERE value > 5 AND event_type IN ('view', 'click') OR event_type = 'purchase' AND value <= 1")
def src_document_filter(spark, sf):
    wanted = {"$or": [{"value": {"$gt": 5}, "event_type": {"$in": ["view", "click"]}}, {"event_type": "purchase", "value": {"$lte": 1}}]}
    return table(spark, sf, "events").where(mongo_predicate(wanted))


@query(
    "record_count",
    " UNION ALL ".join(f"SELECT '{t}' AS stream, COUNT(*) AS row_count FROM {t}" for t in TABLES),
)
def counts(spark, sf):
    return record_count({t: table(spark, sf, t) for t in TABLES})


@query(
    "stream_arriving",
    "SELECT event_id, user_id, value * 2 AS doubled FROM events WHERE event_type <> 'error'",
)
def stream_arriving(spark, sf):
    events = table(spark, sf, "events")
    target = work_path(spark, "arrived")
    chain = {
        "transformers": [
            {"type": "filter_rows", "config": {"predicate": "event_type != 'error'"}},
            {"type": "compute_expression", "config": {"field": "doubled", "expression": "value * 2"}},
            {"type": "drop_fields", "config": {"fields": ["ts", "event_type", "value", "props"]}},
        ]
    }
    run_arriving_files(spark, f"{sf}/events*.parquet", events.schema, target, work_path(spark, "checkpoint"), chain)
    return read_runs(spark, target)

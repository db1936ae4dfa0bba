"""Sinks: what was written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.session import work_path
from millrace.sinks import (
    check_constraints,
    read_partitioned,
    read_snapshot,
    replace_files,
    replace_snapshot,
    truncate_files,
    upsert_files,
    upsert_snapshot,
    write_files,
    write_partitioned,
    write_singer,
    write_streams,
    write_with_quarantine,
)
from millrace.sources import read_files, read_singer

from .registry import query, table


@query("snk_parquet", "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def snk_parquet(spark, sf):
    lines = table(spark, sf, "lineitem")
    path = work_path(spark, "parquet")
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")
    write_files(lines.select("l_returnflag", "l_orderkey", "l_linenumber", net), path, compression="none")
    return spark.read.parquet(path)


@query("snk_csv", "SELECT * FROM conversations")
def snk_csv(spark, sf):
    turns = table(spark, sf, "conversations")
    path = work_path(spark, "csv")
    write_files(turns, path, "csv", sort_columns=True)
    ordered = turns.select(*sorted(turns.columns)).schema
    return read_files(spark, path, "csv", schema=ordered)


@query("snk_jsonl", "SELECT d.doc_id, d.lang, d.text, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def snk_jsonl(spark, sf):
    labels = table(spark, sf, "labels")
    labelled = table(spark, sf, "documents").join(labels, "doc_id", "left").select("doc_id", "lang", "text", "quality")
    path = work_path(spark, "jsonl")
    write_files(labelled, path, "jsonl")
    return read_files(spark, path, "jsonl", schema=labelled.schema)


@query("snk_json_array", "SELECT * FROM events")
def snk_json_array(spark, sf):
    events = table(spark, sf, "events")
    path = work_path(spark, "json")
    write_files(events, path, "json", batch_size=2500)
    return read_files(spark, path, "json", schema=events.schema)


@query("snk_multi_stream", "SELECT * FROM events")
def snk_multi_stream(spark, sf):
    events = table(spark, sf, "events")
    path = work_path(spark, "streams")
    write_streams(events.withColumn("_stream", F.col("event_type")), path)
    return spark.read.parquet(path).drop("_stream")


@query("snk_partitioned", "SELECT * FROM part")
def snk_partitioned(spark, sf):
    path = work_path(spark, "partitioned")
    write_partitioned(table(spark, sf, "part"), path, ["p_brand", "p_type"])
    return read_partitioned(spark, path)


_AWKWARD = "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '001' WHEN 2 THEN 'a b' ELSE 'a_b' END"


@query("snk_partition_values", f"SELECT p_partkey, {_AWKWARD} AS kind FROM part")
def snk_partition_values(spark, sf):
    """Values that directory names would change: NULL, digits, a space and what replaces it."""
    path = work_path(spark, "partitioned")
    write_partitioned(table(spark, sf, "part").selectExpr("p_partkey", f"{_AWKWARD} AS kind"), path, ["kind"])
    return read_partitioned(spark, path)


@query("snk_overwrite", "SELECT o_orderkey, o_totalprice / 2 AS o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def snk_overwrite(spark, sf):
    path = work_path(spark, "overwrite")
    write_files(table(spark, sf, "orders"), path)
    stored = spark.read.parquet(path)
    half = stored.where("o_orderstatus <> 'F'").select("o_orderkey", (F.col("o_totalprice") / 2).alias("o_totalprice"))
    replace_files(half, path)  # reads what it replaces
    return spark.read.parquet(path)


@query("snk_overwrite_snapshot", "SELECT o_orderkey, o_orderstatus, o_totalprice / 2 AS o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def snk_overwrite_snapshot(spark, sf):
    """A table of versions: the new rows read the old ones, and readers see either."""
    path = work_path(spark, "snapshots")
    replace_snapshot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    stored = read_snapshot(spark, path).where("o_orderstatus <> 'F'")
    replace_snapshot(stored.withColumn("o_totalprice", F.col("o_totalprice") / 2), path, keep_schema=True)
    return read_snapshot(spark, path)


@query("snk_json_partitioned", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snk_json_partitioned(spark, sf):
    """JSON arrays in one directory per region."""
    path = work_path(spark, "arrays")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    write_files(nations, path, "json", partition_by=["n_regionkey"], compression="gzip")
    return spark.read.schema(nations.schema).option("multiLine", True).json(path)


@query("snk_truncate", "SELECT c_custkey, c_name, c_nationkey, NULL::DOUBLE AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def snk_truncate(spark, sf):
    path = work_path(spark, "truncate")
    customers = table(spark, sf, "customer")
    write_files(customers, path)
    truncate_files(customers.where("c_mktsegment <> 'BUILDING'").drop("c_acctbal"), path)
    return spark.read.parquet(path)


UPSERT_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


@query(
    "snk_upsert",
    """
    WITH incoming AS (
      SELECT * EXCLUDE (n) FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                 ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS n
        FROM lineitem WHERE l_shipdate >= DATE '1999-01-01')
      WHERE n = 1)
    SELECT * FROM incoming
    UNION ALL
    SELECT * FROM lineitem l WHERE l_shipdate < DATE '1999-01-01'
      AND NOT EXISTS (SELECT 1 FROM incoming i WHERE i.l_orderkey = l.l_orderkey AND i.l_linenumber = l.l_linenumber)
    """,
)
def snk_upsert(spark, sf):
    lines = table(spark, sf, "lineitem")
    path, keys = work_path(spark, "upsert"), ["l_orderkey", "l_linenumber"]
    replace_snapshot(lines.where("l_shipdate < DATE'1999-01-01'"), path, keys)
    upsert_snapshot(lines.where("l_shipdate >= DATE'1999-01-01'"), path, keys, UPSERT_ORDER)
    return read_snapshot(spark, path)


@query(
    "snk_upsert_partitioned",
    """
    SELECT o_orderstatus, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
    FROM orders
    """,
)
def snk_upsert_partitioned(spark, sf):
    """Only the partition the incoming rows belong to is rewritten."""
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    path = work_path(spark, "upsert")
    write_files(orders, path, partition_by=["o_orderstatus"])
    raised = orders.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    upsert_files(raised, path, ["o_orderstatus", "o_orderkey"], ["o_totalprice"], partition_by=["o_orderstatus"])
    return spark.read.parquet(path)


@query("snk_singer", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def snk_singer(spark, sf):
    events = table(spark, sf, "events")
    path = work_path(spark, "singer")
    write_singer(events, path, "events", ["event_id"], state={"event_id": "done"})
    return read_singer(spark, f"{path}/*", "events", schema=events.schema)


@query(
    "snk_constraints",
    """
    SELECT 'not_null' AS "constraint", 'l_shipdate' AS columns, COUNT(*) FILTER (WHERE l_shipdate IS NULL) AS violations FROM lineitem
    UNION ALL SELECT 'not_null', 'l_orderkey', COUNT(*) FILTER (WHERE l_orderkey IS NULL) FROM lineitem
    UNION ALL SELECT 'not_null', 'l_linenumber', COUNT(*) FILTER (WHERE l_linenumber IS NULL) FROM lineitem
    UNION ALL SELECT 'primary_key', 'l_orderkey,l_linenumber', CAST(SUM(n - 1) AS BIGINT)
      FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    """,
)
def snk_constraints(spark, sf):
    return check_constraints(table(spark, sf, "lineitem"), ["l_shipdate"], ["l_orderkey", "l_linenumber"])


@query(
    "snk_quarantine",
    """
    SELECT d.doc_id, l.quality,
           CASE WHEN l.quality IS NULL AND d.n_chars < 200 THEN 'quality is null; long enough'
                WHEN l.quality IS NULL THEN 'quality is null' WHEN d.n_chars < 200 THEN 'long enough' END AS reason
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def snk_quarantine(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "n_chars", "quality")
    good, bad = work_path(spark, "good"), work_path(spark, "bad")
    write_with_quarantine(labelled, good, bad, not_null=["quality"], checks={"long enough": "n_chars >= 200"})
    accepted = spark.read.parquet(good).select("doc_id", "quality", F.lit(None).cast("string").alias("reason"))
    return accepted.unionByName(spark.read.parquet(bad).select("doc_id", "quality", F.col("_reject_reason").alias("reason")))

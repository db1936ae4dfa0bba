"""Run metrics and run-log questions. Orders stand in for jobs, their lines for operator runs, events for log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import runlog
from millrace.plans import RunSpec, run
from millrace.session import work_path

from .registry import query, table

CHAIN = [
    {"type": "filter_rows", "config": {"predicate": "l_quantity > 10"}},
    {"type": "compute_expression", "config": {"field": "net", "expression": "l_extendedprice * (1 - l_discount)"}},
    {"type": "filter_rows", "config": {"predicate": "net > 20000 and l_returnflag != 'N'"}},
]
_STEP1 = "SELECT * FROM lineitem WHERE l_quantity > 10"
_STEP3 = f"SELECT * FROM ({_STEP1}) WHERE l_extendedprice * (1 - l_discount) > 20000 AND l_returnflag <> 'N'"
_COUNTS = f"""
    (SELECT COUNT(*) FROM lineitem) AS n0, (SELECT COUNT(*) FROM ({_STEP1})) AS n1, (SELECT COUNT(*) FROM ({_STEP3})) AS n3,
    (SELECT COUNT(*) FROM ({_STEP3}) WHERE l_discount >= 0.02) AS n4
"""


def _run(spark, sf):
    target = work_path(spark, "run")
    spec = RunSpec.from_dict(
        {
            "name": "lines",
            "source_config": {"type": "local_file", "file_path": f"{sf}/lineitem.parquet", "table_name": "lines"},
            "destination_config": {
                "type": "local_file",
                "file_path": target,
                "quarantine": {"path": f"{target}/rejects", "checks": {"discounted": "l_discount >= 0.02"}},
            },
            "transform_config": {"transformers": CHAIN},
        }
    )
    return run(spark, spec, raise_errors=True)


@query(
    "run_metrics",
    f"""
    SELECT 'lines' AS name, 'completed' AS status, n0 AS records_read, n1 + n1 + n3 AS records_processed,
           n4 AS records_written, n3 - n4 AS records_failed
    FROM (SELECT {_COUNTS})
    """,
)
def run_metrics(spark, sf):
    return runlog.metrics_frame(spark, _run(spark, sf))


@query(
    "run_operator_metrics",
    f"""
    SELECT step, kind AS operator_type, name AS operator_name, i AS records_in, o AS records_out, f AS records_failed
    FROM (SELECT {_COUNTS}) c, LATERAL (VALUES
      (0, 'extract', 'local_file', n0, n0, 0::BIGINT), (1, 'transform', 'filter_rows', n0, n1, 0::BIGINT),
      (2, 'transform', 'compute_expression', n1, n1, 0::BIGINT), (3, 'transform', 'filter_rows', n1, n3, 0::BIGINT),
      (4, 'load', 'local_file', n3, n4, n3 - n4)) v(step, kind, name, i, o, f)
    """,
)
def run_operator_metrics(spark, sf):
    return runlog.operator_metrics_frame(spark, _run(spark, sf))


JOBS_SQL = """
    SELECT o_orderkey AS id, o_custkey AS pipeline_id,
           CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running'
                ELSE CASE o_orderpriority WHEN '5-LOW' THEN 'cancelled' WHEN '3-MEDIUM' THEN 'pending' ELSE 'success' END END AS status,
           CAST(o_orderkey AS VARCHAR) AS correlation_id,
           CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderdate END AS started_at, last_ship AS completed_at,
           coalesce(lines, 0) AS records_extracted, coalesce(kept, 0) AS records_loaded, o_orderpriority AS error_message,
           o_orderdate AS created_at
    FROM orders LEFT JOIN (
      SELECT l_orderkey, MAX(l_shipdate) AS last_ship, COUNT(*) AS lines, COUNT(*) FILTER (WHERE l_returnflag = 'N') AS kept
      FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey
"""


def _jobs(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("completed_at"),
        F.count("*").alias("lines"),
        F.count_if(F.col("l_returnflag") == "N").alias("kept"),
    )
    priority = F.col("o_orderpriority")
    ended = F.when(priority == "5-LOW", "cancelled").when(priority == "3-MEDIUM", "pending").otherwise("success")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise(ended)
    orders = table(spark, sf, "orders")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("pipeline_id"),
        status.alias("status"),
        F.col("o_orderkey").cast("string").alias("correlation_id"),
        F.when(priority != "3-MEDIUM", F.col("o_orderdate")).alias("started_at"),
        "completed_at",
        F.coalesce("lines", F.lit(0)).alias("records_extracted"),
        F.coalesce("kept", F.lit(0)).alias("records_loaded"),
        priority.alias("error_message"),
        F.col("o_orderdate").alias("created_at"),
    )


@query(
    "job_summary",
    f"""
    SELECT COUNT(*) AS total_jobs, COUNT(*) FILTER (WHERE status = 'pending') AS pending_jobs,
           COUNT(*) FILTER (WHERE status = 'running') AS running_jobs, COUNT(*) FILTER (WHERE status = 'success') AS successful_jobs,
           COUNT(*) FILTER (WHERE status = 'failed') AS failed_jobs, COUNT(*) FILTER (WHERE status = 'cancelled') AS cancelled_jobs,
           CAST(SUM(records_extracted) AS BIGINT) AS total_records_extracted, CAST(SUM(records_loaded) AS BIGINT) AS total_records_loaded
    FROM ({JOBS_SQL})
    """,
)
def job_summary(spark, sf):
    return runlog.job_summary(_jobs(spark, sf))


@query(
    "job_history",
    f"""
    SELECT id, pipeline_id, status, created_at FROM ({JOBS_SQL}) WHERE status = 'failed'
    ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20
    """,
)
def job_history(spark, sf):
    jobs = _jobs(spark, sf).select("id", "pipeline_id", "status", "created_at")
    return runlog.job_history(jobs, status="failed", skip=20, limit=50)


@query(
    "job_durations",
    f"""
    SELECT id, status, CASE WHEN status IN ('success', 'failed', 'cancelled')
                            THEN epoch_us(completed_at - started_at) / 1e6 END AS duration_seconds
    FROM ({JOBS_SQL})
    """,
)
def job_durations(spark, sf):
    return runlog.with_durations(_jobs(spark, sf)).select("id", "status", "duration_seconds")


@query(
    "trace_by_correlation",
    """
    SELECT correlation_id, COUNT(*) FILTER (WHERE kind = 'job') AS jobs, COUNT(*) FILTER (WHERE kind = 'operator_run') AS operator_runs,
           COUNT(*) FILTER (WHERE kind = 'job_log') AS job_logs
    FROM (SELECT CAST(o_orderkey AS VARCHAR) AS correlation_id, 'job' AS kind FROM orders
          UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'operator_run' FROM lineitem
          UNION ALL SELECT CAST(user_id AS VARCHAR), 'job_log' FROM events)
    GROUP BY correlation_id
    """,
)
def trace_by_correlation(spark, sf):
    logs = {
        "job": table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("correlation_id"), "o_orderstatus"),
        "operator_run": table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("correlation_id"), "l_linenumber"),
        "job_log": table(spark, sf, "events").select(F.col("user_id").cast("string").alias("correlation_id"), "props"),
    }
    return runlog.trace_counts(logs)


@query(
    "job_logs",
    """
    SELECT event_id AS id, user_id AS job_id, upper(event_type) AS level, props AS message, ts AS timestamp FROM events
    WHERE upper(event_type) = 'ERROR' ORDER BY ts, event_id LIMIT 200
    """,
)
def job_logs(spark, sf):
    logs = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("job_id"),
        F.upper("event_type").alias("level"),
        F.col("props").alias("message"),
        F.col("ts").alias("timestamp"),
    )
    return runlog.job_logs(logs, level="error", limit=200)


RULES = [
    {"id": 1, "alert_type": "job_failure", "delivery_method": "email", "recipient": "ops@example.com", "enabled": True},
    {"id": 2, "alert_type": "job_failure", "delivery_method": "slack", "recipient": "#data", "enabled": True},
    {"id": 3, "alert_type": "job_failure", "delivery_method": "webhook", "recipient": "off", "enabled": False},
    {"id": 4, "alert_type": "custom_metric_threshold", "delivery_method": "email", "recipient": "x", "enabled": True},
]


@query(
    "failure_alerts",
    f"""
    SELECT r.id AS alert_config_id,
           'Job ' || j.id || ' for Pipeline ' || j.pipeline_id || ' failed: ' || coalesce(j.error_message, 'None') AS message,
           'error' AS level, 'pending' AS status, j.id AS job_id, j.pipeline_id, r.delivery_method, r.recipient
    FROM ({JOBS_SQL}) j CROSS JOIN (VALUES (1::BIGINT, 'email', 'ops@example.com'), (2::BIGINT, 'slack', '#data')) r(id, delivery_method, recipient)
    WHERE j.status = 'failed'
    """,
)
def failure_alerts(spark, sf):
    return runlog.failure_alerts(_jobs(spark, sf), RULES)


@query(
    "alert_list",
    """
    SELECT event_id AS id, user_id AS pipeline_id, 'error' AS level, 'pending' AS status, ts AS timestamp FROM events
    WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100
    """,
)
def alert_list(spark, sf):
    kind = F.col("event_type")
    alerts = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("pipeline_id"),
        F.when(kind == "error", "error").otherwise("info").alias("level"),
        F.lit("pending").alias("status"),
        F.col("ts").alias("timestamp"),
    )
    return runlog.alert_list(alerts, status="pending", level="error", limit=100)


@query(
    "run_number",
    """
    SELECT c_custkey AS pipeline_id, CAST(coalesce(MAX(o_orderkey), 0) + 1 AS BIGINT) AS next_run_number
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
    """,
)
def run_number(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("pipeline_id"), F.col("o_orderkey").alias("run_number"))
    return runlog.next_run_numbers(table(spark, sf, "customer").select(F.col("c_custkey").alias("pipeline_id")), runs)

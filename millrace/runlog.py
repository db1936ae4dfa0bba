"""Run bookkeeping tables and the questions asked of them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .columns import col, seconds_between
from .errors import SpecError
from .plans.run import OperatorMetrics, RunResult
from .session import local_frame, path_exists

# Job statuses, and the ones that end a job.
JOB_STATUSES = ("pending", "running", "success", "failed", "cancelled")
ENDED = ("success", "failed", "cancelled")

RUNS = (
    "run_id string, pipeline string, run_number bigint, correlation_id string, status string, "
    "total_extracted bigint, total_transformed bigint, total_loaded bigint, total_failed bigint, "
    "started_at timestamp, completed_at timestamp, duration_seconds double, error_message string"
)
OPERATOR_RUNS = (
    "run_id string, correlation_id string, operator_type string, operator_name string, step int, "
    "records_in bigint, records_out bigint, records_failed bigint"
)
_ALERT = ("alert_config_id", "job_id", "pipeline_id", "level", "status", "message", "delivery_method", "recipient")
# Fixed value: what a run's outcome is called as a job.
JOB_STATUS = {"completed": "success", "failed": "failed"}
JOBS = (
    "id bigint, pipeline_id bigint, pipeline string, run_id string, correlation_id string, status string, "
    "records_extracted bigint, records_transformed bigint, records_loaded bigint, records_failed bigint, error_message string, "
    "created_at timestamp, started_at timestamp, completed_at timestamp"
)
JOB_LOGS = "id bigint, job_id bigint, correlation_id string, level string, message string, timestamp timestamp"
OPERATOR_LOGS = (
    "id bigint, job_id bigint, correlation_id string, operator_type string, operator_name string, level string, message string, timestamp timestamp"
)
ALERTS = (
    "id bigint, alert_config_id bigint, job_id bigint, pipeline_id bigint, level string, status string, message string, "
    "delivery_method string, recipient string, timestamp timestamp"
)


def _counts(operator: OperatorMetrics) -> tuple[int, int, int]:
    return operator.records_in, operator.records_out, operator.records_failed


class RunLog:
    """Runs and operator runs as small files below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        if not path_exists(self.spark, path):
            return local_frame(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(path)

    def runs(self) -> DataFrame:
        return self._table("runs", RUNS)

    def operator_runs(self) -> DataFrame:
        return self._table("operator_runs", OPERATOR_RUNS)

    def jobs(self) -> DataFrame:
        """Recorded runs as jobs, for ``job_summary``, ``job_history``, ``with_durations`` and ``failure_alerts``."""
        return self._table("jobs", JOBS)

    def job_logs(self) -> DataFrame:
        return self._table("job_logs", JOB_LOGS)

    def operator_logs(self) -> DataFrame:
        return self._table("operator_logs", OPERATOR_LOGS)

    def alerts(self) -> DataFrame:
        return self._table("alerts", ALERTS)

    def tables(self) -> dict[str, DataFrame]:
        """What ``trace`` and ``trace_counts`` look through."""
        return dict(zip(TRACE_KINDS, (self.jobs(), self.runs(), self.operator_runs(), self.job_logs(), self.operator_logs())))

    def _append(self, name: str, rows: Sequence[tuple], schema: str) -> None:
        if rows:
            local_frame(self.spark, rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _next_id(self, table: DataFrame) -> int:
        return (table.agg(F.max("id")).first()[0] or 0) + 1

    def record_job(self, result: RunResult, pipeline_id: int, correlation_id: str | None = None, rules: Sequence[Mapping[str, object]] = ()) -> int:
        """Record a run as a job too: its lines of log, those of its operators, and an alert for each rule if it failed.

        Returns the job's id. One job after the other: ids are counted on.
        """
        correlation = correlation_id or result.run_id
        self.record(result, correlation)
        job = self._next_id(self.jobs())
        status = JOB_STATUS[result.status]
        counts = (result.records_read, result.records_processed, result.records_written, result.records_failed)
        row = (job, pipeline_id, result.name, result.run_id, correlation, status, *counts, result.error, result.started_at, result.started_at, result.completed_at)
        ended = ("ERROR", f"Job {job} failed: {result.error}") if result.error else ("INFO", f"Job {job} wrote {result.records_written} rows, {result.records_failed} failed")
        lines = [("INFO", f"Job {job} started", result.started_at), (*ended, result.completed_at)]
        first = self._next_id(self.job_logs())
        self._append("job_logs", [(first + i, job, correlation, level, text, at) for i, (level, text, at) in enumerate(lines)], JOB_LOGS)
        first = self._next_id(self.operator_logs())
        steps = [
            (first + i, job, correlation, o.operator_type, o.operator_name, "WARNING" if o.records_failed else "INFO",
             f"{o.records_in} rows in, {o.records_out} out, {o.records_failed} failed", result.completed_at)
            for i, o in enumerate(result.operators)
        ]
        self._append("operator_logs", steps, OPERATOR_LOGS)
        if status == "failed" and rules:
            raised = failure_alerts(local_frame(self.spark, [row], JOBS), rules).collect()  # one per rule
            first = self._next_id(self.alerts())
            self._append("alerts", [(first + i, *[a[c] for c in _ALERT], result.completed_at) for i, a in enumerate(raised)], ALERTS)
        self._append("jobs", [row], JOBS)  # last: a job that is there has its log
        return job

    def record(self, result: RunResult, correlation_id: str | None = None) -> int:
        """Append a run and its operators; returns its number within the pipeline."""
        mine = self.runs().where(col("pipeline") == result.name)
        number = mine.agg(next_run_number(F.col("run_number"))).first()[0]
        correlation = correlation_id or result.run_id
        run = (
            result.run_id, result.name, number, correlation, result.status, result.records_read,
            result.records_processed, result.records_written, result.records_failed, result.started_at,
            result.completed_at, result.duration_seconds, result.error,
        )
        operators = [
            (result.run_id, correlation, o.operator_type, o.operator_name, i, *_counts(o))
            for i, o in enumerate(result.operators)
        ]
        self._append("runs", [run], RUNS)
        self._append("operator_runs", operators, OPERATOR_RUNS)
        return number


def metrics_frame(spark: SparkSession, result: RunResult) -> DataFrame:
    """The metrics of one run as a row."""
    counts = (result.records_read, result.records_processed, result.records_written, result.records_failed)
    row = (result.name, result.status, *counts)
    schema = (
        "name string, status string, records_read bigint, records_processed bigint, records_written bigint, "
        "records_failed bigint"
    )
    return local_frame(spark, [row], schema)


def operator_metrics_frame(spark: SparkSession, result: RunResult) -> DataFrame:
    """The metrics of each operator of one run, in order."""
    rows = [(i, o.operator_type, o.operator_name, *_counts(o)) for i, o in enumerate(result.operators)]
    schema = (
        "step int, operator_type string, operator_name string, records_in bigint, records_out bigint, "
        "records_failed bigint"
    )
    return local_frame(spark, rows, schema)


def job_summary(jobs: DataFrame) -> DataFrame:
    """Jobs in all and by status, and the rows they extracted and loaded; zeros when there are none."""
    names = {"success": "successful_jobs"}
    by_status = [F.count_if(col("status") == s).alias(names.get(s, f"{s}_jobs")) for s in JOB_STATUSES]
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        *by_status,
        F.coalesce(F.sum("records_extracted"), F.lit(0)).alias("total_records_extracted"),
        F.coalesce(F.sum("records_loaded"), F.lit(0)).alias("total_records_loaded"),
    )


def _page(df: DataFrame, order: Sequence[Column], skip: int, limit: int | None) -> DataFrame:
    df = df.orderBy(*order)
    if skip:
        df = df.offset(skip)
    return df.limit(limit) if limit is not None else df


def _where_equal(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.where(col(name) == value)
    return df


def job_history(
    jobs: DataFrame,
    pipeline_id: int | None = None,
    status: str | None = None,
    correlation_id: str | None = None,
    skip: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """A page of jobs, newest first; of jobs created together the one with the greater id first."""
    found = _where_equal(jobs, {"pipeline_id": pipeline_id, "status": status, "correlation_id": correlation_id})
    return _page(found, [F.col("created_at").desc_nulls_last(), F.col("id").desc()], skip, limit)


def with_durations(jobs: DataFrame) -> DataFrame:
    """``duration_seconds`` from start and end, for jobs that have ended and were started."""
    seconds = seconds_between(F.col("started_at"), F.col("completed_at"))
    return jobs.withColumn("duration_seconds", F.when(F.col("status").isin(*ENDED), seconds))


# The tables a correlation id runs through.
TRACE_KINDS = ("job", "pipeline_run", "operator_run", "job_log", "operator_log")


def trace(logs: Mapping[str, DataFrame], correlation_id: str | None = None) -> DataFrame:
    """Everything under one correlation id (or all of them) in the given tables, with a ``kind`` column.

    Columns a table lacks are NULL. The filter reaches each table's scan.
    """
    unknown = set(logs) - set(TRACE_KINDS)
    if unknown:
        raise SpecError(f"unknown trace kinds {', '.join(sorted(unknown))}")
    parts = [_where_equal(df, {"correlation_id": correlation_id}).withColumn("kind", F.lit(kind)) for kind, df in logs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def trace_counts(logs: Mapping[str, DataFrame], correlation_id: str | None = None) -> DataFrame:
    """Entries of each kind per correlation id. Partial counts are taken before the shuffle."""
    slim = {kind: df.select("correlation_id") for kind, df in logs.items()}
    counts = [F.count_if(F.col("kind") == kind).alias(f"{kind}s") for kind in logs]
    return trace(slim, correlation_id).groupBy("correlation_id").agg(*counts)


def job_logs(logs: DataFrame, job_id: int | None = None, level: str | None = None, limit: int | None = None) -> DataFrame:
    """Log lines, oldest first. The wanted level is compared in upper case."""
    found = _where_equal(logs, {"job_id": job_id, "level": level.upper() if level else None})
    return _page(found, [F.col("timestamp").asc_nulls_last(), F.col("id").asc()], 0, limit)


def failure_alerts(jobs: DataFrame, rules: Sequence[Mapping[str, object]]) -> DataFrame:
    """An alert for every failed job and every enabled job-failure rule.

    Rules are configuration (``id``, ``alert_type``, ``delivery_method``, ``recipient``, ``enabled``), so they travel
    inside the plan and each failed job expands in place: no join, no shuffle.
    """
    wanted = [r for r in rules if r.get("enabled", True) and r.get("alert_type") == "job_failure"]
    rule_type = T.ArrayType(T.StructType().add("id", T.LongType()).add("delivery_method", "string").add("recipient", "string"))
    listed = [{k: r[k] for k in ("id", "delivery_method", "recipient")} for r in wanted]
    rule = F.explode(F.from_json(F.lit(json.dumps(listed)), rule_type))
    failed = jobs.where(F.col("status") == "failed").select("id", "pipeline_id", "error_message", rule.alias("rule"))
    message = F.concat(
        F.lit("Job "), F.col("id"), F.lit(" for Pipeline "), F.col("pipeline_id"), F.lit(" failed: "),
        F.coalesce(F.col("error_message"), F.lit("None")),
    )
    return failed.select(
        F.col("rule.id").alias("alert_config_id"),
        message.alias("message"),
        F.lit("error").alias("level"),
        F.lit("pending").alias("status"),
        F.col("id").alias("job_id"),
        "pipeline_id",
        F.col("rule.delivery_method").alias("delivery_method"),
        F.col("rule.recipient").alias("recipient"),
    )


def alert_list(
    alerts: DataFrame,
    status: str | None = None,
    level: str | None = None,
    pipeline_id: int | None = None,
    job_id: int | None = None,
    skip: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """A page of alerts, newest first."""
    found = _where_equal(alerts, {"status": status, "level": level, "pipeline_id": pipeline_id, "job_id": job_id})
    return _page(found, [F.col("timestamp").desc_nulls_last(), F.col("id").desc()], skip, limit)


def next_run_number(run_number: Column) -> Column:
    """Aggregate: one more than the greatest number so far, 1 for the first run."""
    return (F.coalesce(F.max(run_number), F.lit(0)) + 1).alias("next_run_number")


def next_run_numbers(pipelines: DataFrame, runs: DataFrame) -> DataFrame:
    """(pipeline_id, next_run_number) of every pipeline, with or without runs.

    Runs are reduced to their maximum per pipeline before the join.
    """
    last = runs.groupBy("pipeline_id").agg(F.max("run_number").alias("last"))
    return pipelines.select("pipeline_id").join(last, "pipeline_id", "left").select(
        "pipeline_id", (F.coalesce(F.col("last"), F.lit(0)) + 1).alias("next_run_number")
    )

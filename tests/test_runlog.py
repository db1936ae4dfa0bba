from datetime import datetime

import pytest
from conftest import plan, rows

from millrace import runlog
from millrace.errors import SpecError

JOBS = "id long, pipeline_id long, status string, correlation_id string, started_at timestamp_ntz, completed_at timestamp_ntz, records_extracted long, records_loaded long, error_message string, created_at timestamp_ntz"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1, 500000)


@pytest.fixture(scope="module")
def jobs(spark):
    data = [
        (1, 10, "success", "c1", T0, T1, 5, 4, None, T0),
        (2, 10, "failed", "c2", T0, T1, 3, 0, "boom", T1),
        (3, 11, "failed", "c3", None, T1, None, None, None, T1),
        (4, 11, "running", "c4", T0, None, 0, 0, None, None),
        (5, 11, "pending", "c1", None, None, 0, 0, None, T0),
        (6, 11, "cancelled", "c6", T0, T1, 0, 0, None, T0),
    ]
    return spark.createDataFrame(data, JOBS)


def test_summary(jobs):
    got = runlog.job_summary(jobs).first().asDict()
    assert got == {
        "total_jobs": 6, "pending_jobs": 1, "running_jobs": 1, "successful_jobs": 1, "failed_jobs": 2, "cancelled_jobs": 1,
        "total_records_extracted": 8, "total_records_loaded": 4,
    }
    assert set(runlog.job_summary(jobs.limit(0)).first()) == {0}


def test_history(jobs):
    assert [r["id"] for r in runlog.job_history(jobs).collect()] == [3, 2, 6, 5, 1, 4]
    assert [r["id"] for r in runlog.job_history(jobs, pipeline_id=11, skip=1, limit=2).collect()] == [6, 5]
    assert [r["id"] for r in runlog.job_history(jobs, status="failed", limit=None).collect()] == [3, 2]
    assert [r["id"] for r in runlog.job_history(jobs, correlation_id="c1").collect()] == [5, 1]
    assert "TakeOrderedAndProject" in plan(runlog.job_history(jobs, limit=5))


def test_durations(jobs):
    got = dict(rows(runlog.with_durations(jobs), "id", "duration_seconds"))
    assert got == {1: 1.5, 2: 1.5, 3: None, 4: None, 5: None, 6: 1.5}


def test_trace(spark, jobs):
    logs = {"job": jobs.select("id", "correlation_id"), "job_log": spark.createDataFrame([("c1", "m"), ("c1", "n"), ("zz", "o")], "correlation_id string, message string")}
    assert rows(runlog.trace(logs, "c1"), "kind", "id", "message") == [("job", 1, None), ("job", 5, None), ("job_log", None, "m"), ("job_log", None, "n")]
    got = {r["correlation_id"]: (r["jobs"], r["job_logs"]) for r in runlog.trace_counts(logs).collect()}
    assert got["c1"] == (2, 2) and got["zz"] == (0, 1)
    with pytest.raises(SpecError):
        runlog.trace({"mail": jobs})


def test_logs(spark):
    data = [(1, 7, "ERROR", T1), (2, 7, "INFO", T0), (3, 8, "ERROR", T0), (4, 7, "ERROR", T0)]
    logs = spark.createDataFrame(data, "id long, job_id long, level string, timestamp timestamp_ntz")
    assert [r["id"] for r in runlog.job_logs(logs, 7, "error").collect()] == [4, 1]
    assert [r["id"] for r in runlog.job_logs(logs, limit=2).collect()] == [2, 3]


def test_failure_alerts(jobs):
    rules = [
        {"id": 1, "alert_type": "job_failure", "delivery_method": "email", "recipient": "o'x", "enabled": True},
        {"id": 2, "alert_type": "job_failure", "delivery_method": "slack", "recipient": "c", "enabled": False},
        {"id": 3, "alert_type": "pipeline_status_change", "delivery_method": "email", "recipient": "c", "enabled": True},
    ]
    alerts = runlog.failure_alerts(jobs, rules)
    assert rows(alerts, "job_id", "message", "recipient") == [
        (2, "Job 2 for Pipeline 10 failed: boom", "o'x"),
        (3, "Job 3 for Pipeline 11 failed: None", "o'x"),
    ]
    assert "Join" not in plan(alerts) and "Exchange" not in plan(alerts)
    assert runlog.failure_alerts(jobs, []).count() == 0


def test_alert_pages(spark):
    alerts = spark.createDataFrame([(1, "error", "pending", 5, T0), (2, "info", "sent", 5, T1), (3, "error", "sent", 6, T1)], "id long, level string, status string, pipeline_id long, timestamp timestamp_ntz")
    assert [r["id"] for r in runlog.alert_list(alerts).collect()] == [3, 2, 1]
    assert [r["id"] for r in runlog.alert_list(alerts, level="error", pipeline_id=5).collect()] == [1]


def test_run_numbers(spark):
    pipelines = spark.createDataFrame([(1,), (2,)], "pipeline_id long")
    runs = spark.createDataFrame([(1, 3), (1, 7)], "pipeline_id long, run_number long")
    assert rows(runlog.next_run_numbers(pipelines, runs)) == [(1, 8), (2, 1)]


def test_jobs_of_runs_answer_the_questions(spark, where):
    """A run that succeeds and one that fails, read back through summary, trace, logs and alerts."""
    from millrace.plans import RunSpec, run
    from millrace.sinks import write_files

    write_files(spark.range(10), where("in"))
    log = runlog.RunLog(spark, where("log"))
    assert log.jobs().count() == 0
    rules = [{"id": 4, "alert_type": "job_failure", "delivery_method": "email", "recipient": "a@b"}, {"id": 5, "alert_type": "job_failure", "enabled": False}]
    source = {"type": "local_file", "file_path": where("in"), "table_name": "t"}
    target = {"type": "local_file", "file_path": where("out"), "table_name": "t", "quarantine": {"path": where("bad"), "checks": {"small": "id < 7"}}}
    good = RunSpec.from_dict({"name": "p", "source_config": source, "destination_config": target})
    bad = RunSpec.from_dict({"name": "p", "source_config": {**source, "file_path": where("absent")}, "destination_config": target})
    assert log.record_job(run(spark, good), 9, "c1", rules) == 1
    assert log.record_job(run(spark, bad), 9, "c2", rules) == 2
    summary = runlog.job_summary(log.jobs()).first()
    assert (summary.total_jobs, summary.successful_jobs, summary.failed_jobs) == (2, 1, 1)
    assert (summary.total_records_extracted, summary.total_records_loaded) == (10, 7)
    assert [r.id for r in runlog.job_history(log.jobs()).collect()] == [2, 1]
    assert all(r.duration_seconds >= 0 for r in runlog.with_durations(log.jobs()).collect())
    counts = {r.correlation_id: r for r in runlog.trace_counts(log.tables()).collect()}
    assert (counts["c1"].jobs, counts["c1"].pipeline_runs, counts["c1"].operator_runs, counts["c1"].job_logs, counts["c1"].operator_logs) == (1, 1, 2, 2, 2)
    assert counts["c2"].job_logs == 2 and counts["c2"].operator_runs == 0
    assert [r.level for r in runlog.job_logs(log.job_logs(), 2).collect()] == ["INFO", "ERROR"]
    assert rows(log.alerts(), "id", "job_id", "alert_config_id", "recipient", "status") == [(1, 2, 4, "a@b", "pending")]
    assert log.alerts().first().message.startswith("Job 2 for Pipeline 9 failed: ")
    assert runlog.failure_alerts(log.jobs(), rules).count() == 1
    assert [r.job_id for r in runlog.alert_list(log.alerts(), pipeline_id=9).collect()] == [2]

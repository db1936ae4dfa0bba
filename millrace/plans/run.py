"""Building the plan of a spec and running it, with counts taken in the same pass."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..columns import col
from ..errors import SpecError
from ..observe import FooterCount, Watch
from ..operators.registry import apply_step, resolve_chain
from ..session import delete_path, path_exists, staged
from ..sinks.checks import require_constraints, split_once
from ..sinks.files import layouts, replace_files, truncate_files, write_files, write_run
from ..sinks.jdbc import write_jdbc
from ..sinks.singer import write_singer
from ..sinks.snapshots import append_snapshot, read_snapshot, replace_snapshot, upsert_snapshot
from ..sinks.upsert import upsert_files
from ..sinks.vendor import write_vendor
from ..sources.files import prefix_path, read_files, read_prefix, s3_options
from ..sources.jdbc import read_jdbc, stream_name
from ..sources.singer import read_singer
from ..sources.vendor import read_vendor
from .incremental import (
    State,
    StateStore,
    Ties,
    after_cursor,
    after_cursor_lenient,
    next_cursor,
    parse_cursor,
    stepped_back,
    sync_plan,
    with_cursor,
    write_mode_of,
)
from .spec import DATABASES, VENDORS, RunSpec


@dataclass(frozen=True)
class OperatorMetrics:
    """Rows into and out of one step of a run."""

    operator_type: str
    operator_name: str
    records_in: int
    records_out: int
    records_failed: int = 0


@dataclass(frozen=True)
class RunResult:
    """Outcome of a run. ``records_processed`` adds up the outputs of all transforms."""

    run_id: str
    name: str
    status: str
    started_at: datetime
    completed_at: datetime
    records_read: int = 0
    records_processed: int = 0
    records_written: int = 0
    records_failed: int = 0
    cursor_value: str | None = None
    error: str | None = None
    operators: list[OperatorMetrics] = field(default_factory=list)

    @property
    def duration_seconds(self) -> float:
        return (self.completed_at - self.started_at).total_seconds()


def read_source(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """The DataFrame a source config describes."""
    kind = config["type"]
    if kind in DATABASES:
        return read_jdbc(spark, config)
    if kind in VENDORS:
        return read_vendor(spark, config)
    if kind == "local_file" and config.get("layout") == "snapshots":
        return read_snapshot(spark, config["file_path"], config.get("version"))
    if kind == "local_file":
        return read_files(
            spark,
            config["file_path"],
            config.get("format", "parquet"),
            glob=config.get("glob_pattern") or "*",
            schema=config.get("schema_ddl"),
            options=config.get("options"),
            skip_bad=bool(config.get("skip_bad")),
            merge_schema=bool(config.get("merge_schema")),
            missing_ok=bool(config.get("missing_ok")),
        )
    if kind == "s3":
        return read_prefix(
            spark,
            config["bucket"],
            config.get("prefix"),
            stream_name(config),
            config.get("format", "parquet"),
            glob=config.get("glob_pattern") or "*",
            schema=config.get("schema_ddl"),
            scheme=config.get("scheme", "s3a://"),
            credentials=config,
            options=config.get("options"),
            skip_bad=bool(config.get("skip_bad")),
            merge_schema=bool(config.get("merge_schema")),
            missing_ok=bool(config.get("missing_ok")),
        )
    glob = config.get("glob_pattern") or "*"
    return read_singer(spark, config["file_path"], stream_name(config), config.get("schema_ddl"), glob)


def from_cursor(df: DataFrame, spec: RunSpec, state: State | None) -> DataFrame:
    """The part of a source the saved state has not covered yet.

    Databases and warehouses compare strictly; files and object stores keep rows that cannot be compared. Appending
    those on every run would double them, so an incremental sync takes rows without a cursor value on its first run
    only; use upsert where such rows may arrive later. A custom query is filtered on its result.
    """
    uses_cursor, _ = sync_plan(spec.sync_mode, spec.cursor_field)
    if uses_cursor and spec.cursor_field not in df.columns:
        raise SpecError(f"cursor_field {spec.cursor_field!r} is not a column of the source")
    appends = spec.sync_mode == "incremental"
    if uses_cursor and appends and state is not None and state.run and state.cursor_value is None:
        return with_cursor(df, spec.cursor_field)
    if not uses_cursor or state is None or state.cursor_value is None:
        return df
    last = stepped_back(parse_cursor(state.cursor_value, df.schema[spec.cursor_field].dataType), spec.lookback)
    strict = appends or spec.source["type"] in (*DATABASES, *VENDORS)
    return (after_cursor if strict else after_cursor_lenient)(df, spec.cursor_field, last)


def build(
    spark: SparkSession,
    spec: RunSpec,
    state: State | None = None,
    saved: Mapping[Any, Mapping[str, Any]] | None = None,
) -> DataFrame:
    """Lazy plan of a spec: source, cursor filter, transforms. Filters and columns reach the scan."""
    df = from_cursor(read_source(spark, spec.source), spec, state)
    for name, config in resolve_chain(spec.transform, saved):
        df = apply_step(df, name, config)
    return df


def _write(df: DataFrame, spec: RunSpec, state: State, mode: str) -> None:
    config = spec.destination
    kind = config["type"]
    if kind in DATABASES:
        write_jdbc(df, config, mode)
    elif kind in VENDORS:
        write_vendor(df, config, mode)
    elif kind == "singer":
        write_singer(df, config["file_path"], stream_name(config) or spec.stream, config.get("key_properties", ()))
    else:
        _write_files(df, spec, state, mode)


def _same_place(spec: RunSpec, path: str) -> bool:
    """Whether the source may lie in the directory written."""
    source = spec.source
    if source["type"] == "s3":
        read = prefix_path(source["bucket"], source.get("prefix"), stream_name(source), source.get("scheme", "s3a://"))
    else:
        read = str(source.get("file_path") or "")
    read, path = (re.sub(r"^(s3[an]?|file):/*", "", p).lstrip("/") for p in (read, path))
    return bool(read) and (read.startswith(path) or path.startswith(read))


def _require(df: DataFrame, config: Mapping[str, Any], path: str, format: str, mode: str) -> None:
    """Check the destination's declared constraints before anything is written.

    An append must keep the key unique together with the rows already there. An upsert makes its key unique itself,
    so only NULLs are checked.
    """
    declared = config.get("constraints")
    if not declared:
        return
    not_null, key = declared.get("not_null", ()), declared.get("primary_key", ())
    if mode == "upsert":
        not_null, key = [*not_null, *key], ()
    elif mode == "append" and key and path_exists(df.sparkSession, path):
        stored = read_files(df.sparkSession, path, format, schema=df.schema)
        df = df.select(*[col(k) for k in df.columns]).unionByName(stored, allowMissingColumns=True)
    require_constraints(df, not_null, key)


def _write_files(df: DataFrame, spec: RunSpec, state: State, mode: str) -> None:
    config = spec.destination
    name = stream_name(config) or spec.stream
    if config["type"] == "s3":
        path = prefix_path(config["bucket"], config.get("prefix"), name, config.get("scheme", "s3a://"))
        options = s3_options(config)
    else:
        path = f"{config['file_path'].rstrip('/')}/{name}"
        options = {}
    format = config.get("format", "parquet")
    if config.get("layout") == "snapshots":
        declared = config.get("constraints") or {}
        if declared.get("primary_key") and mode == "append":
            raise SpecError("a snapshot table keeps a key unique by upsert, not by append")
        if declared:
            _require(df, config, path, format, mode)
        _write_snapshot(df, path, config, spec, state, mode)
        return
    _require(df, config, path, format, mode)
    if mode == "upsert":
        if not config.get("keys") or not config.get("order_by"):
            raise SpecError("an upsert needs keys and order_by in the destination")
        if format != "parquet":
            raise SpecError("an upsert needs a parquet destination")
        upsert_files(df, path, config["keys"], config["order_by"], config.get("partition_by") or ())
        return
    layout = {
        "compression": config.get("compression"),
        "partition_by": config.get("partition_by") or (),
        "batch_size": config.get("batch_size"),
        "options": options,
    }
    if mode == "overwrite":
        replace_files(df, path, format, reads_target=_same_place(spec, path), **layout)
    elif mode == "truncate":
        truncate_files(df, path, format, reads_target=_same_place(spec, path), **layout)
    elif spec.sync_mode == "incremental":
        write_run(df, path, state.run + 1, format, **layout)
    elif layouts(df.sparkSession, path)[0]:
        raise SpecError(f"{path} holds the numbered runs of an incremental sync; a plain append would hide its rows")
    else:
        write_files(df, path, format, **layout)


def _write_rejects(rejects: DataFrame, path: str, spec: RunSpec, state: State, mode: str) -> None:
    """Rejects are kept like the rows: replaced with them, by run where runs are numbered, else added."""
    if mode in ("overwrite", "truncate"):
        replace_files(rejects, path, reads_target=False)
    elif spec.sync_mode == "incremental":
        write_run(rejects, path, state.run + 1)
    else:
        write_files(rejects, path)


def _write_snapshot(df: DataFrame, path: str, config: Mapping[str, Any], spec: RunSpec, state: State, mode: str) -> None:
    """Write to a snapshot table. An incremental run that is repeated because its state was not saved replaces what it added."""
    numbered = f"{spec.name}/{spec.stream}/{state.run + 1}" if spec.sync_mode == "incremental" else None
    layout = {k: config[k] for k in ("compression", "batch_size") if config.get(k)}
    if config.get("format", "parquet") != "parquet" or config.get("partition_by"):
        raise SpecError("a snapshot table holds parquet files without partition columns")
    keys = config.get("keys") or ()
    if mode == "upsert":
        if not keys or not config.get("order_by"):
            raise SpecError("an upsert needs keys and order_by in the destination")
        upsert_snapshot(df, path, keys, config["order_by"], **layout)
    elif mode in ("overwrite", "truncate"):
        replace_snapshot(df, path, keys, mode == "truncate", **layout)
    else:
        append_snapshot(df, path, keys, numbered, **layout)


def _counts_from_footers(source: Mapping[str, Any]) -> bool:
    return source["type"] in ("local_file", "s3") and source.get("format", "parquet") == "parquet"


def run(
    spark: SparkSession,
    spec: RunSpec,
    store: StateStore | None = None,
    saved: Mapping[Any, Mapping[str, Any]] | None = None,
    metrics: str = "operators",
    raise_errors: bool = False,
) -> RunResult:
    """Execute a spec as one write and report what went through each step.

    With ``metrics="operators"`` every step's rows are counted where they pass, in the same pass as the write. What a
    full parquet read delivers is counted from the file footers instead, so that a filter step still reaches the
    scan; on other sources a filter step runs after the scan. ``metrics="written"`` counts only what is written.
    Counts taken before a shuffle include the rows of tasks Spark had to repeat after losing an executor; the written
    count does not.

    The state is saved after the write is complete. A repeated incremental run replaces the files of the run that
    did not get that far.
    """
    if metrics not in ("operators", "written"):
        raise SpecError(f"metrics must be operators or written, not {metrics!r}")
    run_id, started = uuid.uuid4().hex, datetime.now(timezone.utc)
    uses_cursor, _ = sync_plan(spec.sync_mode, spec.cursor_field)
    state = store.load(spec.name, spec.stream) if store else State(spec.name, spec.stream)
    seen: list[tuple[str, str, Watch | FooterCount]] = []

    def watched(df: DataFrame, kind: str, name: str, *extra: Column) -> DataFrame:
        watch = Watch(df, *extra)
        seen.append((kind, name, watch))
        return watch.df

    try:
        mode = write_mode_of(spec.sync_mode, spec.cursor_field, spec.destination.get("write_mode"))
        df, ties = read_source(spark, spec.source), None
        if spec.keep_ties and store:
            ties = Ties(store, state)
            known = spec.cursor_field in df.columns and state.cursor_value is not None
            last = parse_cursor(state.cursor_value, df.schema[spec.cursor_field].dataType) if known else None
            df = increment = staged(ties.after(df, spec.cursor_field, last) if known else from_cursor(df, spec, state), "increment")
        else:
            df = from_cursor(df, spec, state)
        cursor, cursor_type = None, None
        if uses_cursor and spec.cursor_field in df.columns:
            cursor, cursor_type = next_cursor(df, spec.cursor_field).alias("cursor"), df.schema[spec.cursor_field].dataType
        if metrics == "operators" and cursor is None and _counts_from_footers(spec.source):
            seen.append(("extract", spec.source["type"], FooterCount(df)))
        elif metrics == "operators" or cursor is not None:
            df = watched(df, "extract", spec.source["type"], *([cursor] if cursor is not None else []))
        for name, config in resolve_chain(spec.transform, saved):
            df = apply_step(df, name, config)
            if metrics == "operators":
                df = watched(df, "transform", name)
        failed, split = 0, None
        checks = spec.destination.get("quarantine")
        if checks:
            split = split_once(df, checks.get("not_null", ()), checks.get("checks"))  # answers the observations above
            failed, df = split.failed, split.good
            _write_rejects(split.bad.withColumn("_run_id", F.lit(run_id)), checks["path"], spec, state, mode)
        df = watched(df, "load", spec.destination["type"])
        _write(df, spec, state, mode)
        if split:
            split.close()
        counts = [(kind, name, watch.get()) for kind, name, watch in seen]
    except Exception as error:
        if raise_errors:
            raise
        return RunResult(run_id, spec.name, "failed", started, datetime.now(timezone.utc), error=str(error))

    rows = [int(c["rows"]) for _, _, c in counts]
    operators = [
        OperatorMetrics(kind, name, rows[i - 1] if i else rows[0], rows[i], failed if kind == "load" else 0)
        for i, (kind, name, _) in enumerate(counts)
    ]
    cursor_value = next((c["cursor"] for _, _, c in counts if "cursor" in c), None)
    if cursor is not None and state.cursor_value is not None and cursor_value is not None:
        cursor_value = max(cursor_value, state.cursor_value, key=lambda text: parse_cursor(text, cursor_type))
    written = rows[-1]
    if ties:
        reached = parse_cursor(cursor_value, cursor_type) if cursor_value is not None else last
        if reached is not None:
            ties.save(increment, spec.cursor_field, reached, last)
        delete_path(spark, increment.staged_path)
    if store and uses_cursor:
        store.save(state.advanced(spec.cursor_field, cursor_value, written))
    return RunResult(
        run_id,
        spec.name,
        "completed",
        started,
        datetime.now(timezone.utc),
        records_read=rows[0] if counts[0][0] == "extract" else written,
        records_processed=sum(r for r, (kind, _, _) in zip(rows, counts) if kind == "transform"),
        records_written=written,
        records_failed=failed,
        cursor_value=cursor_value,
        operators=operators,
    )

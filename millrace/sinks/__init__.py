"""Sinks: write DataFrames with append, overwrite, truncate and upsert semantics."""

from .checks import check_constraints, require_constraints, split_once, split_rejects, write_with_quarantine
from .files import (
    ensure_target,
    publish,
    read_partitioned,
    read_runs,
    replace_files,
    truncate_files,
    write_files,
    write_json_arrays,
    write_partitioned,
    write_run,
    write_streams,
)
from .jdbc import write_jdbc, write_jdbc_streams
from .singer import write_singer
from .snapshots import append_snapshot, read_snapshot, replace_snapshot, snapshot, upsert_snapshot, vacuum
from .upsert import latest_per_key, merge_rows, upsert_files
from .vendor import write_vendor

__all__ = [
    "append_snapshot",
    "check_constraints",
    "ensure_target",
    "latest_per_key",
    "merge_rows",
    "publish",
    "read_partitioned",
    "read_runs",
    "read_snapshot",
    "replace_files",
    "replace_snapshot",
    "require_constraints",
    "snapshot",
    "split_once",
    "split_rejects",
    "truncate_files",
    "upsert_files",
    "upsert_snapshot",
    "vacuum",
    "write_files",
    "write_jdbc",
    "write_jdbc_streams",
    "write_json_arrays",
    "write_partitioned",
    "write_run",
    "write_singer",
    "write_streams",
    "write_vendor",
    "write_with_quarantine",
]

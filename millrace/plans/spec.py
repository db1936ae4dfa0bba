"""Run specs: the JSON-like description of a source, a transform chain and a destination."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..errors import SpecError
from ..sources.jdbc import stream_name

DATABASES = ("postgresql", "mysql", "mssql", "oracle", "jdbc")
VENDORS = ("mongodb", "snowflake", "bigquery")
FILES = ("local_file", "s3", "singer")
_CRON_FIELDS = 5


def _merged(connection: Mapping[str, Any] | None, override: Mapping[str, Any] | None) -> dict[str, Any]:
    """Connection config with the run's own values on top."""
    return {**(connection or {}), **(override or {})}


def _check_connector(config: Mapping[str, Any], side: str) -> None:
    kind = config.get("type")
    if kind not in (*DATABASES, *VENDORS, *FILES):
        raise SpecError(f"unknown {side} type {kind!r}; one of {', '.join((*DATABASES, *VENDORS, *FILES))}")
    if int(config.get("batch_size", 1)) < 1:
        raise SpecError("batch_size must be at least 1")


@dataclass(frozen=True)
class RunSpec:
    """One source, a chain of transforms, one destination."""

    name: str
    source: dict[str, Any]
    destination: dict[str, Any]
    transform: dict[str, Any] = field(default_factory=dict)
    sync_mode: str = "full_refresh"
    cursor_field: str | None = None
    lookback: float = 0
    keep_ties: bool = False

    @classmethod
    def from_dict(cls, spec: Mapping[str, Any], connections: Mapping[Any, Mapping[str, Any]] | None = None) -> RunSpec:
        """Spec from its JSON shape.

        ``source_config`` / ``destination_config`` overlay the connection found under ``source_connection_id`` /
        ``destination_connection_id`` in ``connections``. ``replication_key`` in the source names the cursor too.
        ``lookback`` (seconds, or units of a numeric cursor) reads that much again before the saved cursor, for rows
        that arrive late; only an upsert can take rows twice, so it needs that sync mode. ``keep_ties`` is for
        sources where rows with the greatest cursor value may arrive after it was read: an incremental sync then
        remembers which of them it has taken and takes the others.
        """
        if not spec.get("name"):
            raise SpecError("a spec needs a name")
        cron = spec.get("schedule_cron")
        if cron is not None and len(cron.split()) != _CRON_FIELDS:
            raise SpecError("schedule_cron must have five fields")
        sides = {}
        for side in ("source", "destination"):
            connection = (connections or {}).get(spec.get(f"{side}_connection_id"))
            sides[side] = _merged(connection, spec.get(f"{side}_config"))
            _check_connector(sides[side], side)
        cursor = spec.get("cursor_field") or sides["source"].get("cursor_field") or sides["source"].get("replication_key")
        if spec.get("lookback") and spec.get("sync_mode") != "upsert":
            raise SpecError("lookback reads rows again, so it needs sync mode upsert")
        if spec.get("keep_ties") and (spec.get("sync_mode") != "incremental" or not cursor):
            raise SpecError("keep_ties needs sync mode incremental and a cursor_field")
        return cls(
            name=spec["name"],
            source=sides["source"],
            destination=sides["destination"],
            transform=dict(spec.get("transform_config") or {}),
            sync_mode=spec.get("sync_mode") or "full_refresh",
            cursor_field=cursor,
            lookback=spec.get("lookback") or 0,
            keep_ties=bool(spec.get("keep_ties")),
        )

    @property
    def stream(self) -> str:
        """Name of the stream read, taken from the file name when the source names none."""
        named = stream_name(self.source)
        if named:
            return named
        path = str(self.source.get("file_path") or self.source.get("prefix") or "").rstrip("/")
        return path.rsplit("/", 1)[-1].split(".")[0] or self.name

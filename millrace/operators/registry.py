"""Transforms by name, and chains of them described by JSON-like specs."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame

from ..errors import SpecError
from . import basic
from .sql import sql_transform

log = logging.getLogger(__name__)

Transform = Callable[..., DataFrame]

# The names specs use.
_TRANSFORMS: dict[str, Transform] = {
    "noop": basic.noop,
    "duckdb_sql_transformer": sql_transform,
    "drop_fields": basic.drop_fields,
    "rename_fields": basic.rename_fields,
    "filter_rows": basic.filter_rows,
    "add_constant": basic.add_constant,
    "compute_expression": basic.compute_expression,
    "type_cast": basic.type_cast,
}


def _key(name: str) -> str:
    return "_".join(name.strip().lower().split(" "))


def register_transform(name: str, function: Transform) -> None:
    """Make ``function(df, **config)`` usable in specs under ``name``."""
    _TRANSFORMS[_key(name)] = function


def transform_names() -> list[str]:
    return sorted(_TRANSFORMS)


def get_transform(name: str) -> Transform:
    if _key(name) not in _TRANSFORMS:
        raise SpecError(f"transform {_key(name)!r} is not registered; one of {', '.join(transform_names())}")
    return _TRANSFORMS[_key(name)]


def resolve_chain(
    spec: Mapping[str, Any] | None, saved: Mapping[Any, Mapping[str, Any]] | None = None
) -> list[tuple[str, dict[str, Any]]]:
    """(name, config) steps of a transform spec.

    Steps are inline (``type``, ``config``) or refer to a saved one (``transformer_id``), whose config
    ``config_override`` overrides; unknown saved ids are skipped with a warning. ``processor_type`` is the older
    single-step form. No steps mean no change.
    """
    spec = spec or {}
    if spec.get("transformers") is None:
        if not spec.get("processor_type"):
            return []
        return [(spec["processor_type"], dict(spec.get("config") or {}))]
    steps = []
    for item in spec["transformers"]:
        if item.get("transformer_id"):
            found = (saved or {}).get(item["transformer_id"])
            if found is None:
                log.warning("saved transform %s not found, step skipped", item["transformer_id"])
                continue
            steps.append((found["type"], {**(found.get("config") or {}), **(item.get("config_override") or {})}))
        else:
            steps.append((item.get("type") or "noop", dict(item.get("config") or {})))
    for name, _ in steps:
        get_transform(name)
    return steps


def apply_step(df: DataFrame, name: str, config: Mapping[str, Any]) -> DataFrame:
    return get_transform(name)(df, **config)


def apply_chain(
    df: DataFrame, spec: Mapping[str, Any] | None, saved: Mapping[Any, Mapping[str, Any]] | None = None
) -> DataFrame:
    """Apply the steps of a transform spec in order; the result is one lazy plan."""
    return reduce(lambda frame, step: apply_step(frame, *step), resolve_chain(spec, saved), df)

"""Column references by exact name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quoted(name: str) -> str:
    """``name`` as a SQL identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The top-level column called exactly ``name``."""
    return F.col(quoted(name))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one timestamp to another of the same type; for zone-free ones no time zone comes in."""
    span = end - start
    parts = (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))
    return sum((F.extract(F.lit(unit), span).cast("double") * size for unit, size in parts), F.lit(0.0))

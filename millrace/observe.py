"""Aggregates taken while a write runs."""

from __future__ import annotations

from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, functions as F
from py4j.protocol import Py4JError


class Watch:
    """Observed aggregates over the rows passing one point of a plan.

    Spark drops a point it can prove to see no rows that matter (the other side of a join turned out empty, say);
    the aggregates are then computed by a query of their own.
    """

    def __init__(self, df: DataFrame, *extra: Column):
        self._plain = df
        self._aggregates = [F.count(F.lit(1)).alias("rows"), *extra]
        self._observation = Observation()
        self.df = df.observe(self._observation, *self._aggregates)

    def get(self) -> dict[str, Any]:
        """Values seen by the first action over :attr:`df`, which must have finished."""
        try:
            return self._observation.get
        except (Py4JError, PySparkException):
            return self._plain.agg(*self._aggregates).first().asDict()

    @property
    def rows(self) -> int:
        return int(self.get()["rows"])


class FooterCount:
    """Rows of a parquet scan that nothing has filtered: a job of its own, which reads no column.

    Counted at once, while the files are certain to be there.
    """

    def __init__(self, df: DataFrame):
        self._rows = df.count()

    def get(self) -> dict[str, Any]:
        return {"rows": self._rows}

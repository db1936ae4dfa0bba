"""Stream name, extraction time and record counts."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import local_frame


def stamp(df: DataFrame, stream: str, extracted_at: datetime | None = None) -> DataFrame:
    """Add ``_stream`` and ``_extracted_at``; the time (UTC) is fixed once, so every row of a run carries the same."""
    moment = extracted_at or datetime.now(timezone.utc)
    return df.withColumn("_stream", F.lit(stream)).withColumn("_extracted_at", F.lit(moment))


def record_count(streams: Mapping[str, DataFrame]) -> DataFrame:
    """(stream, row_count) of every stream in one job with one small shuffle.

    No column is read, so parquet answers from its footers; tasks send one partial count per stream.
    """
    spark = next(iter(streams.values())).sparkSession
    ones = [df.select(F.lit(name).alias("stream"), F.lit(1).alias("n")) for name, df in streams.items()]
    listed = local_frame(spark, [(name, 0) for name in streams], "stream string, n int")  # empty streams count too
    return reduce(DataFrame.unionAll, [listed, *ones]).groupBy("stream").agg(F.sum("n").alias("row_count"))

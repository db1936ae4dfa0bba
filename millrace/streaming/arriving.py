"""Files that arrive over time, taken in with Structured Streaming: the checkpoint is the saved state."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T

from ..errors import SpecError
from ..operators.registry import apply_step, resolve_chain
from ..sinks.files import write_run
from ..sinks.upsert import upsert_files
from ..sources.files import _FORMAT_OPTIONS


def run_arriving_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    target: str,
    checkpoint: str,
    transform: Mapping[str, Any] | None = None,
    format: str = "parquet",
    keys: tuple[str, ...] = (),
    order_by: tuple[str, ...] = (),
    partition_by: tuple[str, ...] = (),
    max_files: int | None = None,
) -> None:
    """Take in every file not seen before, then stop.

    Each micro-batch is appended under the checkpoint's id and its own number, or upserted when ``keys`` are given, so a batch repeated after
    a failure leaves the same data. Transforms see one micro-batch at a time. ``max_files`` bounds a batch. With
    partition columns among the keys an upsert rewrites only the partitions a batch belongs to.
    """
    if format not in ("parquet", "csv", "json", "jsonl"):
        raise SpecError(f"unsupported file format {format!r}")
    steps = resolve_chain(transform)
    reader = spark.readStream.format("json" if format == "jsonl" else format).schema(schema).options(**_FORMAT_OPTIONS[format])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def take(batch: DataFrame, number: int) -> None:
        for name, config in steps:
            batch = apply_step(batch, name, config)
        if keys:
            upsert_files(batch, target, keys, order_by, partition_by)
        else:
            about = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]  # one line: the id of the checkpoint
            write_run(batch, target, f"{json.loads(about)['id']}-{number}", partition_by=partition_by)

    query = (
        reader.load(source)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()

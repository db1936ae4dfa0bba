"""User-written record and batch transforms, run inside tasks on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..columns import col
from ..errors import TransformError

Record = dict[str, Any]
Hook = Callable[[], None] | None


def _as_schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _run(df: DataFrame, schema: T.StructType | str, work, setup: Hook, teardown: Hook) -> DataFrame:
    out_schema = _as_schema(schema)
    arrow_schema = to_arrow_schema(out_schema)
    names = df.columns

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        try:
            for rows in work(batch.rename_columns(names) for batch in batches):
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)
        finally:
            if teardown:
                teardown()

    numbered = df.select(*[col(name).alias(f"c{i}") for i, name in enumerate(names)])  # any name is allowed inside
    return numbered.mapInArrow(partition, out_schema)


def custom_record(
    df: DataFrame,
    transform_record: Callable[[Record], Record | None],
    schema: T.StructType | str,
    setup: Hook = None,
    teardown: Hook = None,
) -> DataFrame:
    """``transform_record`` on every record; None drops the record. Hooks run once per partition."""

    def work(batches):
        for batch in batches:
            out = []
            for record in batch.to_pylist():
                try:
                    result = transform_record(record)
                except Exception as error:
                    raise TransformError(f"transform_record failed: {error}") from error
                if result is not None:
                    out.append(result)
            yield out

    return _run(df, schema, work, setup, teardown)


def custom_batch(
    df: DataFrame,
    process_batch: Callable[[list[Record]], Iterable[Record]],
    schema: T.StructType | str,
    batch_size: int = 1000,
    setup: Hook = None,
    teardown: Hook = None,
) -> DataFrame:
    """``process_batch`` on lists of up to ``batch_size`` records of one partition; it may return any number.

    Which records share a batch depends on how the input is partitioned.
    """

    def call(records):
        try:
            return list(process_batch(records))
        except Exception as error:
            raise TransformError(f"process_batch failed: {error}") from error

    def work(batches):
        waiting: list[Record] = []
        for batch in batches:
            waiting.extend(batch.to_pylist())
            while len(waiting) >= batch_size:
                yield call(waiting[:batch_size])
                waiting = waiting[batch_size:]
        if waiting:
            yield call(waiting)

    return _run(df, schema, work, setup, teardown)

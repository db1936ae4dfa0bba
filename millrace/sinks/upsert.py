"""Insert-or-replace by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..columns import col
from ..errors import SpecError
from ..session import delete_path, path_exists, work_path
from .files import replace_files, restore, write_files

_UNORDERED = (T.MapType, T.VariantType)


def _all_set(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest by ``order_by``; rows with a NULL key are all kept.

    Remaining ties are settled by the other columns, so the result does not depend on row order. The filter on the
    row number becomes a group limit before the shuffle: a task sends one row per key however often the key occurs.
    """
    if not keys or not order_by:
        raise SpecError("an upsert needs keys and an order to tell which row is the last")
    rest = [f.name for f in df.schema.fields if f.name not in order_by and not isinstance(f.dataType, _UNORDERED)]
    order = [col(c).desc_nulls_last() for c in [*order_by, *rest] if c not in keys]
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*(order or [F.lit(1)]))
    keyed = df.where(_all_set(keys)).withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")
    return keyed.unionByName(df.where(~_all_set(keys)))


def merge_rows(target: DataFrame, latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` without the rows whose key is in ``latest``, plus ``latest``, which holds a key at most once.

    The target side of an anti join may be split where it is skewed, so a hot key stays spread out. Spark broadcasts
    the keys when their size allows.
    """
    kept = target.join(latest.select(*[col(k) for k in keys]), list(keys), "left_anti")
    kept = kept.select(*[col(c) for c in target.columns])
    return kept.unionByName(latest, allowMissingColumns=True)


def _read_target(latest: DataFrame, path: str, partition_by: Sequence[str]) -> DataFrame:
    """Rows at ``path``, with partition columns typed as they come in rather than guessed from directory names."""
    reader = latest.sparkSession.read
    stored = reader.parquet(path).schema
    typed = [latest.schema[f.name] if f.name in partition_by else f for f in stored.fields]
    return reader.schema(T.StructType(typed)).parquet(path)


def _in_partitions(target: DataFrame, latest: DataFrame, partition_by: Sequence[str]) -> Column:
    """Filter on the partition columns that prunes ``target`` to the partitions ``latest`` has rows in."""
    fields = [target.schema[c] for c in partition_by]
    found = latest.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in fields]).distinct().collect()
    values = [F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for row in found]
    return F.struct(*[col(f.name) for f in fields]).isin(*values) if values else F.lit(False)


def upsert_files(
    incoming: DataFrame,
    path: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
) -> None:
    """Upsert into parquet files at ``path``, created when missing.

    When the partition columns are part of the key, only the partitions the incoming rows belong to are read and
    rewritten; their list is as long as the directories written. Otherwise the whole target is rewritten beside the
    old one and then takes its place, so large targets want a partition column in their key (a hash bucket will do).
    """
    spark = incoming.sparkSession
    restore(spark, path)
    staged = work_path(spark, "upsert")
    # written once: the source is read a single time and Spark knows the size of what it joins
    write_files(latest_per_key(incoming, keys, order_by), staged)
    latest = spark.read.parquet(staged)
    if not path_exists(spark, path):
        replace_files(latest, path, partition_by=partition_by)
    elif partition_by and set(partition_by) <= set(keys):
        target = _read_target(latest, path, partition_by)
        write_files(
            merge_rows(target.where(_in_partitions(target, latest, partition_by)), latest, keys),
            path,
            mode="overwrite",
            partition_by=partition_by,
            options={"partitionOverwriteMode": "dynamic"},
        )
    else:
        replace_files(merge_rows(_read_target(latest, path, partition_by), latest, keys), path, partition_by=partition_by)
    delete_path(spark, staged)

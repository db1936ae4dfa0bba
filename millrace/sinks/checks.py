"""Declared constraints checked as data, and rejected rows set aside."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..columns import col
from ..errors import SpecError
from ..observe import Watch
from ..session import delete_path, work_path
from .files import write_files

REASON, PART = "_reject_reason", "_reject_part"


def check_constraints(df: DataFrame, not_null: Sequence[str] = (), primary_key: Sequence[str] = ()) -> DataFrame:
    """(constraint, columns, violations) per declared constraint.

    NULLs of all columns are counted in one aggregate. For the key, rows are counted per key with map-side partial
    counts; its violations are the rows beyond the first of each key.
    """
    if not not_null and not primary_key:
        raise SpecError("no constraint given")
    parts = []
    required = list(dict.fromkeys([*not_null, *primary_key]))
    nulls = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(required)])
    listed = F.array(
        *[F.struct(F.lit(c).alias("columns"), F.col(f"n{i}").alias("violations")) for i, c in enumerate(required)]
    )
    nulls = nulls.select(F.explode(listed).alias("c"))
    parts.append(nulls.select(F.lit("not_null").alias("constraint"), "c.columns", "c.violations"))
    if primary_key:
        per_key = df.groupBy(*[col(k) for k in primary_key]).agg(F.count(F.lit(1)).alias("n"))
        extra = per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        named = F.lit(",".join(primary_key)).alias("columns")
        parts.append(extra.select(F.lit("primary_key").alias("constraint"), named, "violations"))
    return reduce(DataFrame.unionByName, parts)


def require_constraints(df: DataFrame, not_null: Sequence[str] = (), primary_key: Sequence[str] = ()) -> None:
    """Raise ValueError naming every violated constraint."""
    broken = check_constraints(df, not_null, primary_key).where("violations > 0").collect()  # one row per constraint
    if broken:
        raise ValueError("; ".join(f"{r['constraint']}({r['columns']}): {r['violations']} rows" for r in broken))


def _tests(not_null: Sequence[str], checks: Mapping[str, str] | None) -> dict[str, Column]:
    """What makes a row fail, by name."""
    tests = {f"{c} is null": col(c).isNull() for c in not_null}
    tests.update({name: ~F.coalesce(F.expr(predicate), F.lit(False)) for name, predicate in (checks or {}).items()})
    if not tests:
        raise SpecError("no check given")
    return tests


def split_rejects(
    df: DataFrame, not_null: Sequence[str] = (), checks: Mapping[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows passing every check, failing rows with ``_reject_reason``).

    ``checks`` maps a name to a SQL predicate that must hold; a predicate that is NULL does not hold. Both results go
    through ``df`` when they are used; ``split_once`` goes through it one time for both.
    """
    tests = _tests(not_null, checks)
    failed = reduce(lambda a, b: a | b, tests.values())
    reason = F.concat_ws("; ", *[F.when(test, F.lit(name)) for name, test in tests.items()])
    return df.where(~failed), df.where(failed).withColumn("_reject_reason", reason)


@dataclass
class Split:
    """Rows judged once: both parts read what a single write left at ``path``, below the shared folder."""

    good: DataFrame
    bad: DataFrame
    failed: int
    path: str

    def close(self) -> None:
        delete_path(self.good.sparkSession, self.path)


def split_once(df: DataFrame, not_null: Sequence[str] = (), checks: Mapping[str, str] | None = None) -> Split:
    """``split_rejects`` in one pass over ``df``: every row is computed and judged one time and written to its part."""
    spark, tests = df.sparkSession, _tests(not_null, checks)
    if {REASON, PART} & set(df.columns):
        raise SpecError(f"columns {REASON} and {PART} are names this sink uses")
    untyped = {f.name: col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    df = df.withColumns(untyped) if untyped else df
    reason = F.concat_ws("; ", *[F.when(test, F.lit(name)) for name, test in tests.items()])
    path = work_path(spark, "split")
    df.withColumn(REASON, reason).withColumn(PART, F.when(F.col(REASON) == "", "good").otherwise("bad")).write.partitionBy(PART).parquet(path)
    reader = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(REASON, T.StringType()), T.StructField(PART, T.StringType())]))
    rows = reader.parquet(path)
    bad = rows.where(F.col(PART) == "bad").drop(PART)
    return Split(rows.where(F.col(PART) == "good").drop(PART, REASON), bad, bad.count(), path)


def write_with_quarantine(
    df: DataFrame,
    path: str,
    reject_path: str,
    not_null: Sequence[str] = (),
    checks: Mapping[str, str] | None = None,
    format: str = "parquet",
    mode: str = "append",
) -> tuple[int, int]:
    """Write passing rows to ``path`` and failing ones to ``reject_path``; (written, failed) counts.

    ``df`` is gone through once, so a source or a hook that answers differently each time still puts a row in one
    place. With ``mode="overwrite"`` the rejects of the last write are replaced as well.
    """
    split = split_once(df, not_null, checks)
    try:
        seen = Watch(split.good)
        write_files(split.bad, reject_path, format, mode)
        write_files(seen.df, path, format, mode)
        return seen.rows, split.failed
    finally:
        split.close()

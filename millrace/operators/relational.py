"""Relational operators Spark SQL does not offer directly, composed from joins, aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..columns import col, seconds_between
from ..errors import SpecError
from .segments import Segments


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    by: str,
    values: Sequence[str],
    slice_width: float,
    prefix: str = "",
) -> DataFrame:
    """Every left row with ``values`` of the latest right row of the same key whose ``by`` is not later.

    ``by`` is a timestamp or number in both inputs. ``slice_width`` (seconds, or units of ``by``) cuts each key into
    slices that are sorted separately, so a key holding a large share of the rows is spread over many tasks. What a
    slice needs from earlier ones is the last right row before it: one pre-aggregated row per key and slice.
    Left rows without a match keep NULLs. Of right rows with equal ``by`` one is taken by the order of its values.
    """
    _same_line((left, by), (right, by))
    on = list(on)
    keys = [*on, "_slice"]
    width = F.lit(float(slice_width))
    known = F.lit(True)
    for name in [*on, by]:
        known = known & col(name).isNotNull()
    hit = F.struct(col(by).alias("_at"), *[col(v) for v in values])

    rights = right.where(known).withColumn("_slice", F.floor(_number(right, by) / width))
    rights = rights.select(*[col(k) for k in keys], col(by).alias("_at"), hit.alias("_hit"))
    lefts = left.where(known).withColumn("_slice", F.floor(_number(left, by) / width))
    lefts = lefts.select(*[col(k) for k in keys], col(by).alias("_at"), F.struct(*[col(c) for c in left.columns]).alias("_row"))
    no_hit = F.lit(None).cast(rights.schema["_hit"].dataType)
    no_row = F.lit(None).cast(lefts.schema["_row"].dataType)

    # within a slice: of one instant right rows come first, the greatest last among them, then left rows
    marked = lefts.withColumn("_hit", no_hit).unionByName(rights.withColumn("_row", no_row))
    within = Window.partitionBy(*[col(k) for k in keys]).orderBy("_at", F.col("_hit").isNull(), "_hit")
    latest = F.last("_hit", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    seen = marked.withColumn("_hit", latest).where(F.col("_row").isNotNull())

    # across slices: one row per key and slice, holding the last right row of that slice if there is one
    ends = lefts.select(*[col(k) for k in keys], no_hit.alias("_hit"))
    ends = ends.unionByName(rights.select(*[col(k) for k in keys], "_hit"))
    ends = ends.groupBy(*[col(k) for k in keys]).agg(F.max("_hit").alias("_end"))
    before = Window.partitionBy(*[col(k) for k in on]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")

    found = F.coalesce(F.col("_hit"), F.col("_carried"))
    matched = seen.join(carried, keys, "left").select(
        *[F.col("_row").getField(c).alias(c) for c in left.columns],
        *[found.getField(v).alias(prefix + v) for v in values],
    )
    # rows without a key or a position match nothing and need no shuffle
    unmatched = left.where(~known).select(
        *[col(c) for c in left.columns],
        *[no_hit.getField(v).alias(prefix + v) for v in values],
    )
    return matched.unionByName(unmatched)


def asof_join_scan(left: DataFrame, right: DataFrame, on: Sequence[str], by: str, values: Sequence[str], prefix: str = "") -> DataFrame:
    """Like :func:`asof_join`, without a slice width to choose and with one scan of each side.

    Rows of both sides are laid out once in the order of key and ``by`` (``Segments``), in pieces of equal size however
    the keys are distributed; the last right row so far is carried from piece to piece. ``by`` and ``values`` must have
    an order.
    """
    _same_line((left, by), (right, by))
    known = F.lit(True)
    for name in [*on, by]:
        known = known & col(name).isNotNull()
    keys = [f"_on_{i}" for i in range(len(on))]
    place = lambda df: [*[col(k).alias(n) for k, n in zip(on, keys)], _number(df, by).alias("_at")]
    row = F.struct(*[col(c) for c in left.columns]).alias("_row")
    hit = F.struct(col(by).alias("_at"), *[col(v) for v in values]).alias("_hit")
    lefts = left.select(known.alias("_known"), *place(left), F.lit(1).alias("_side"), row)
    rights = right.where(known).select(F.lit(True).alias("_known"), *place(right), F.lit(0).alias("_side"), hit)
    # of one instant right rows come first, the greatest last among them, then left rows
    marked = lefts.unionByName(rights, allowMissingColumns=True)
    seen = Segments(marked, keys, ["_at", "_side", "_hit"]).running({"_found": ("last", "_hit")}).frame().where("_side = 1")
    found = F.when(F.col("_known"), F.col("_found"))
    return seen.select(*[F.col("_row").getField(c).alias(c) for c in left.columns], *[found.getField(v).alias(prefix + v) for v in values])


def _number(df: DataFrame, name: str) -> Column:
    """Position on a number line: seconds for dates and timestamps. Zone-free types are counted without a zone."""
    value, data_type = col(name), df.schema[name].dataType
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(value) / F.lit(1e6)
    if isinstance(data_type, T.TimestampNTZType):
        return seconds_between(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), value)
    if isinstance(data_type, T.DateType):
        return F.unix_date(value) * F.lit(86400.0)
    return value.cast("double")


def _same_line(*columns: tuple[DataFrame, str]) -> None:
    zoned = {isinstance(df.schema[name].dataType, T.TimestampType) for df, name in columns}
    if len(zoned) > 1:
        raise SpecError("timestamps with and without a time zone cannot be matched; cast one side first")


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    point: str,
    low: str,
    high: str,
    width: float,
    how: str = "inner",
) -> DataFrame:
    """Points joined to the ranges ``low <= point < high`` that hold them.

    Each range is listed once per bucket of ``width`` it touches, so the join is an equi-join on the bucket with the
    exact bounds as residual filter; nothing is compared across buckets. Choose ``width`` near the usual range length.
    ``how`` is inner, left, left_semi or left_anti: a range listed in several buckets has no single unmatched row.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise SpecError(f"range_join has no {how!r} form")
    _same_line((points, point), (ranges, low), (ranges, high))
    step = F.lit(float(width))
    first = F.floor(_number(ranges, low) / step)
    last = F.floor(_number(ranges, high) / step)
    listed = ranges.where(col(low) < col(high)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    placed = points.withColumn("_place", F.floor(_number(points, point) / step))
    inside = (F.col("_place") == F.col("_bucket")) & (col(point) >= col(low)) & (col(point) < col(high))
    return placed.join(listed, inside, how).drop("_place", "_bucket")


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered in ``rank``.

    Spark turns the filter on the row number into a group limit before the shuffle, so a group sends at most
    ``k`` rows per map task whatever its size.
    """
    window = Window.partitionBy(*[col(g) for g in group]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(col(rank) <= k)

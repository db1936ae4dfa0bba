"""Interval joins for ranges of any length: dyadic covers.

A range of whole numbers is the union of at most two dyadic blocks per power of two: [k * 2**p, (k + 1) * 2**p). A
point lies in exactly one block of each size. Listing a range by the blocks of its cover, and a point by its block of
each size that some range uses, makes the join an equi-join on the block, with no residual check and no bucket width to
choose. A range costs rows by the logarithm of its length, an open one too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..columns import col
from ..errors import SpecError
from ..session import staged

BITS = 62
_OFFSET, _LEAST, _MOST = 1 << (BITS - 2), 1, (1 << (BITS - 1)) - 1
_HOW = ("inner", "left", "right", "full", "left_semi", "left_anti")
_MERGED = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _place(df: DataFrame, name: str) -> Column:
    """The value as a whole number that keeps the order: integers, dates (days) and timestamps (microseconds)."""
    value, kind = col(name), df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_timestamp_ltz(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    raise SpecError(f"an interval join is over integers, dates or timestamps, not {kind.simpleString()} ({name})")


def _bound(df: DataFrame, name: str, open_at: int) -> Column:
    """A bound as a whole number from 1 to 2**61 - 1, ``open_at`` for NULL."""
    return F.when(col(name).isNull(), F.lit(open_at)).otherwise(F.least(F.greatest(_place(df, name) + _OFFSET, F.lit(_LEAST)), F.lit(_MOST)))


def _at(points: DataFrame, point: str) -> Column:
    """The place of a point among such bounds, NULL for NULL."""
    return F.when(col(point).isNotNull(), F.least(F.greatest(_place(points, point) + _OFFSET, F.lit(_LEAST)), F.lit(_MOST - 1))).alias("_at")


def cover(low: Column, high: Column) -> Column:
    """The dyadic cover of ``low <= x < high``, bounds from 1 to 2**61: an array of (p, k), blocks k * 2**p and on.

    Between the point before the range and the upper bound, both left out, lie at power p the block after the former's
    own if that is even, and the block before the latter's own if that is odd, for all powers at which the two still
    have a block between them.
    """
    before = low - 1
    shift = lambda x, p: F.call_function("shiftright", x, p)
    top = F.length(F.bin(before.bitwiseXOR(high)))  # the bounds agree from this power on
    powers = F.when(top > 1, F.sequence(F.lit(0), top - 2)).otherwise(F.array().cast("array<int>"))
    up = F.transform(F.filter(powers, lambda p: shift(before, p) % 2 == 0), lambda p: F.struct(p.alias("p"), (shift(before, p) + 1).alias("k")))
    down = F.transform(F.filter(powers, lambda p: shift(high, p) % 2 == 1), lambda p: F.struct(p.alias("p"), (shift(high, p) - 1).alias("k")))
    return F.concat(up, down)


def _blocks(ranges: DataFrame, low: str, high: str, on: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row per range and block (p, k) of its cover, with ``on`` as ``_r_*`` and the columns ``keep`` as ``_b_*``."""
    begin, end = _bound(ranges, low, _LEAST), _bound(ranges, high, _MOST)
    return ranges.where(begin < end).select(
        *[col(k).alias(f"_r_{k}") for k in on], *[col(c).alias(f"_b_{c}") for c in keep], F.inline(cover(begin, end))
    )


def _listed(places: DataFrame, blocks: DataFrame, on: Sequence[str]) -> DataFrame:
    """A row per place and block (pp, kk) that holds it and that some range has in its cover."""
    used = [r.p for r in blocks.select("p").distinct().collect()]  # at most 62
    sizes = F.explode(F.array(*[F.lit(p) for p in used]).cast("array<int>")).alias("pp")
    listed = places.where("_at IS NOT NULL").select("*", sizes).withColumn("kk", F.call_function("shiftright", "_at", "pp"))
    return listed.join(blocks.select(*[col(f"_r_{k}") for k in on], "p", "k").distinct(), _same_block(on), "left_semi")


def _same_block(on: Sequence[str]) -> Column:
    same = (F.col("p") == F.col("pp")) & (F.col("k") == F.col("kk"))
    for k in on:
        same = same & (col(f"_r_{k}") == col(f"_p_{k}"))
    return same


def interval_join(
    points: DataFrame,
    ranges: DataFrame,
    point: str,
    low: str,
    high: str,
    how: str = "inner",
    on: Sequence[str] = (),
    by: Sequence[str] = (),
    totals: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Points joined to the ranges ``low <= point < high`` that hold them, and that agree in the columns ``on``.

    ``point``, ``low`` and ``high`` are integers, dates or timestamps of one kind. A NULL bound is open. Ranges that are
    empty or a NULL point meet nothing. ``how`` is inner, left, right, full, left_semi or left_anti, where points are
    the left side; unmatched rows appear once. Columns ``on`` appear once, of the other columns none may share a name.
    Integers beyond 2**60 count as 2**60. Each distinct place of a point is listed once for each power of two that some
    range needs, and points meet the ranges of their place last, so what is shuffled grows with the pairs of distinct
    places and ranges. A hot place is a skewed join side, which Spark splits.

    With ``totals``, name -> (count, sum, min or max; column of the points), the joined rows come grouped by the columns
    ``by`` of the ranges. The points of a block are summed up before they meet its ranges, so no pairs are listed and
    the work grows with the rows of both sides, not with their pairs.
    """
    if how not in _HOW:
        raise SpecError(f"interval_join has no {how!r} form; one of {', '.join(_HOW)}")
    kinds = {type(df.schema[name].dataType) for df, name in ((points, point), (ranges, low), (ranges, high)) if not isinstance(df.schema[name].dataType, T.IntegralType)}
    if len(kinds) > 1 or (kinds and any(isinstance(df.schema[name].dataType, T.IntegralType) for df, name in ((points, point), (ranges, low), (ranges, high)))):
        raise SpecError("the point and the bounds of an interval join must be of one kind")
    shared = [c for c in points.columns if c in ranges.columns and c not in on]
    if shared:
        raise SpecError(f"both sides have columns {', '.join(shared)}; rename them first")
    if totals is not None:
        return _totals(points, ranges, point, low, high, how, on, by, totals)
    if by:
        raise SpecError("an interval join by columns needs totals")
    at = [*[f"_p_{k}" for k in on], "_at"]
    # staged: read more than once; ranges numbered: a range is listed many times and must be known as one
    left = staged(points.select("*", *[col(k).alias(f"_p_{k}") for k in on], _at(points, point)), "points")
    right = staged(ranges.withColumn("_range", F.monotonically_increasing_id()), "ranges")
    blocks = _blocks(right, low, high, on, ["_range"])
    listed = _listed(left.select(*at).distinct(), blocks, on)
    met = listed.select(*at).distinct()
    if how in ("left_semi", "left_anti"):
        return left.join(met, at, how).select(*[col(c) for c in points.columns])
    rights = right.select("_range", *[col(c).alias(f"_r_{c}" if c in on else c) for c in ranges.columns])
    pairs = listed.join(blocks, _same_block(on)).select(*at, col("_b__range").alias("_range"))
    found = left.join(pairs.join(rights, "_range"), at)
    if how in ("right", "full"):
        taken = blocks.join(listed.drop("_at").distinct(), _same_block(on), "left_semi").select(col("_b__range").alias("_range")).distinct()
        found = found.unionByName(rights.join(taken, "_range", "left_anti"), allowMissingColumns=True)
    if how in ("left", "full"):
        found = found.unionByName(left.join(met, at, "left_anti"), allowMissingColumns=True)
    keys = {k: F.coalesce(col(k), col(f"_r_{k}")).alias(k) for k in on}
    return found.select(*[keys.get(c, col(c)) for c in points.columns], *[col(c) for c in ranges.columns if c not in on])


def _totals(
    points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, how: str, on: Sequence[str], by: Sequence[str], totals: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Totals of the points of each place, of each block, and of the blocks of each group of ranges.

    A range without points adds a row that changes no total; points without a range are a group beside the others.
    """
    if how in ("left_semi", "left_anti"):
        raise SpecError(f"the {how} form of an interval join has no totals")
    if not by or any(c not in ranges.columns for c in by):
        raise SpecError(f"totals of an interval join are by columns of the ranges: {', '.join(ranges.columns)}")
    for name, (kind, column) in totals.items():
        if kind not in _MERGED or column not in points.columns:
            raise SpecError(f"{name}: no {kind!r} of {column!r}; one of {', '.join(_MERGED)} of a column of the points")
    at = [*[f"_p_{k}" for k in on], "_at"]
    parts = [f"_t_{name}" for name in totals]
    merged = [_MERGED[kind](col(f"_t_{name}")).alias(f"_t_{name}") for name, (kind, _) in totals.items()]
    first = [getattr(F, kind)(col(column)).alias(f"_t_{name}") for name, (kind, column) in totals.items()]
    left = staged(points.groupBy(*[col(k).alias(f"_p_{k}") for k in on], _at(points, point)).agg(*first), "places")
    right = staged(ranges.select(*[col(c) for c in dict.fromkeys([*on, *by, low, high])]), "ranges")
    blocks = _blocks(right, low, high, on, by)
    listed = _listed(left, blocks, on)
    sums = listed.groupBy(*at[:-1], "pp", "kk").agg(*merged)
    found = sums.join(blocks, _same_block(on)).select(*[col(f"_b_{c}") for c in by], *parts)
    if how in ("right", "full"):
        found = found.unionByName(right.select(*[col(c).alias(f"_b_{c}") for c in by]), allowMissingColumns=True)
    if how in ("left", "full"):
        alone = left.join(listed.select(*at).distinct(), at, "left_anti").select(*[col(f"_p_{c}").alias(f"_b_{c}") for c in by if c in on], *parts)
        found = found.unionByName(alone, allowMissingColumns=True)
    grouped = found.groupBy(*[col(f"_b_{c}") for c in by]).agg(*merged)
    counted = lambda name, kind: F.coalesce(col(f"_t_{name}"), F.lit(0)) if kind == "count" else col(f"_t_{name}").cast(left.schema[f"_t_{name}"].dataType)
    return grouped.select(*[col(f"_b_{c}").alias(c) for c in by], *[counted(name, kind).alias(name) for name, (kind, _) in totals.items()])

"""Exact quantiles of groups of any size, by counting instead of sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..columns import col
from ..errors import SpecError
from ..session import delete_path, staged


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], bins: int = 4096, limit: int = 10_000) -> DataFrame:
    """(keys, share, quantile) for each group and each of ``shares`` (0 to 1), interpolated between neighbouring values.

    Each pass counts the rows of every group in ``bins`` equal parts of what is left of its range, before the shuffle
    too, and goes on in the parts that hold a wanted rank; their bounds are the values found there, so a value that
    repeats ends the search. Parts of at most ``limit`` rows, or that one pass could not divide, are settled by
    counting their distinct values. No group is held or sorted by one task.

    ``value`` is a number. NULL and NaN take no part; a group without values has no row. A NULL key is a key.
    """
    if not isinstance(df.schema[value].dataType, T.NumericType):
        raise SpecError(f"{value} is not a number")
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise SpecError("shares must lie between 0 and 1")
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[col(k).alias(n) for k, n in zip(keys, names)], col(value).alias("v")).where(~F.isnan(col("v").cast("double")) & F.col("v").isNotNull())
    rows = staged(rows, "values")
    whole = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.explode(F.array(*[F.lit(float(s)) for s in dict.fromkeys(shares)])).alias("share")
    exact = F.col("share") * (F.col("n") - 1)
    wanted = staged(whole.select(*names, "n", "low", "high", at).withColumn("exact", exact), "wanted")
    ranks = F.explode(F.array_distinct(F.array(F.floor("exact"), F.ceil("exact")))).alias("rank")
    # open: the part (low, high) of n rows that holds the rank, counted from 0 within it (at)
    search = staged(wanted.select(*names, "low", "high", "n", ranks).distinct().withColumn("at", F.col("rank")), "search")
    done: list[DataFrame] = []
    paths = [rows.staged_path, wanted.staged_path, search.staged_path]
    while True:
        settled = search.where("low = high")
        done.append(settled.select(*names, "rank", F.col("low").alias("v")))
        small = search.where(F.col("low") < F.col("high")).where(F.col("n") <= limit)
        done.append(_count_values(rows, small, names))
        search = search.where(F.col("low") < F.col("high")).where(F.col("n") > limit)
        if search.isEmpty():
            break
        parts = search.select(*names, "low", "high", F.col("n").alias("size")).distinct()
        width = F.col("high").cast("double") - F.col("low").cast("double")
        place = F.least(F.floor(F.try_divide(F.col("v").cast("double") - F.col("low").cast("double"), width) * bins), F.lit(bins - 1))
        met = _within(rows, parts, names).withColumn("bin", F.coalesce(place, F.lit(0)))
        counts = met.groupBy(*names, "low", "high", "size", "bin").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = Window.partitionBy(*names, "low", "high").orderBy("bin")  # at most ``bins`` rows
        summed = counts.withColumn("end", F.sum("c").over(upto)).withColumn("start", F.col("end") - F.col("c"))
        inside = _same(names, "s_", "") & (F.col("s_low") == F.col("low")) & (F.col("s_high") == F.col("high")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))
        asked = search.select(*[F.col(n).alias(f"s_{n}") for n in names], F.col("low").alias("s_low"), F.col("high").alias("s_high"), "rank", "at")
        next_search = asked.join(summed, inside).select(*names, F.col("least").alias("low"), F.col("most").alias("high"), F.col("c").alias("n"), "rank", (F.col("at") - F.col("start")).alias("at"), (F.col("c") == F.col("size")).alias("stuck"))
        next_search = staged(next_search, "search")
        paths.append(next_search.staged_path)
        done.append(_count_values(rows, next_search.where("stuck AND low < high").where(F.col("n") > limit), names))
        search = next_search.where(~(F.col("stuck") & (F.col("low") < F.col("high")) & (F.col("n") > limit))).drop("stuck")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    found = staged(found.distinct(), "found")
    low, high = (found.select(*[F.col(n).alias(f"{side}_{n}") for n in names], F.col("rank").alias(f"{side}_rank"), F.col("v").cast("double").alias(f"{side}_v")) for side in ("l", "h"))
    both = wanted.join(low, _same(names, "l_", "") & (F.col("l_rank") == F.floor("exact"))).join(high, _same(names, "h_", "") & (F.col("h_rank") == F.ceil("exact")))
    quantile = F.col("l_v") + (F.col("h_v") - F.col("l_v")) * (F.col("exact") - F.floor("exact"))
    out = staged(both.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "share", quantile.alias("quantile")), "quantiles")
    for path in [*paths, found.staged_path]:
        delete_path(df.sparkSession, path)
    return out


def _same(names: Sequence[str], left: str, right: str):
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}{n}").eqNullSafe(F.col(f"{right}{n}"))
    return out


def _within(rows: DataFrame, parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with the parts of their group that hold them. A large group is a skewed join side, which Spark splits."""
    own = parts.select(*[F.col(n).alias(f"p_{n}") for n in names], *[c for c in parts.columns if c not in names])
    return rows.join(own, _same(names, "p_", "") & F.col("v").between(F.col("low"), F.col("high"))).drop(*[f"p_{n}" for n in names])


def _count_values(rows: DataFrame, small: DataFrame, names: Sequence[str]) -> DataFrame:
    """(names, rank, v) of the ranks in ``small``, by counts of the distinct values of their parts."""
    parts = small.select(*names, "low", "high").distinct()
    counts = _within(rows, parts, names).groupBy(*names, "low", "high", "v").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*names, "low", "high").orderBy("v")
    summed = counts.withColumn("end", F.sum("c").over(upto)).withColumn("start", F.col("end") - F.col("c"))
    asked = small.select(*[F.col(n).alias(f"s_{n}") for n in names], F.col("low").alias("s_low"), F.col("high").alias("s_high"), "rank", "at")
    inside = _same(names, "s_", "") & (F.col("s_low") == F.col("low")) & (F.col("s_high") == F.col("high")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))
    return asked.join(summed, inside).select(*names, "rank", "v")

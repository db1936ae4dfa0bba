"""Windows over keys of any size: a segmented scan.

``Window.partitionBy(key)`` sorts all rows of a key in one task. Here the rows are dealt into ranges of (key, order),
each at most a task's share, so that one key may lie in many of these pieces. Windows run within a piece; what a piece
needs of the earlier ones of its key is one row of partial results. A piece shares at most its first and its last key
with others, so these carried rows number at most twice the pieces and can be broadcast whatever the data.

``Segments`` lays the rows out once; its methods add columns and return a new ``Segments`` over the same layout:

    s = Segments(events, ["user_id"], ["ts"], tie=["event_id"])
    s.row_number("n").running({"spent": ("sum", "value")}).moving(6, 0, {"week": F.avg("value")}).frame()
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..columns import col
from ..errors import SpecError
from ..session import delete_path, staged

PIECE, TIE, NUMBER = "_segment_piece", "_segment_tie", "_segment_number"


def _add(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


# kind: (aggregate of rows, aggregate of partial results, what two partial results give, the earlier one first)
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, F.sum, _add),
    "count": (F.count, F.sum, _add),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
    "bit_xor": (F.bit_xor, F.bit_xor, lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b)),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda c: F.first(c, ignorenulls=True), lambda a, b: F.coalesce(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


class Segments:
    """Rows of ``df`` in the order of ``order`` within ``keys``, in pieces that windows can work on separately.

    ``order`` names columns; a leading ``-`` turns the direction. NULLs come first, last where the direction is turned.
    ``tie`` names columns that make (keys, order, tie) unique. Without them the rows are staged once more and ties
    are taken in the order of the staged files, so rows may differ in nothing and still be split. A NULL key is a key.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: Sequence[str] = (), pieces: int | None = None):
        clash = {PIECE, TIE, NUMBER} & set(df.columns)
        if clash:
            raise SpecError(f"columns {sorted(clash)} are names this operator uses")
        self._keys, self._order = list(keys), [o.removeprefix("-") for o in order]
        self._paths: list[str] = []
        if not tie:
            df = self._keep(df, "unsorted").withColumn(TIE, F.monotonically_increasing_id())  # over files, so a repeated task gives it again
        sort = [_direction(o) for o in [*order, *(tie or [TIE])]]
        n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(n, *[col(k) for k in keys], *sort).withColumn(PIECE, F.spark_partition_id())
        self._rows = self._keep(dealt, "segments")
        self._extra = [PIECE, *([] if tie else [TIE])]
        self._within = Window.partitionBy(*[col(k) for k in keys], PIECE).orderBy(*sort)
        self._numbered = False
        self._edges = self._keep(self._last_keys(), "edges") if keys else None

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        self._paths.append(out.staged_path)
        return out

    def _last_keys(self) -> DataFrame:
        """The last key of each piece: only those go on in the next. As many rows as pieces at most."""
        last = self._rows.groupBy(PIECE).agg(F.max(F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(self._keys)])).alias("last"))
        return last.select("last.*").distinct()

    def _with(self, rows: DataFrame, **changes) -> Segments:
        out = copy.copy(self)
        out._rows = rows
        for name, value in changes.items():
            setattr(out, name, value)
        return out

    def _carried(self, aggregates: dict[str, tuple[Column, Callable[[Column], Column]]], ordered: bool) -> DataFrame:
        """The rows with ``_before_<name>``, merged over the earlier pieces of the key, and ``_whole_<name>``, over all.

        Both are NULL where the key lies in one piece; at most two rows a piece are joined.
        """
        rows, keys = self._rows, self._keys
        as_keys = [col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
        crossing = rows
        if keys:
            same = [col(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)]
            crossing = rows.join(F.broadcast(self._edges), _all(same), "left_semi")
        if ordered:  # what the last row of a piece has seen
            upto = self._within.rowsBetween(Window.unboundedPreceding, 0)
            ends = F.lead(F.lit(1)).over(self._within)
            seen = crossing.select(*as_keys, F.col(PIECE).alias("_of"), ends.alias("_goes_on"), *[a.over(upto).alias(name) for name, (a, _) in aggregates.items()])
            partial = seen.where(F.col("_goes_on").isNull()).drop("_goes_on")
        else:
            partial = crossing.groupBy(*as_keys, F.col(PIECE).alias("_of")).agg(*[a.alias(name) for name, (a, _) in aggregates.items()])
        by_key = Window.partitionBy(*[f"_key_{i}" for i in range(len(keys))])
        before = by_key.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
        every = by_key.orderBy("_of").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carried = partial.select(
            *[f"_key_{i}" for i in range(len(keys))], "_of",
            *[merge(F.col(name)).over(before).alias(f"_before_{name}") for name, (_, merge) in aggregates.items()],
            *[merge(F.col(name)).over(every).alias(f"_whole_{name}") for name, (_, merge) in aggregates.items()],
        )
        met = [F.col(PIECE) == F.col("_of"), *[col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]]
        return rows.join(F.broadcast(carried), _all(met), "left").drop("_of", *[f"_key_{i}" for i in range(len(keys))])

    def running(self, columns: dict[str, tuple[str, str | Column]]) -> Segments:
        """Add aggregates from the first row of the key to this one: ``{name: (kind, column)}``.

        Kinds: sum, count, min, max, bit_xor, first and last (both pass over NULLs). Each passes over NULLs like the
        aggregate of that name.
        """
        parts = {}
        for name, (kind, of) in columns.items():
            if kind not in KINDS:
                raise SpecError(f"no running {kind!r}; known: {sorted(KINDS)}")
            parts[name] = (KINDS[kind], col(of) if isinstance(of, str) else of)
        joined = self._carried({name: (rows(of), merge) for name, ((rows, merge, _), of) in parts.items()}, _ordered(columns))
        upto = self._within.rowsBetween(Window.unboundedPreceding, 0)
        added = [both(F.col(f"_before_{name}"), rows(of).over(upto)).alias(name) for name, ((rows, _, both), of) in parts.items()]
        return self._with(self._finish(joined, parts, added))

    def total(self, columns: dict[str, tuple[str, str | Column]]) -> Segments:
        """Add aggregates over all rows of the key, of the kinds of ``running``."""
        parts = {name: (KINDS[kind], col(of) if isinstance(of, str) else of) for name, (kind, of) in columns.items()}
        joined = self._carried({name: (rows(of), merge) for name, ((rows, merge, _), of) in parts.items()}, _ordered(columns))
        piece = self._within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        added = [F.coalesce(F.col(f"_whole_{name}"), rows(of).over(piece)).alias(name) for name, ((rows, _, _), of) in parts.items()]
        return self._with(self._finish(joined, parts, added))

    def _finish(self, joined: DataFrame, names, added: list[Column]) -> DataFrame:
        helpers = {f"_{side}_{n}" for n in names for side in ("before", "whole")}
        taken = [a for a in joined.columns if a not in helpers and a not in names]
        return joined.select(*[col(c) for c in taken], *added)

    def row_number(self, name: str = "row_number") -> Segments:
        """Add the number of the row within its key, from 1."""
        return self.running({name: ("count", F.lit(1))})

    def rank(self, name: str = "rank", dense: str | None = None) -> Segments:
        """Add the rank by ``order`` alone: rows equal in it share the number of the first of them; ``dense`` without gaps."""
        values = F.struct(*[col(o).alias(f"v{i}") for i, o in enumerate(self._order)])
        joined = self._carried({"_peer": (F.last(values), F.last)}, ordered=True)
        first = F.row_number().over(self._within) == 1
        previous = F.when(first, F.col("_before__peer")).otherwise(F.lag(values).over(self._within))
        marked = joined.withColumn("_new", ~values.eqNullSafe(previous)).drop("_before__peer", "_whole__peer")
        out = self._with(marked).row_number("_place")
        columns = {name: ("max", F.when(F.col("_new"), F.col("_place")))}
        if dense:
            columns[dense] = ("sum", F.col("_new").cast("long"))
        out = out.running(columns)
        return self._with(out._rows.drop("_new", "_place"))

    def moving(self, preceding: int, following: int, columns: dict[str, Column], block: int = 100_000) -> Segments:
        """Add aggregates over the ``preceding`` rows before, the row itself and the ``following`` ones after it."""
        return self._in_blocks(preceding, following, block, {n: lambda w, c=c: c.over(w.rowsBetween(-preceding, following)) for n, c in columns.items()})

    def shift(self, columns: dict[str, tuple[str, int, object]], block: int = 100_000) -> Segments:
        """Add the values of other rows of the key: ``{name: (column, rows back, value if there is none)}``; back < 0 looks ahead."""
        back, ahead = max(0, *[b for _, b, _ in columns.values()]), max(0, *[-b for _, b, _ in columns.values()])
        return self._in_blocks(back, ahead, block, {n: lambda w, c=c, b=b, d=d: F.lag(col(c), b, d).over(w) for n, (c, b, d) in columns.items()})

    def _in_blocks(self, preceding: int, following: int, block: int, columns: dict[str, Callable[[WindowSpec], Column]]) -> Segments:
        """Windows over blocks of ``block`` row numbers, each with the rows around it that its own need."""
        size = max(block, preceding + following, 1)
        at = self if self._numbered else self.row_number(NUMBER)
        number = F.col(NUMBER) - 1
        near = F.sequence(F.floor(F.greatest(number - following, F.lit(0)) / size), F.floor((number + preceding) / size))
        copies = at._rows.withColumn("_block", F.explode(near))
        around = Window.partitionBy(*[col(k) for k in self._keys], "_block").orderBy(NUMBER)
        kept = [c for c in at._rows.columns if c not in columns]
        rows = copies.select(*[col(c) for c in kept], "_block", *[make(around).alias(name) for name, make in columns.items()])
        return self._with(rows.where(F.col("_block") == F.floor(number / size)).drop("_block"), _numbered=True)

    def relaid(self, rows: DataFrame, order: Sequence[str]) -> Segments:
        """The same pieces over other rows with the keys and ``PIECE`` column of this layout, in an order of their own.

        ``order`` must be unique within a key and must not contradict the order of the pieces.
        """
        within = Window.partitionBy(*[col(k) for k in self._keys], PIECE).orderBy(*[_direction(o) for o in order])
        return self._with(rows, _order=[o.removeprefix("-") for o in order], _within=within, _extra=[PIECE], _numbered=False)

    def rows(self) -> DataFrame:
        """The rows with the ``PIECE`` column of the layout, for ``relaid``."""
        return self._rows

    def frame(self) -> DataFrame:
        """The rows with all added columns. They read the staged layout, so ``close`` comes after they are used."""
        return self._rows.drop(*self._extra, *([NUMBER] if self._numbered else []))

    def settled(self) -> Segments:
        """The same rows written, so that later steps don't compute the columns added so far once more."""
        return self._with(self._keep(self._rows, "settled"))

    def close(self) -> None:
        """Delete the staged layout."""
        for path in self._paths:
            delete_path(self._rows.sparkSession, path)


def _ordered(columns: dict[str, tuple[str, str | Column]]) -> bool:
    return any(kind in ("first", "last") for kind, _ in columns.values())


def _direction(name: str) -> Column:
    return col(name[1:]).desc_nulls_last() if name.startswith("-") else col(name).asc_nulls_first()


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out

"""Exact top-k by distributed histogram selection.

For a block of queries every task scores all its candidates and counts, for each query, how many fall into each bin
of a score range. The sums over all tasks tell which bin holds the k-th best score; the next round looks only into
that bin, until it is one score wide. Then the scores from there up are kept and ties go to the smaller id. A task
reports only its own k best of a range, since lower bins can't hold the k-th best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from millrace.llm.stage import forget, written

BINS = 1 << 12
ROWS = 128  # queries scored at once
COLUMNS = 4096  # candidates scored at once
EXACT = 1 << 53
RESULT = "query_id long, rank int, vec_id long, score long"


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float64)


def prepared(vectors: DataFrame, factor: int) -> DataFrame:
    """vec_id and the integer components (as doubles) of vectors without null or non-finite components."""
    x = F.col("embedding")
    whole = F.col("embedding").isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL").where(whole).select(
        "vec_id", F.transform("embedding", lambda v: F.floor(v * factor).cast("double")).alias("v")
    )


def scored(batches: Iterator[pa.RecordBatch], queries: np.ndarray, ids: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(queries, candidate ids, scores) in pieces of bounded size; a query's own row scores minus infinity."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own, x = batch.column("vec_id").to_numpy(), matrix(batch.column("v"), queries.shape[1])
        for a in range(0, len(own), COLUMNS):
            part, columns = own[a : a + COLUMNS], x[a : a + COLUMNS].T.copy()
            order = np.argsort(part, kind="stable")
            for b in range(0, len(ids), ROWS):
                rows = slice(b, min(b + ROWS, len(ids)))
                scores = queries[rows] @ columns
                low, high = np.searchsorted(part[order], ids[rows]), np.searchsorted(part[order], ids[rows], "right")
                for i in np.flatnonzero(high > low):
                    scores[i, order[low[i] : high[i]]] = -np.inf
                yield rows, part, scores


def histogram_rows(shared: Broadcast, low: np.ndarray, width: np.ndarray, top: np.ndarray, k: int):
    """Counts by query and bin of scores in [low, top], from the best bin down to the one with the task's k-th."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        floor, bins = low.copy(), [{} for _ in ids]
        for own, _, scores in scored(batches, queries, ids):
            q, c = np.nonzero((scores >= floor[own][:, None]) & (scores <= top[own][:, None]))
            if not len(q):
                continue
            bin_of = ((scores[q, c] - low[own][q]) // width[own][q]).astype(np.int64)
            key, count = np.unique(q * BINS + bin_of, return_counts=True)
            for one in np.unique(key // BINS):
                mine, counts = bins[own.start + one], slice(*np.searchsorted(key, [one * BINS, (one + 1) * BINS]))
                for b, n in zip((key[counts] % BINS).tolist(), count[counts].tolist()):
                    mine[b] = mine.get(b, 0) + n
                seen = 0
                for b in sorted(mine, reverse=True):
                    if seen >= k:
                        del mine[b]
                    else:
                        seen += mine[b]
                if seen >= k:
                    floor[own.start + one] = low[own.start + one] + min(mine) * width[own.start + one]
        flat = [(i, b, n) for i, mine in enumerate(bins) for b, n in mine.items()]
        if flat:
            q, b, n = (np.array(x) for x in zip(*flat))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n.astype(np.int64))], ["q", "bin", "n"])

    return rows


def best_rows(shared: Broadcast, least: np.ndarray, k: int):
    """A task's scores of at least ``least``, for each query the k best, ties to the smaller id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        held = [np.zeros((0, 2)) for _ in ids]
        numbers = [np.zeros(0, np.int64) for _ in ids]
        for own, part, scores in scored(batches, queries, ids):
            q, c = np.nonzero((scores >= least[own][:, None]) & np.isfinite(scores))
            for one in np.unique(q):
                i, at = own.start + one, c[q == one]
                score, number = np.r_[held[i][:, 0], scores[one, at]], np.r_[numbers[i], part[at]]
                order = np.lexsort((number, -score))[:k]
                held[i], numbers[i] = np.stack([score[order]] * 2, axis=1), number[order]
        n = [len(x) for x in numbers]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, n)), pa.array(np.concatenate(numbers)), pa.array(np.concatenate([h[:, 0] for h in held]).astype(np.int64))], ["query_id", "vec_id", "score"]
            )

    return rows


def kth_scores(candidates: DataFrame, shared: Broadcast, reach: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query (minus infinity if there are fewer), by histograms that narrow."""
    n = len(shared.value[0])
    low, top = -reach, reach.copy()
    missing = np.full(n, k)
    while True:
        width = np.maximum(1, -(-(top - low + 1) // BINS))
        counts = (
            candidates.mapInArrow(histogram_rows(shared, low, width, top, k), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), False).alias("bins"))
        )
        running = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("above"), F.lit(-1).alias("bin")), lambda s, x: F.when((s["bin"] >= 0) | (s["above"] + x["n"] < F.col("k")), F.struct((F.when(s["bin"] >= 0, s["above"]).otherwise(s["above"] + x["n"])).alias("above"), s["bin"].alias("bin"))).otherwise(F.struct(s["above"].alias("above"), x["bin"].alias("bin"))))
        wanted = candidates.sparkSession.createDataFrame(pa.table({"q2": np.arange(n, dtype=np.int32), "k": missing.astype(np.int64)}))
        found = counts.join(F.broadcast(wanted), F.col("q") == F.col("q2")).select("q", running.alias("r")).select("q", "r.above", "r.bin").collect()  # a row for each query of the block
        settled = np.ones(n, bool)
        for r in found:
            if r.bin >= 0:
                low[r.q] += r.bin * width[r.q]
                top[r.q] = min(top[r.q], low[r.q] + width[r.q] - 1)
                missing[r.q] -= r.above
                settled[r.q] = width[r.q] == 1
            else:
                low[r.q] = top[r.q] = -np.inf
        seen = np.zeros(n, bool)
        seen[[r.q for r in found]] = True
        low[~seen] = top[~seen] = -np.inf
        if settled.all():
            return low
        low = np.where(np.isfinite(low), low, reach + 1)
        top = np.where(np.isfinite(top), top, reach)
        fewer = low > top
        if fewer.any():  # fewer than k candidates: all of them count
            low[fewer], top[fewer] = -reach[fewer], -reach[fewer] - 1


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, factor: int = 256, block: int = 4096) -> DataFrame:
    """The ``k`` best inner products of each query with all rows but its own: query_id, rank, vec_id, score.

    Components are floor(factor * x). Queries are the rows whose vec_id is divisible by ``every``; they are taken in
    blocks of at most ``block``, which bounds what is broadcast. Ties go to the smaller vec_id; with fewer than k
    candidates all are returned. Vectors that are null, empty or hold null or non-finite components take no part, nor
    do rows without an id; all others must have one length. A query meets no row of its own id, so rows repeating an
    id are one query each and no candidates of each other. No queries give no rows.
    """
    candidates = written(prepared(vectors, factor), "vectors")
    spark = candidates.sparkSession
    facts = candidates.agg(F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("least"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm")).first()
    if facts.d is None:
        forget(candidates)
        return spark.createDataFrame([], RESULT)
    if facts.d != facts.least:
        raise ValueError(f"vectors have between {facts.least} and {facts.d} components")
    queries = candidates.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // (block // 2)))
    out = None
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").toArrow()
        if not rows.num_rows:
            continue
        ids, x = rows.column("vec_id").to_numpy(), matrix(rows.column("v").combine_chunks(), facts.d)
        reach = np.ceil(np.linalg.norm(x, axis=1) * facts.norm * (1 + 1e-9)) + 1
        if reach.max() >= EXACT:
            raise ValueError("scores of this size are not exact in doubles")
        shared = spark.sparkContext.broadcast((ids, x))
        best = written(candidates.mapInArrow(best_rows(shared, kth_scores(candidates, shared, reach, k), k), "query_id long, vec_id long, score long"), "best")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], RESULT)
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
    return out.groupBy("query_id").agg(first.alias("best")).select("query_id", F.posexplode("best").alias("place", "one")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "one.vec_id", (-F.col("one.minus")).alias("score")
    )

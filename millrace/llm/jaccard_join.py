"""Exact Jaccard join of shingle sets by a partition of their universe.

Two sets of sizes a and b that are similar enough differ in at most H shingles. Sets of like size form a band; a hash
deals the universe of a band into segments, so of any H + 1 segments one is equal in both. Each set is indexed under
as many of its segments as it may differ from a partner in shingles, plus one. Segments without a shingle say nothing
and are passed over: every set then takes the next ones. The segments a set takes are a run from the first on, so of
two sets the shorter run lies in both, and it has enough segments that are not empty (or is all of them).

Sets that meet are tried in two steps. First each against the least one of its key, a star; links make components.
Only keys whose sets are still in different components go on: there, pairs of neighbouring segments are blocks, and a
block is indexed by its two segments or, where those keep too many sets together, by the whole block and all it gives
by leaving out one shingle. Both find any two sets that differ in at most one shingle of the block; what is cheaper
by the counts of all sets is taken. Every pair is compared exactly before it links, after bounds that cost little:
shingles flip bits of a word, and sets differ in at least as many shingles as their words do in bits; shingles that
no other such set has are in no intersection.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm import kernels as K
from millrace.llm.components import components
from millrace.llm.minhash_dedup import compare, shingles
from millrace.llm.repeats import beside, keyed
from millrace.llm.stage import forget, texts_of, written

WORD_BITS = 512
WORDS = [f"w{i}" for i in range(WORD_BITS // 64)]  # a set's word of bits folded to this length, to be compared inside a join
LEAF = ["cls", "label", "n", "most", *WORDS]


class Bands:
    """Bands of set sizes and, for each, how many segments it has. Partners of a set are in its own band or the ones beside it."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        lows = [1, 2]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, -(-lows[-1] * 10_000 // percent**2)))
        self.lows = np.array(lows)
        highs = self.lows[1:] - 1
        most = self.differing(highs, highs * 100 // percent) + 1
        self.segments = np.r_[most + 1 + most // 8, 0]
        self.highs = np.r_[highs, largest]

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many shingles two linked sets of these sizes may differ in."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def roles(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which sets, their band, how many segments they take): in the band of the smaller partner, so first as that
        one and then as the larger. Sets that link with no other set take none."""
        band = np.searchsorted(self.lows, n, "right") - 1
        take = self.differing(n, n * 100 // self.percent) + 1
        at = np.flatnonzero((n > 0) & (take > 1))
        yield at, band[at], take[at]
        below = np.maximum(band - 1, 0)
        at = np.flatnonzero((n > 0) & (band > 0) & (self.highs[below] * 100 >= n * self.percent))
        take = self.differing(n, n) + 1
        at = at[take[at] > 1]
        yield at, below[at], take[at]


class Segments:
    """The segments that some sets take in one role, as flat arrays: ``owner`` (the set), ``band``, ``number``, ``key``.

    ``cell`` of a shingle is the flat place of its segment before any is passed over; ``place`` leads from what is
    taken to those.
    """

    def __init__(self, bands: Bands, h: np.ndarray, offsets: np.ndarray, at: np.ndarray, band: np.ndarray, take: np.ndarray):
        m = bands.segments[band]
        first = np.r_[0, np.cumsum(m)]
        n = np.diff(offsets)[at]
        which = np.repeat(np.arange(len(at)), n)
        tokens = np.arange(len(which)) + np.repeat(offsets[at] - (np.cumsum(n) - n), n)
        self.values = K.mix(h[tokens])
        spread = K.mix(h[tokens] + band[which].astype(np.uint64) * K.BASE)
        self.cell = first[which] + ((spread >> np.uint64(32)) * m[which].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        self.sums, self.counts = np.zeros(first[-1], np.uint64), np.bincount(self.cell, minlength=first[-1])
        np.add.at(self.sums, self.cell, self.values)
        full = self.counts > 0
        seen = np.r_[0, np.cumsum(full)]
        owner = np.repeat(np.arange(len(at)), m)
        rank = seen[:-1] - seen[first[owner]]
        enough = (seen[first[1:]] - seen[first[:-1]] >= take)[owner]
        self.place = np.flatnonzero(np.where(enough, full & (rank < take[owner]), True))
        self.owner, self.band = at[owner[self.place]], band[owner[self.place]]
        self.number = self.place - first[owner[self.place]]
        self.first, self.cell_owner = first, owner
        self.key = self.hashed(self.sums[self.place], self.counts[self.place], self.band, 2 * self.number)

    @staticmethod
    def hashed(sums: np.ndarray, counts: np.ndarray, band: np.ndarray, number: np.ndarray) -> np.ndarray:
        return K.mix(K.mix(sums + counts.astype(np.uint64)) ^ K.mix((band.astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)))


def bit_words(h: np.ndarray, offsets: np.ndarray, bands: Bands) -> list[bytes]:
    """One word of bits per set, four for each shingle it may differ in; a word folds into any shorter one by xor."""
    n = np.diff(offsets)
    size = np.maximum(WORD_BITS, 1 << np.ceil(np.log2(np.maximum(4 * bands.differing(n, n), 1))).astype(np.int64))
    spread = (K.mix(h ^ np.uint64(0x5BD1E995)) & (np.repeat(size, n) - 1).astype(np.uint64)).astype(np.int64)
    out = []
    for i in range(len(n)):
        odd = np.bincount(spread[offsets[i] : offsets[i + 1]], minlength=size[i]) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def set_rows(size: int, bands: Bands):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                h, offsets = shingles(texts, size)
                n = np.diff(offsets)
                words = bit_words(h, offsets, bands)
                folded = np.array([np.bitwise_xor.reduce(np.frombuffer(w, np.int64).reshape(-1, len(WORDS)), axis=0) for w in words]).reshape(-1, len(WORDS))
                own = batch.slice(texts.first, texts.n)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("th"), pa.array(n.astype(np.int64)), K.signed(set_hash(h, offsets)), pa.array(words, pa.binary()), *map(pa.array, folded.T.copy())],
                    ["doc_id", "th", "n", "cls", "bits", *WORDS],
                )

    return rows


def set_hash(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[np.uint64(0), np.cumsum(K.mix(h + K.BASE))]
    return K.mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def segment_rows(size: int, bands: Bands):
    """(key, cls) of every segment a set takes. Copies in one task count once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                h, offsets = shingles(texts, size)
                cls = set_hash(h, offsets).view(np.int64)
                new = np.array([c not in seen and not seen.add(c) for c in cls.tolist()], bool)
                for at, band, take in bands.roles(np.where(new, np.diff(offsets), 0)):
                    s = Segments(bands, h, offsets, at, band, take)
                    yield pa.RecordBatch.from_arrays([K.signed(s.key), pa.array(cls[s.owner])], ["key", "cls"])

    return rows


def block_rows(size: int, bands: Bands, whole: set[tuple[int, int]] | None):
    """The keys of blocks: (key, LEAF, band, block, entries). ``whole`` has the blocks that are indexed as one.

    Without it, the segments alone, each with the shingles of its block; with it what the allocation says.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.array(sorted(b << 32 | x for b, x in whole or ()), np.int64)
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                h, offsets = shingles(texts, size)
                for at, band, take in bands.roles(np.diff(offsets)):
                    s = Segments(bands, h, offsets, at, band, take)
                    as_whole = np.isin(s.band.astype(np.int64) << 32 | s.number // 2, codes)
                    parts = [(s.key[~as_whole], s.owner[~as_whole], s.band[~as_whole], s.number[~as_whole] // 2, block_sizes(s)[~as_whole])]
                    if as_whole.any():
                        parts.append(neighbourhoods(s, bands, as_whole))
                    for key, owner, b, block, entries in parts:
                        own = [batch.column(c).take(pa.array(owner + texts.first)) for c in LEAF]
                        yield pa.RecordBatch.from_arrays(
                            [K.signed(key), *own, pa.array(b.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(entries.astype(np.int64))],
                            ["key", *LEAF, "band", "block", "entries"],
                        )

    return rows


def block_ends(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """The flat places of the two segments of each taken one's block; the second may lie beyond the set's last segment."""
    one = s.place - s.number % 2
    return one, np.minimum(one + 1, s.first[s.cell_owner[s.place] + 1] - 1)


def block_sizes(s: Segments) -> np.ndarray:
    one, two = block_ends(s)
    return s.counts[one] + np.where(two > one, s.counts[two], 0)


def neighbourhoods(s: Segments, bands: Bands, as_whole: np.ndarray):
    """The whole of each chosen block and, for each of its shingles, the block without it."""
    one, two = (x[as_whole] for x in block_ends(s))
    start, first = np.unique(one, return_index=True)
    two = two[first]
    sums = s.sums[start] + np.where(two > start, s.sums[two], np.uint64(0))
    counts = s.counts[start] + np.where(two > start, s.counts[two], 0)
    owner, band, number = s.owner[as_whole][first], s.band[as_whole][first], (s.number[as_whole] // 2)[first]
    at = np.searchsorted(start, s.cell, "right") - 1
    inside = (at >= 0) & (s.cell <= two[np.maximum(at, 0)])
    at, values = at[inside], s.values[inside]
    own = Segments.hashed(sums, counts, band, 2 * number + 1)
    less = Segments.hashed(sums[at] - values, counts[at] - 1, band[at], 2 * number[at] + 1)
    put = lambda x: np.concatenate([x, x[at]])
    return np.concatenate([own, less]), put(owner), put(band), put(number), put(counts + 1)


def promising(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and words of bits allow a link."""
    one, two = (sets.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"), *[F.col(w).alias(f"{w}_{x}") for w in WORDS]) for x in "ab")
    met = pairs.join(one, "a").join(two, "b").where(may_link("a", "b", percent))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            most = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (100 - percent) // (100 + percent)
            for x, y, h in zip(batch.column("bits_a"), batch.column("bits_b"), most):
                x, y = sorted((np.frombuffer(v.as_py(), np.uint64) for v in (x, y)), key=len)
                y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= h)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(rows, "a long, b long")


def stars(meetings: DataFrame) -> DataFrame:
    """Pairs (a, b): each set of a key with the one of them that meets most others over all keys, each pair once."""
    degrees = meetings.groupBy(F.col("cls").alias("of")).agg(F.sum("size").alias("degree"))
    ranked = written(meetings.join(degrees, F.col("cls") == F.col("of")).select("key", "cls", "degree"), "ranked")
    centres = written(ranked.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("degree", "cls")).alias("top")).select("k", F.col("top.cls").alias("centre")), "centres")
    met = ranked.join(centres, F.col("key") == F.col("k")).where("cls <> centre")
    return met.groupBy(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).agg(F.lit(1)).select("a", "b")


def gram_rows(size: int):
    """(h, cls) of every shingle of every set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                h, offsets = shingles(texts, size)
                own = pa.array(np.repeat(np.arange(texts.n), np.diff(offsets)) + texts.first)
                yield pa.RecordBatch.from_arrays([K.signed(h), batch.column("cls").take(own)], ["h", "cls"])

    return rows


def may_link(a: str, b: str, percent: int) -> Column:
    n = lambda x: F.col(f"n_{x}")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{w}_{a}").bitwiseXOR(F.col(f"{w}_{b}"))) for w in WORDS])
    return (F.least(n(a), n(b)) * 100 >= F.greatest(n(a), n(b)) * percent) & (differ * (100 + percent) <= (n(a) + n(b)) * (100 - percent))


def allocation(torn_segments: DataFrame, entry_cost: int) -> set[tuple[int, int]]:
    """The blocks (band, block) to index as one: where the pairs that their segments keep together cost more than the
    entries of their neighbourhoods. No more blocks than the longest sets have segments."""
    shared = torn_segments.groupBy("band", "block", "key").agg(F.count("*").alias("f"), F.sum("entries").alias("entries"))
    costs = shared.groupBy("band", "block").agg(F.sum(F.col("f") * (F.col("f") - 1) / 2).alias("pairs"), F.sum("entries").alias("entries"))
    return {(r.band, r.block) for r in costs.where(F.col("pairs") > entry_cost * F.col("entries")).toLocalIterator()}


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, entry_cost: int = 4) -> DataFrame:
    """Each document with the component of documents it is linked with: doc_id, th (a hash of the text), n_shingles, component_id.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; a document's set holds its distinct
    sequences of ``size`` words. Documents are linked when 100 * intersection >= ``percent`` * union, and every link
    is found. ``component_id`` is the smallest doc_id reachable. ``entry_cost`` says how many pairs looked at cost as
    much as one index entry.

    A null or empty text has no words and is linked with nothing. A text with fewer words than ``size`` has its whole
    sequence as one shingle. A null doc_id comes after all others. Rows that repeat id and text are documents of one
    set like other copies. Other columns are ignored. No rows give no rows.
    """
    d = keyed(texts_of(docs))
    longest = d.agg(F.max(F.octet_length("text"))).first()[0] or 0
    bands = Bands(percent, longest // 2 + 1)
    every = written(d.mapInArrow(set_rows(size, bands), f"doc_id long, th long, n long, cls long, bits binary, {', '.join(f'{w} long' for w in WORDS)}"), "sets")
    one = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "th", "n", "bits", *WORDS)).alias("one")
    classes = written(every.where("n > 0").groupBy("cls").agg(one).select("cls", "one.*"), "classes")
    segments = d.mapInArrow(segment_rows(size, bands), "key long, cls long")
    shared = segments.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("size")).where("low < high")
    shared = written(shared.select(F.col("key").alias("k"), "size"), "shared")
    meetings = written(segments.join(shared, F.col("key") == F.col("k")).select("key", "cls", "size").distinct(), "meetings")

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs that were compared and those of them that are links."""
        likely = written(promising(pairs, classes, percent), "likely")
        met = likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct().join(classes, "cls").select("cls", "doc_id", "th")
        texts = written(beside(d, met, "inner").select("cls", "text").dropDuplicates(["cls"]), "texts")
        compared = compare(likely, texts, size)
        forget(texts, likely)
        return compared, compared.where(F.col("common") * 100 >= F.col("total") * percent).select("a", "b")

    compared, edges = linked(stars(meetings))
    labels = components(edges)
    placed = meetings.join(labels, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("label", "cls").alias("label"))
    torn = written(placed.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("k"), "torn")
    leaves = placed.join(torn, F.col("key") == F.col("k")).select("cls", "label").distinct()
    leaves = leaves.join(classes, "cls").select("cls", "label", "n", *WORDS, "doc_id", "th")
    leaves = written(beside(d, leaves, "inner").select("cls", "label", "n", *WORDS, "text").dropDuplicates(["cls"]), "leaves")
    alone = leaves.select("cls", "text").mapInArrow(gram_rows(size), "h long, cls long").groupBy("h").agg(F.count("*").alias("sets"), F.max("cls").alias("cls"))
    alone = alone.where("sets = 1").groupBy(F.col("cls").alias("of")).agg(F.count("*").alias("alone"))
    able = leaves.join(alone, F.col("cls") == F.col("of"), "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0))).where(F.col("most") * 100 >= F.col("n") * percent)
    able = written(able.select(*LEAF, "text"), "able")
    kinds = f"key long, {', '.join(f'{c} long' for c in LEAF)}, band int, block int, entries long"
    exact = able.mapInArrow(block_rows(size, bands, None), kinds)
    chosen = allocation(exact.join(torn, F.col("key") == F.col("k")), entry_cost)
    entries = written(able.mapInArrow(block_rows(size, bands, chosen), kinds).drop("band", "block", "entries"), "entries")
    left, right = (entries.select(F.col("key").alias(f"key_{x}"), F.col("cls").alias(x), F.col("label").alias(f"l_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "most", *WORDS)]) for x in "ab")
    enough = F.least("most_a", "most_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    cross = left.join(right, (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.col("l_a") != F.col("l_b")) & enough & may_link("a", "b", percent))
    seen = compared.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    fresh = cross.select("a", "b").distinct().join(seen, (F.col("a") == F.col("low")) & (F.col("b") == F.col("high")), "left_anti")
    _, more = linked(fresh)
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    forget(shared, meetings, torn, leaves, able, entries)
    own = classes.join(labels, F.col("cls") == F.col("node"), "left").select(F.col("cls").alias("of"), F.coalesce("label", "cls").alias("component"), F.struct("no_id", "doc_id").alias("id"))
    firsts = own.groupBy(F.col("component").alias("c2")).agg(F.min("id").alias("first"))
    found = written(own.join(firsts, F.col("component") == F.col("c2")).select("of", F.col("first.doc_id").alias("first_doc")), "found")
    return every.join(found, F.col("cls") == F.col("of"), "left").select(
        "doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("first_doc")).alias("component_id")
    )

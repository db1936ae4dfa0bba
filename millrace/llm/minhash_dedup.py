"""Near-duplicate documents: one-permutation MinHash with optimal densification, bands, stars, exact confirmation.

One hash of each shingle gives both its bin and its value; an empty bin borrows from a bin it picks by hash, the same
one in every document that has it. Documents of one set are one class before anything is compared. Classes that agree
in a band share a bucket, and a bucket gives a star: its most connected class against the others, confirmed on full
sets. A star alone can miss links between its leaves. Classes of buckets that stars left in different components are
therefore joined once more, exactly, on their rarest shingles, with bounds that spare nearly all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm import kernels as K
from millrace.llm.components import components
from millrace.llm.repeats import beside, keyed
from millrace.llm.stage import forget, texts_of, written


def shingles(texts: K.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size`` lower-cased words, sorted within each text, and their offsets by text.

    A text with fewer words has one, its whole sequence; one without words has none.
    """
    words = K.Words(texts, lower=True)
    sums = K.prefix(words.hash)
    n = np.maximum(words.counts - size + 1, np.minimum(words.counts, 1))
    owner = np.repeat(np.arange(texts.n), n)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + words.offsets[owner]
    end = np.minimum(start + size, words.offsets[owner + 1])
    h = K.mix(K.span_hash(sums, start, end) + (end - start).astype(np.uint64))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, h = owner[new], h[new]
    return h, np.searchsorted(owner, np.arange(texts.n + 1))


def probes(bins: int) -> np.ndarray:
    """For each bin the order in which it asks other bins once it is empty."""
    rng = np.random.default_rng(77)
    return np.stack([rng.permutation(bins) for _ in range(bins)], axis=1)


def signatures(h: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """One value per text and bin, from sorted hashes; texts without shingles get zeros."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    bin_of = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    key = owner * bins + bin_of
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    values, full = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    values[key[first]], full[key[first]] = h[first], True
    empty = np.flatnonzero(~full & np.repeat(np.diff(offsets) > 0, bins))
    for step in probes(bins):
        if not len(empty):
            break
        source = empty // bins * bins + step[empty % bins]
        ok = full[source]
        values[empty[ok]] = values[source[ok]]
        empty = empty[~ok]
    return values.reshape(n, bins)


def sketch_rows(size: int, bands: int, rows_per_band: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                h, offsets = shingles(texts, size)
                n = np.diff(offsets)
                total = np.r_[np.uint64(0), np.cumsum(K.mix(h))]
                cls = K.mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64))
                grid = signatures(h, offsets, bands * rows_per_band).reshape(texts.n, bands, rows_per_band)
                mixed = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (texts.n, bands)).copy()
                for i in range(rows_per_band):
                    mixed = K.mix(mixed * K.BASE + grid[:, :, i])
                own = batch.slice(texts.first, texts.n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(texts.n + 1, dtype=np.int32) * bands), K.signed(mixed.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("th"), pa.array(n.astype(np.int64)), K.signed(cls), lists], ["doc_id", "th", "n_shingles", "cls", "bands"]
                )

    return rows


def overlap_rows(size: int):
    """Sizes of intersection and union for pairs of texts. Rows of one centre follow each other."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, known = None, None
        for batch in batches:
            a = batch.column("a").to_numpy()
            both = []
            for texts in K.slices(batch.column("text_b")):
                h, offsets = shingles(texts, size)
                for i in range(texts.n):
                    row = texts.first + i
                    if a[row] != centre:
                        own = next(K.slices(batch.column("text_a").slice(row, 1)))
                        centre, known = a[row], shingles(own, size)[0]
                    mine = h[offsets[i] : offsets[i + 1]]
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    common = int((known[at] == mine).sum())
                    both.append((common, len(known) + len(mine) - common))
            common, union = zip(*both) if both else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "total"]
            )

    return rows


def gram_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                h, offsets = shingles(texts, size)
                n = np.diff(offsets)
                own = pa.array(np.repeat(np.arange(texts.n), n) + texts.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cls").take(own), batch.column("label").take(own), pa.array(np.repeat(n, n)), K.signed(h)], ["cls", "label", "n", "h"]
                )

    return rows


def compare(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) of classes with the sizes of intersection and union of their full sets, written."""
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(overlap_rows(size), "a long, b long, common long, total long"), "compared")


def stars(buckets: DataFrame) -> DataFrame:
    """Each class of a bucket paired with the bucket's most connected class, each pair once."""
    centres = written(buckets.groupBy(F.col("k").alias("k2")).agg(F.max(F.struct("degree", "cls")).alias("top")).select("k2", F.col("top.cls").alias("centre")), "centres")
    return (
        buckets.join(centres, buckets.k == centres.k2)
        .where("cls <> centre")
        .groupBy(F.least("cls", "centre").alias("low"), F.greatest("cls", "centre").alias("high"))
        .agg(F.max("centre").alias("a"))
        .select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))
    )


def leaf_pairs(leaves: DataFrame, size: int, percent: int) -> DataFrame:
    """Every pair of ``leaves`` (cls, label, text) of different labels that can reach the threshold, each once.

    With shingles in one order, rarest first, linked sets share one among their first; its place in both bounds what
    they can have in common. The bound is checked first against the best place of a shingle, then in the join.
    """
    grams = written(leaves.mapInArrow(gram_rows(size), "cls long, label long, n long, h long"), "grams")
    common = grams.groupBy(F.col("h").alias("h2")).agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("cls").orderBy("df", "h")
    ranked = (
        grams.join(common, F.col("h") == F.col("h2"), "left")
        .select("cls", "label", "n", "h", F.coalesce("df", F.lit(1)).alias("df"))
        .withColumn("rest", F.col("n") - F.row_number().over(order) + 1)
        .where(F.col("df") > 1)
        .where(F.col("rest") * 100 >= F.col("n") * percent)
        .select("cls", "label", "n", "h", "rest")
    )
    first = written(ranked, "first_grams")
    best = first.groupBy(F.col("h").alias("h2")).agg(F.max(F.col("rest") / F.col("n")).alias("best"), F.count("*").alias("sharing")).where("sharing > 1")
    bound = 1 / (F.col("n") / F.col("rest") + 1 / F.col("best") - 1)
    able = written(first.join(best, F.col("h") == F.col("h2")).where(bound * 100 >= percent - 1e-6).select("cls", "label", "n", "h", "rest"), "able_grams")
    other = able.select(F.col("cls").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("h").alias("h_b"), F.col("rest").alias("rest_b"))
    able_to = F.least("rest", "rest_b") * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent
    pairs = able.join(other, (F.col("h") == F.col("h_b")) & (F.col("cls") < F.col("b")) & (F.col("label") != F.col("label_b")) & able_to)
    out = written(pairs.select(F.col("cls").alias("a"), "b").distinct(), "leaf_pairs")
    forget(grams, first, able)
    return out


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = 20, rows_per_band: int = 4) -> DataFrame:
    """Each document with the component of documents it is linked with.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; a document's set holds its distinct
    sequences of ``size`` words. Documents are linked when 100 * intersection >= ``percent`` * union of their full
    sets. Returns doc_id, th (a hash of the text), n_shingles, component_id (the smallest doc_id reachable) and
    ``kept``, true for one text of each component, one row per input row. At the default, bands miss a pair that
    just reaches the threshold about once in two million.

    A null or empty text has no words and is linked with nothing. A text with fewer words than ``size`` has its whole
    sequence as one shingle. A null doc_id comes after all others. Rows that repeat id and text are one document.
    Other columns are ignored. No rows give no rows.
    """
    d = keyed(texts_of(docs))
    sketches = written(
        d.mapInArrow(sketch_rows(size, bands, rows_per_band), "doc_id long, th long, n_shingles long, cls long, bands array<long>"), "sketches"
    )
    classes = written(
        sketches.where("n_shingles > 0").groupBy("cls").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "th", "bands")).alias("one")), "classes"
    )
    banded = classes.select("cls", F.explode("one.bands").alias("k"))
    shared = banded.groupBy("k").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("k", "k2")
    meetings = written(banded.join(shared, banded.k == shared.k2).select("k", "cls", "size"), "meetings")
    degrees = meetings.groupBy(F.col("cls").alias("cls2")).agg(F.sum("size").alias("degree"))
    buckets = written(meetings.join(degrees, F.col("cls") == F.col("cls2")).select("k", "cls", "degree"), "buckets")
    met = meetings.select("cls").distinct().join(classes, "cls").select("cls", "one.doc_id", "one.th")
    texts = written(beside(d, met, "inner").select("cls", "text"), "texts")
    compared = compare(stars(buckets), texts, size)
    near = F.col("common") * 100 >= F.col("total") * percent
    edges = compared.where(near).select("a", "b")
    labels = components(edges)
    placed = buckets.join(labels, F.col("cls") == F.col("node"), "left").select("k", "cls", F.coalesce("label", "cls").alias("label"))
    torn = placed.groupBy(F.col("k").alias("k2")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    leaves = written(placed.join(torn, placed.k == torn.k2).select("cls", "label").distinct(), "leaves")
    pairs = leaf_pairs(texts.join(leaves, "cls").select("cls", "label", "text"), size, percent)
    seen = compared.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    more = compare(pairs.join(seen, (pairs.a == seen.low) & (pairs.b == seen.high), "left_anti"), texts, size).where(near).select("a", "b")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    forget(meetings, buckets, texts, leaves, pairs)
    own = classes.join(labels, F.col("cls") == F.col("node"), "left").select(F.col("cls").alias("of"), F.coalesce("label", "cls").alias("component"), F.struct("one.no_id", "one.doc_id", "one.th").alias("one"))
    firsts = own.groupBy(F.col("component").alias("c2")).agg(F.min("one").alias("first"))
    placed = written(own.join(firsts, F.col("component") == F.col("c2")).select("of", F.col("first.doc_id").alias("first_doc"), F.col("first.th").alias("first_th")), "placed")
    return sketches.join(placed, F.col("cls") == F.col("of"), "left").select(
        "doc_id", "th", "n_shingles",
        F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("first_doc")).alias("component_id"),
        (F.col("of").isNull() | (F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("th") == F.col("first_th")))).alias("kept"),
    )

"""Where texts may repeat: grams at places chosen by content, counted over all documents.

A repeated window always holds a repeated gram at the same distance from its start (``kernels.anchors``), so only
about one place in ``(window - gram) / 2`` is shuffled and every repeated window is still met. Around each place
stands its reach, the symbols of all windows that hold it. A gram whose occurrences all have one reach is passed the
same way everywhere; one with several is a branching, and what surrounds it has to be looked at more closely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import kernels as K
from millrace.llm.stage import forget, written

ANCHOR = "doc_id long, th long, pos int, h long, c long"


def keyed(texts: DataFrame, *others: str) -> DataFrame:
    """Id, text and a hash of the text: rows that share an id but not the text stay apart."""
    return texts.select("doc_id", "text", *others, F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def symbols(texts: K.Texts, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and text offsets over the bytes or the words of some texts."""
    if unit == "bytes":
        return K.byte_prefix(texts), texts.offsets
    words = K.Words(texts)
    return K.prefix(words.hash), words.offsets


def reach(at: np.ndarray, offsets: np.ndarray, owner: np.ndarray, window: int, gram: int):
    """First and last symbol (exclusive) of all windows of a text that hold the gram at ``at``."""
    return np.maximum(offsets[owner], at - (window - gram)), np.minimum(offsets[owner + 1], at + window)


def anchor_rows(unit: str, window: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("doc_id"), batch.column("th").to_numpy(zero_copy_only=False)
            for texts in K.slices(batch.column("text")):
                sums, offsets = symbols(texts, unit)
                at, h = K.anchors(sums, offsets, window, gram)
                owner = np.searchsorted(offsets, at, "right") - 1
                lo, hi = reach(at, offsets, owner, window, gram)
                sides = ((at - lo) * (window + 1) + (hi - at)).astype(np.uint64)
                c = K.mix(K.span_hash(sums, lo, hi) ^ K.mix(sides))
                row = pa.array(owner + texts.first)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), pa.array(th[owner + texts.first]), pa.array((at - offsets[owner]).astype(np.int32)), K.signed(h), K.signed(c)],
                    ["doc_id", "th", "pos", "h", "c"],
                )

    return rows


def repeated_anchors(keyed_docs: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """Every chosen place whose gram occurs again, written: doc_id, th, pos, h, c, branching, the first occurrence
    (first_doc, first_th, first_pos) by document and place, and whether this one is ``later``."""
    table = written(keyed_docs.mapInArrow(anchor_rows(unit, window, gram), ANCHOR), "anchors")
    grams = written(  # written, so that a gram that many documents share is a skewed join, which Spark splits
        table.groupBy("h")
        .agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.struct("doc_id", "th", "pos")).alias("first"))
        .where("n > 1")
        .select(F.col("h").alias("gram"), (F.col("low") != F.col("high")).alias("branching"), "first"),
        "grams",
    )
    again = table.join(grams, table.h == grams.gram).select(
        "doc_id", "th", "pos", "h", "c", "branching",
        F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"),
        (~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first"))).alias("later"),
    )
    out = written(again, "repeated")
    forget(table, grams)
    return out


def per_document(places: DataFrame, *lists: str) -> DataFrame:
    """One row per document with the collected columns; nulls within them are left out."""
    return places.groupBy("doc_id", "th").agg(*[F.collect_list(c).alias(c) for c in lists])


def beside(keyed_docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Documents with the lists of ``per_document``; a null id meets a null id."""
    p = places.withColumnsRenamed({"doc_id": "place_doc", "th": "place_th"})
    return keyed_docs.join(p, keyed_docs.doc_id.eqNullSafe(p.place_doc) & (keyed_docs.th == p.place_th), how).drop("place_doc", "place_th")


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column; a null list is empty."""
    lengths = np.zeros(len(column), np.int64)
    if column.null_count < len(column):
        lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]

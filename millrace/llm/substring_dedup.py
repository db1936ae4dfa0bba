"""Removal of long word sequences that occur earlier, by compacting a De Bruijn graph of token k-mers.

Token k-mers are edges of the graph; those at content-chosen places carry it (``repeats``). A repeated k-mer that all
its occurrences pass within one and the same surrounding lies on a nonbranching path: neighbouring ones compact into
one span, and comparing source coordinates with the first occurrence settles all windows of the path at once. Only at
branchings are the windows themselves made into k-mers (two 64-bit hashes each), grouped, and compared with the
first occurrence of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import kernels as K
from millrace.llm.repeats import beside, keyed, lists_of, per_document, reach, repeated_anchors
from millrace.llm.stage import forget, texts_of, written

SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def window_rows(window: int, gram: int):
    """The windows that hold the places listed in ``pos``, each as a pair of hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("doc_id"), batch.column("th").to_numpy(zero_copy_only=False)
            pos, by_row = lists_of(batch.column("pos"))
            for texts in K.slices(batch.column("text")):
                words = K.Words(texts)
                sums, other = K.prefix(words.hash), K.prefix(K.mix(words.hash ^ SECOND))
                own = slice(by_row[texts.first], by_row[texts.first + texts.n])
                owner = np.repeat(np.arange(texts.n), np.diff(by_row[texts.first : texts.first + texts.n + 1]))
                at = words.offsets[owner] + pos[own]
                lo, hi = reach(at, words.offsets, owner, window, gram)
                held = np.zeros(len(words.start) + 2, np.int64)
                np.add.at(held, lo, 1)
                np.add.at(held, hi - window + 1, -1)
                start = np.flatnonzero(np.cumsum(held)[:-1] > 0)
                owner = words.owner[start]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(owner + texts.first)), pa.array(th[owner + texts.first]), pa.array((start - words.offsets[owner]).astype(np.int32)),
                        K.signed(K.span_hash(sums, start, start + window)), K.signed(K.span_hash(other, start, start + window)),
                    ],
                    ["doc_id", "th", "pos", "e1", "e2"],
                )

    return rows


def kept_rows(window: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, path_by = lists_of(batch.column("path_pos"))
            edge, edge_by = lists_of(batch.column("edge_pos"))
            for texts in K.slices(batch.column("text")):
                n_words, n_removed, kept, spans = [], [], [], []
                for i in range(texts.n):
                    row = texts.first + i
                    words = texts.raw(i).split()
                    n = len(words)
                    at, starts = path[path_by[row] : path_by[row + 1]].astype(np.int64), edge[edge_by[row] : edge_by[row + 1]].astype(np.int64)
                    n_words.append(n)
                    if not len(at) and not len(starts):
                        n_removed.append(0)
                        kept.append(b" ".join(words))
                        spans.append([])
                        continue
                    lo = np.r_[np.maximum(0, at - (window - gram)), starts]
                    hi = np.r_[np.minimum(n, at + window), starts + window]
                    lo, hi = K.runs(lo, hi)
                    change = np.zeros(n + 1, np.int64)
                    change[lo] += 1
                    change[hi] -= 1
                    kept.append(b" ".join(compress(words, np.cumsum(change)[:-1] == 0)))
                    n_removed.append(int((hi - lo).sum()))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(lo, hi)])
                own = batch.slice(texts.first, texts.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    ["doc_id", "text", "n_words", "n_removed", "spans"],
                )

    return rows


def remove_repeated_words(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """Documents without the words of every ``window`` of words that also starts earlier.

    Earlier is a smaller doc_id, or an earlier word of the same document. Words are runs of bytes other than space
    and 0x09-0x0D. Windows are judged on the input. Returns doc_id, text (kept words joined by one space), n_words,
    n_removed and the removed ``spans`` in words, one row per input row.

    A null text has no words. A text shorter than the window is kept. A null doc_id comes before all others. Rows
    that repeat both id and text are one document; rows of one id with other texts are ordered by a hash of the text.
    Other columns are ignored. No rows give no rows.
    """
    d = keyed(texts_of(docs))
    again = repeated_anchors(d, "words", window, gram)
    branching = per_document(again.where("branching").select("doc_id", "th", "pos"), "pos")
    edges = written(
        beside(d, branching, "inner").mapInArrow(window_rows(window, gram), "doc_id long, th long, pos int, e1 long, e2 long"), "edges"
    )
    first = (
        edges.groupBy("e1", "e2")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("first"))
        .where("n > 1")
        .withColumnsRenamed({"e1": "f1", "e2": "f2"})
    )
    later = edges.join(first, (edges.e1 == first.f1) & (edges.e2 == first.f2)).where(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    removed = written(
        per_document(
            again.where("later and not branching")
            .select("doc_id", "th", F.col("pos").alias("path_pos"), F.lit(None).cast("int").alias("edge_pos"))
            .unionByName(later.select("doc_id", "th", F.lit(None).cast("int").alias("path_pos"), F.col("pos").alias("edge_pos"))),
            "path_pos", "edge_pos",
        ),
        "removed",
    )
    forget(again, edges)
    return beside(d, removed, "left").mapInArrow(
        kept_rows(window, gram), "doc_id long, text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>"
    )

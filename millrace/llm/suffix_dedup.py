"""Removal of long strings that occur more than once, over a sparse suffix array.

Suffixes start at places chosen by content (``repeats``), so that a repeated string of ``window`` bytes is found from
the suffix inside it and what stands before that suffix. A suffix whose surrounding is the same at every occurrence is
settled by its counts. The others, one for each different surrounding, go to the suffix array: sampled splitters
range-partition them by their leading bytes, and each bucket is sorted locally, by multikey quicksort on 8-byte words,
once by what follows and once by what stands before, reversed. Common prefix lengths of neighbours in both orders then
tell for every string around a suffix whether it occurs again.

A gram with more different surroundings than ``block`` is cut into several blocks. Strings are compared across the
boundaries of its blocks by their hashes, pre-aggregated in each block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import kernels as K
from millrace.llm.repeats import beside, keyed, lists_of, per_document, repeated_anchors
from millrace.llm.stage import forget, texts_of, written

SUFFIX = "doc_id long, th long, pos int, single boolean, blocks int, block int, lead binary, before binary, after binary"
FOUND = "doc_id long, th long, lo int, hi int, e1 long, e2 long"


def suffix_rows(window: int, gram: int):
    """The suffixes listed in ``place``, with the bytes before (reversed) and after each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("doc_id"), batch.column("th").to_numpy(zero_copy_only=False)
            place = batch.column("place")
            flat, (_, by_row) = place.flatten(), lists_of(place)
            pos, blocks = flat.field("pos").to_numpy(zero_copy_only=False), flat.field("blocks").to_numpy(zero_copy_only=False)
            single = flat.field("single").to_numpy(zero_copy_only=False)
            for texts in K.slices(batch.column("text")):
                before, after, row = [], [], []
                a, b = by_row[texts.first], by_row[texts.first + texts.n]
                for i in range(texts.n):
                    text = texts.raw(i)
                    for p in pos[by_row[texts.first + i] : by_row[texts.first + i + 1]].tolist():
                        before.append(text[max(0, p - (window - gram)) : p][::-1])
                        after.append(text[p : p + window])
                        row.append(texts.first + i)
                n, keys = blocks[a:b].astype(np.int32), th[row].astype(np.int64) if row else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row, pa.int64())), pa.array(keys), pa.array(pos[a:b].astype(np.int32)), pa.array(single[a:b].astype(bool)),
                        pa.array(n), pa.array((keys % n).astype(np.int32)), pa.array([x[:gram] for x in after], pa.binary()),
                        pa.array(before, pa.binary()), pa.array(after, pa.binary()),
                    ],
                    ["doc_id", "th", "pos", "single", "blocks", "block", "lead", "before", "after"],
                )

    return rows


def padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of ``width`` bytes with zeros behind, and their lengths."""
    width = -(-width // 8) * 8
    texts = next(K.slices(column, 1 << 62))
    lengths = texts.lengths
    out = np.zeros((len(lengths), width), np.uint8)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(texts.data)) - np.repeat(texts.offsets[:-1], lengths)] = texts.data
    return out, lengths


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of byte rows: sort by one 8-byte word, then each run of equals by the next, until none are left."""
    words = rows.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.arange(len(order))
    group = np.r_[0, np.cumsum(words[order[1:], 0] != words[order[:-1], 0])] if len(order) else tied
    for depth in range(1, words.shape[1]):
        sizes = np.bincount(group) if len(group) else group
        more = sizes[group] > 1 if len(group) else np.zeros(0, bool)
        tied, group = tied[more], group[more]
        if not len(tied):
            break
        word = words[order[tied], depth]
        inner = np.lexsort((word, group))
        order[tied] = order[tied[inner]]
        word = word[inner]
        group = np.r_[0, np.cumsum((group[1:] != group[:-1]) | (word[1:] != word[:-1]))]
    return order


def neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and the common prefix length of each with the one before it."""
    order = multikey_order(rows)
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
    return order, np.r_[-1, common] if len(order) else common


def classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """A number for each row, the same for rows whose first ``length`` bytes are the same."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length)
    return out


def solve(block: pa.Table, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The span around each suffix that repeated strings cover; of cut grams also the strings, for other blocks."""
    after, n_after = padded(block.column("after").combine_chunks(), window)
    before, n_before = padded(block.column("before").combine_chunks(), window - gram)
    after_order, after_common = neighbours(after)
    before_order, before_common = neighbours(before)
    single = block.column("single").to_numpy(zero_copy_only=False)
    pos, cut = block.column("pos").to_numpy(), block.column("blocks").to_numpy() > 1
    n = len(pos)
    least, most = np.full(n, window), np.full(n, -1)
    if cut.any():
        lead = next(K.slices(block.column("lead"), 1 << 62))
        h = K.span_hash(K.byte_prefix(lead), lead.offsets[:-1], lead.offsets[1:])
        joined = np.hstack([before[:, : window - gram][:, ::-1], after[:, :window]])
        sums = np.stack([K.prefix(K._values[r]) for r in joined[cut]])
        other = np.stack([K.prefix(K.mix(K._values[r])) for r in joined[cut]])
        nth = np.cumsum(cut) - 1
    for d in range(window - gram + 1):
        whole = np.flatnonzero((n_before >= d) & (n_after >= window - d))
        if not len(whole):
            continue
        key = (classes(after_order, after_common, window - d) * (n + 1) + classes(before_order, before_common, d))[whole]
        _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        again = whole[count[inverse] > 1]
        least[again] = np.minimum(least[again], d)
        most[again] = d
        if cut.any():
            own = whole[first][cut[whole[first]]]
            alone = (count == 1)[cut[whole[first]]]
            start = window - gram - d
            down = K.powers(start + 1)[1][start]
            mark = K.mix(h[own] ^ np.uint64(d))
            e1 = K.mix((sums[nth[own], start + window] - sums[nth[own], start]) * down ^ mark)
            e2 = K.mix((other[nth[own], start + window] - other[nth[own], start]) * down ^ mark)
            lo = np.where(alone & single[own], pos[own] - d, -1).astype(np.int32)
            pick = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pick).combine_chunks(), block.column("th").take(pick).combine_chunks(), pa.array(lo), pa.array(lo + np.int32(window)), K.signed(e1), K.signed(e2)],
                ["doc_id", "th", "lo", "hi", "e1", "e2"],
            )
    found = np.flatnonzero((most >= 0) & single)
    pick, none = pa.array(found), pa.nulls(len(found), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [
            block.column("doc_id").take(pick).combine_chunks(), block.column("th").take(pick).combine_chunks(),
            pa.array((pos[found] - most[found]).astype(np.int32)), pa.array((pos[found] - least[found] + window).astype(np.int32)), none, none,
        ],
        ["doc_id", "th", "lo", "hi", "e1", "e2"],
    )


def bucket_rows(window: int, gram: int, block: int):
    """A range partition, sorted by lead: solved a block at a time, cut where the lead changes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < block:
                continue
            table = pa.Table.from_batches(held)
            lead, part = table.column("lead").combine_chunks(), table.column("block").to_numpy()
            changes = pa.compute.not_equal(lead[1:], lead[:-1]).to_numpy(zero_copy_only=False) | (part[1:] != part[:-1])
            last = np.flatnonzero(changes)
            if len(last):
                yield from solve(table.slice(0, last[-1] + 1).combine_chunks(), window, gram)
                table = table.slice(last[-1] + 1)
            held, size = table.to_batches(), table.num_rows
        if size:
            yield from solve(pa.Table.from_batches(held).combine_chunks(), window, gram)

    return rows


def kept_rows(window: int, gram: int, whole_characters: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, place_by = lists_of(batch.column("place"))
            span = batch.column("span")
            flat, (_, span_by) = span.flatten(), lists_of(span)
            lo_all, hi_all = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("lo", "hi"))
            for texts in K.slices(batch.column("text")):
                kept, removed, spans = [], [], []
                for i in range(texts.n):
                    row = texts.first + i
                    text = texts.raw(i)
                    at = place[place_by[row] : place_by[row + 1]].astype(np.int64)
                    own = slice(span_by[row], span_by[row + 1])
                    lo = np.r_[np.maximum(0, at - (window - gram)), lo_all[own]].astype(np.int64)
                    hi = np.r_[np.minimum(len(text), at + window), hi_all[own]].astype(np.int64)
                    cuts = list(zip(*(x.tolist() for x in K.runs(lo, hi)))) if len(lo) else []
                    if whole_characters:
                        cuts = [c for c in (inner(text, a, b) for a, b in cuts) if c[0] < c[1]]
                    edges = [0, *(x for c in cuts for x in c), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if cuts else text)
                    removed.append(sum(b - a for a, b in cuts))
                    spans.append([{"start": a, "end": b} for a, b in cuts])
                own = batch.slice(texts.first, texts.n)
                rest = [own.column("rest")] if "rest" in batch.schema.names else []
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id"), own.column("th"), pa.array(kept, pa.binary()), pa.array(texts.lengths.astype(np.int64)), pa.array(removed, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        *rest,
                    ],
                    ["doc_id", "th", "kept", "n_bytes", "n_removed", "spans", "rest"][: 6 + len(rest)],
                )

    return rows


def inner(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a span that starts and ends between characters."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def remove_repeated_bytes(docs: DataFrame, window: int = 200, gram: int = 64, block: int = 1 << 16, whole_characters: bool = False, rest: Sequence[str] = ()) -> DataFrame:
    """Documents without the bytes that any string of ``window`` bytes covers which also starts elsewhere.

    Elsewhere is any other document, or any other place of the same one; overlaps count, matches never cross
    documents, every occurrence goes, and strings are judged on the input. Returns doc_id, th (a hash of the text),
    ``kept`` (binary), n_bytes, n_removed and the removed runs as ``spans`` in bytes, one row per input row.
    ``whole_characters`` leaves bytes at the ends of a run that belong to a character outside it, so that ``kept``
    stays UTF-8. The columns named in ``rest`` come along as a struct of that name.

    A null text is empty. A text shorter than the window is kept. Repeated rows are separate documents, so each is a
    repetition of the other. A null doc_id is an id like others. Other columns are ignored. No rows give no rows.
    """
    d = keyed(texts_of(docs))
    again = repeated_anchors(d, "bytes", window, gram)
    around = written(
        again.where("branching").groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("one")), "surroundings"
    )
    crowded = around.groupBy("h").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1").withColumnRenamed("h", "crowd")
    suffixes = around.join(crowded, around.h == crowded.crowd, "left").select(
        "one.doc_id", "one.th", F.struct(F.col("one.pos").alias("pos"), (F.col("n") == 1).alias("single"), F.coalesce("blocks", F.lit(1)).alias("blocks")).alias("place")
    )
    buckets = beside(d, per_document(suffixes, "place"), "inner").mapInArrow(suffix_rows(window, gram), SUFFIX)
    partitions = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(
        buckets.repartitionByRange(partitions, "lead", "block").sortWithinPartitions("lead", "block").mapInArrow(bucket_rows(window, gram, block), FOUND), "found"
    )
    across = found.where("e1 IS NOT NULL").groupBy("e1", "e2").agg(F.count("*").alias("n")).where("n > 1").withColumnsRenamed({"e1": "f1", "e2": "f2"})
    elsewhere = found.where("e1 IS NOT NULL AND lo >= 0").join(across, (F.col("e1") == F.col("f1")) & (F.col("e2") == F.col("f2")), "left_semi")
    same = around.where("n > 1").select(F.col("h").alias("h2"), F.col("c").alias("c2"))
    settled = again.where("not branching").select("doc_id", "th", "pos").unionByName(
        again.where("branching").join(same, (again.h == same.h2) & (again.c == same.c2), "left_semi").select("doc_id", "th", "pos")
    )
    no_span, no_place = F.lit(None).cast("struct<lo:int,hi:int>"), F.lit(None).cast("int")
    spans = found.where("e1 IS NULL").select("doc_id", "th", "lo", "hi").unionByName(elsewhere.select("doc_id", "th", "lo", "hi"))
    removed = written(
        per_document(
            settled.select("doc_id", "th", F.col("pos").alias("place"), no_span.alias("span")).unionByName(
                spans.select("doc_id", "th", no_place.alias("place"), F.struct("lo", "hi").alias("span"))
            ),
            "place", "span",
        ),
        "removed",
    )
    forget(again, around, found)
    schema = "doc_id long, th long, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>"
    if rest:
        others = F.struct(*[F.col(f"`{c}`") for c in rest])
        d = keyed(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), others.alias("rest")), "rest")
        schema += f", rest {d.schema['rest'].dataType.simpleString()}"
    return beside(d, removed, "left").mapInArrow(kept_rows(window, gram, whole_characters), schema)

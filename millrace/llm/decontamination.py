"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; positions marked 0 are ignored, so a word put in for another there does
not hide the hit. The masks are chosen so that every placement of the words that may differ leaves a hit. Seeds of the
test items are broadcast in blocks of bounded size; each task joins them with the seeds of its documents, lays the item
over the document at every hit, and keeps overlaps that agree in enough words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from millrace.llm import kernels as K
from millrace.llm.stage import texts_of

# One of them hits in 13 to 25 words of which 80 % agree, wherever the others stand; longer runs hold such a run.
MASKS = ("11101011", "11000001111", "1111011", "1110001010001")
SHORTEST = 5  # words; shorter items match nothing
BITS = 22  # of a hash at most, by which words without a hit are told
HELD = 1 << 20  # hits, or words laid over each other, held at once


def masks_for(n: int, overlap: int, percent: int) -> tuple[str, ...]:
    """Masks of which one hits in every sufficient overlap with an item of ``n`` words; those of n places hold it whole."""
    if percent >= 80 and min(n, overlap) >= 13:
        return MASKS
    differ = n * (100 - percent) // 100
    if n <= overlap and differ <= 3:  # of differ + 2 groups of places, two are left alone
        group = np.arange(n) * (differ + 2) // n
        return tuple("".join("01"[g not in out] for g in group.tolist()) for out in combinations(range(differ + 2), differ))
    widths = []
    for run in range(min(n, overlap), min(n, 2 * overlap - 1) + 1):  # a longer run holds one of these
        differ = run * (100 - percent) // 100
        widths.append(-(-(run - differ) // (differ + 1)))
    return ("1" * max(1, min(widths)),)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 .. count - 1 for each count, one after the other: whose it is, and the number."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def chunks(counts: np.ndarray, size: int) -> Iterator[slice]:
    """Runs of counts whose sum is about ``size``."""
    total, start = np.cumsum(counts), 0
    while start < len(counts):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + size, "right")))
        yield slice(start, end)
        start = end


class Items:
    """Seeds of a bounded number of test items, ready to be probed."""

    def __init__(self, ids: list, texts: list, overlap: int, percent: int):
        words = K.Words(next(K.slices(pa.array([*texts, ""], pa.string()), 1 << 62)), lower=True)
        self.ids, self.overlap, self.percent = ids, overlap, percent
        self.words = [words.hash[a:b] for a, b in zip(words.offsets[:-2], words.offsets[1:])]
        self.flat, self.begin, self.lengths = words.hash, words.offsets[:-2], words.counts[:-1]
        seeded: dict[str, list[int]] = {}
        for i, n in enumerate(self.lengths.tolist()):
            for mask in masks_for(n, overlap, percent) if n >= SHORTEST else ():
                seeded.setdefault(mask, []).append(i)
        self.tables = []
        for mask, items in seeded.items():
            places, span = np.flatnonzero(np.array(list(mask)) == "1"), len(mask)
            h, item, at = [], [], []
            for i in items:
                if len(self.words[i]) >= span:
                    own = seeds(self.words[i], places, span)
                    h.append(own)
                    item.append(np.full(len(own), i))
                    at.append(np.arange(len(own)))
            h, item, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, item, at))
            order = np.argsort(h.astype(np.uint64), kind="stable")
            bits = min(BITS, len(h).bit_length() + 4)
            near = np.zeros(1 << bits, bool)
            near[(h.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables.append((places, span, h.astype(np.uint64)[order], item[order], at[order], near))

    def hits(self, words: K.Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Texts, items, and shifts of the item's start from the text's start; some come more than once."""
        for places, span, keys, item, at, near in self.tables:
            if not len(keys) or len(words.hash) < span:
                continue
            h = seeds(words.hash, places, span)
            start = np.flatnonzero(near[(h >> np.uint64(65 - len(near).bit_length())).astype(np.int64)])
            start = start[start + span <= words.offsets[words.owner[start] + 1]]
            low, high = np.searchsorted(keys, h[start]), np.searchsorted(keys, h[start], "right")
            start, low, n = start[high > low], low[high > low], (high - low)[high > low]
            for some in chunks(n, HELD):
                probe, k = spread(n[some])
                k += low[some][probe]
                text = words.owner[start[some]][probe]
                shift = start[some][probe] - words.offsets[text] - at[k]
                found = text, item[k], shift
                order = np.lexsort(found)
                fresh = np.ones(len(order), bool)
                fresh[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in found], axis=0)
                yield tuple(x[order[fresh]] for x in found)

    def overlaps(self, texts: K.Texts) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) with the words of the longest sufficient overlap and how many of them agree."""
        words = K.Words(texts, lower=True)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        seen = set()
        for text, item, shift in self.hits(words):
            first, last = np.maximum(0, -shift), np.minimum(self.lengths[item], words.counts[text] - shift)
            least = np.minimum(self.overlap, self.lengths[item])
            enough = last - first >= least
            text, item, shift, first, least, n = (x[enough] for x in (text, item, shift, first, least, last - first))
            own, test = words.offsets[text] + first + shift, self.begin[item] + first
            for some in chunks(n, HELD):
                pair, k = spread(n[some])
                same = words.hash[own[some][pair] + k] == self.flat[test[some][pair] + k]
                ends = np.cumsum(n[some])
                agree = np.bincount(pair, weights=same, minlength=len(ends))
                for i in np.flatnonzero(agree * 100 >= least[some] * self.percent).tolist():
                    at = some.start + i
                    key = int(text[at]), int(item[at])
                    if (*key, int(shift[at])) in seen:
                        continue
                    seen.add((*key, int(shift[at])))
                    found = longest_overlap(same[ends[i] - n[at] : ends[i]], int(least[at]), self.percent)
                    if found and found > out.get(key, (0, 0)):
                        out[key] = found
        return out


def seeds(words: np.ndarray, mask: np.ndarray, span: int) -> np.ndarray:
    n = len(words) - span + 1
    total = np.full(n, np.uint64(span))
    for k, offset in enumerate(mask.tolist()):
        total += words[offset : offset + n] * K.powers(k + 2)[0][k + 1]
    return K.mix(total)


def longest_overlap(same: np.ndarray, least: int, percent: int) -> tuple[int, int] | None:
    """Longest run of at least ``least`` places of which ``percent`` agree, and how many do."""
    if len(same) < least:
        return None
    gain = np.r_[0, np.cumsum(same * 100 - percent)]
    best = None
    for end in range(least, len(gain)):
        start = int(np.argmax(gain[: end - least + 1] <= gain[end]))
        if gain[start] <= gain[end] and (best is None or end - start > best[0]):
            best = end - start, int(same[start:end].sum())
    return best


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, overlap: int, percent: int, block_bytes: int) -> Iterator[Broadcast]:
    """The items in blocks of about ``block_bytes`` of text, which bounds each broadcast."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        yield items.sparkSession.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows], overlap, percent))


def match_rows(items: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                found = sorted(items.value.overlaps(texts).items())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([texts.first + t for (t, _), _ in found], pa.int64())),
                        pa.array([items.value.ids[i] for (_, i), _ in found], pa.int64()),
                        pa.array([n for _, (n, _) in found], pa.int32()), pa.array([m for _, (_, m) in found], pa.int32()),
                    ],
                    ["doc_id", "item_id", "overlap_words", "equal_words"],
                )

    return rows


def clean_rows(items: Broadcast, text_col: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for texts in K.slices(batch.column(text_col).cast(pa.string())):
                keep[[texts.first + t for t, _ in items.value.overlaps(texts)]] = False
            yield batch.filter(pa.array(keep))

    return rows


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, percent: int = 80, block_bytes: int = 16 << 20) -> DataFrame:
    """Documents that hold a passage of a test item: one row (doc_id, item_id, overlap_words, equal_words) for each.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A document leaks an item when the item,
    laid over it anywhere, agrees in at least ``percent`` of some ``overlap`` or more consecutive words (of all
    its words, if it has fewer). Items under five words match nothing. A null or empty text on either side matches
    nothing; null ids are returned as they are; repeated documents each give their rows, as do repeated items. Other
    columns are ignored. No rows on either side give no rows.
    """
    found = None
    for items in blocks_of(benchmark, "item_id", "text", overlap, percent, block_bytes):
        own = texts_of(docs).mapInArrow(match_rows(items), "doc_id long, item_id long, overlap_words int, equal_words int")
        found = own if found is None else found.unionByName(own)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, percent: int = 80, block_bytes: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``leaks`` would not report. No shuffle."""
    for items in blocks_of(benchmark, "item_id", "text", overlap, percent, block_bytes):
        docs = docs.mapInArrow(clean_rows(items, text_col), docs.schema)
    return docs

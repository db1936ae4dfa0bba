"""Array kernels shared by the operators: slicing Arrow batches, words, span hashes, content-chosen anchors.

A span hash is a polynomial over 64-bit symbol values modulo 2**64, so that the hash of any span follows from two
prefix sums; a final mixing step spreads it over all bits. Equal spans have equal hashes wherever they stand. Spans stay
under 512 symbols: from 1,024 on, two sequences of a certain pattern have one polynomial. Words have no greatest length
and are therefore hashed by ``run_hash``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
SLICE_BYTES = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_values = np.random.default_rng(20240607).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), SLICE_BYTES + 1)
        for name, factor in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any span."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def run_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte runs of any length: eight bytes a step, mixed each time, so no pattern of bytes cancels out.

    Runs over 64 bytes are hashed in pieces of 64, and then the hashes of their pieces.
    """
    n = end - start
    h = mix(n.astype(np.uint64) * BASE + np.uint64(1))
    far = np.flatnonzero(n > 64)
    if len(far):
        counts = -(-n[far] // 64)
        offsets = np.r_[0, np.cumsum(counts)]
        first = np.repeat(start[far], counts) + 64 * (np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts))
        pieces = run_hash(data, first, np.minimum(first + 64, np.repeat(end[far], counts)))
        h[far] = mix(h[far] ^ run_hash(pieces.view(np.uint8), 8 * offsets[:-1], 8 * offsets[1:]))
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at = np.flatnonzero((n > 0) & (n <= 64))
    for step in range(0, 64, 8):
        at = at[n[at] > step]
        if not len(at):
            break
        value = eights[start[at] + step]
        short = np.maximum(step + 8 - n[at], 0).astype(np.uint64) * np.uint64(8)
        h[at] = mix(h[at] ^ (value << short)) + BASE
    return h


class Texts:
    """Some texts as one byte array: ``data`` and the ``offsets`` of each text. A null text is empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task and would keep it from the next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """A text column in runs of about ``size`` bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        end = min(end, len(column))
        yield Texts(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], start)
        start = end
    give_back()


class Words:
    """The words of some texts: byte ``start`` and ``end``, the ``owner`` text of each, ``offsets`` by text, hashes."""

    def __init__(self, texts: Texts, lower: bool = False, white: np.ndarray = WHITE):
        data = LOWER[texts.data] if lower else texts.data
        edge = np.zeros(len(data) + 1, bool)
        edge[texts.offsets] = True
        dark = ~white[data]
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = dark[:-1]
        self.start = np.flatnonzero(dark & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = dark[1:]
        self.end = np.flatnonzero(dark & (~after | edge[1:])) + 1
        self.offsets = np.searchsorted(self.start, texts.offsets)
        self.owner = np.repeat(np.arange(texts.n), np.diff(self.offsets))
        self.counts = np.diff(self.offsets)
        self.data = data
        self.hash = run_hash(data, self.start, self.end)

    def stems(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of each word; a word no longer than that has 0."""
        long = self.end - self.start > size
        return np.where(long, run_hash(self.data, self.start, np.minimum(self.start + size, self.end)), np.uint64(0))


def byte_prefix(texts: Texts) -> np.ndarray:
    return prefix(_values[texts.data])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` consecutive ones."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


def anchors(sums: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions chosen by content, and the hash of the gram that starts there.

    Each ``window`` of consecutive symbols inside a text holds the start of at least one chosen gram, the least by
    hash and then the leftmost, so equal windows choose the same place wherever they stand.
    """
    n = len(sums) - 1
    lengths = np.diff(offsets)
    if n < window or not (lengths >= window).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    ends = np.repeat(offsets[1:], lengths)
    whole = (at + gram <= ends) & np.repeat(lengths >= window, lengths)
    hashes = np.full(n, TOP, np.uint64)
    inside = at[whole]
    hashes[inside] = span_hash(sums, inside, inside + gram)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    least = sliding_min((hashes & ~low) | at.astype(np.uint64), window - gram + 1) & low
    chosen = least[np.r_[True, least[1:] != least[:-1]]].astype(np.int64)
    chosen = np.unique(chosen[whole[chosen]])
    return chosen, hashes[chosen]


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[new[1:], True]]


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))

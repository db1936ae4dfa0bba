"""Token ids by word: a worker encodes each distinct word once and puts texts together from those."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from millrace.llm import kernels as K

MOST_BYTES = 64 << 20


class Lexicon:
    """Ids of words known by their hashes, in arrays of at most about ``most_bytes``.

    ``encode`` turns a list of words (bytes) into a list of id lists. Once the arrays are full, the words that were
    met less often than the others are forgotten; they are encoded again if they come back.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], most_bytes: int = MOST_BYTES):
        self.encode, self.most_bytes = encode, most_bytes
        self.keys = np.zeros(0, np.uint64)  # sorted hashes
        self.starts, self.lengths, self.uses = (np.zeros(0, np.int32) for _ in range(3))  # in the order of the keys
        self.flat, self.size = np.zeros(1 << 16, np.int32), 0

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes stand or belong, and whether they are known."""
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(at), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        return at, known

    def add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Encode words whose hashes, sorted, are not known yet."""
        ids = self.encode(words)
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(lengths.sum())
        if 20 * (len(self.keys) + len(words)) + 4 * (self.size + total) > self.most_bytes:
            self.forget()
        if self.size + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.size], np.zeros(total + self.size // 2, np.int32)])
        self.flat[self.size : self.size + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        at = np.searchsorted(self.keys, hashes)
        starts = self.size + np.cumsum(lengths, dtype=np.int32) - lengths
        self.size += total
        self.keys, self.starts, self.lengths, self.uses = (
            np.insert(old, at, new) for old, new in ((self.keys, hashes), (self.starts, starts), (self.lengths, lengths), (self.uses, np.zeros(len(at), np.int32)))
        )

    def forget(self) -> None:
        """Keep the half of the words that is met more often."""
        if not len(self.keys):
            return
        half = len(self.keys) // 2
        kept = np.sort(np.argpartition(self.uses, half)[half:])
        flat = gathered(self.flat, self.starts[kept], self.lengths[kept])
        self.keys, self.lengths, self.uses = self.keys[kept], self.lengths[kept], self.uses[kept] // 2
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        self.flat, self.size = flat, len(flat)

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[start:end]`` in a row, and the offsets of texts whose words begin at ``offsets``."""
        distinct, first, inverse = np.unique(K.run_hash(data, start, end), return_index=True, return_inverse=True)
        _, known = self.find(distinct)
        new = first[~known]
        if len(new):
            self.add(distinct[~known], [data[s:e].tobytes() for s, e in zip(start[new].tolist(), end[new].tolist())])
        at, known = self.find(distinct)
        if not known.all():  # what ``forget`` dropped to make room
            again = first[~known]
            self.add(distinct[~known], [data[s:e].tobytes() for s, e in zip(start[again].tolist(), end[again].tolist())])
            at, known = self.find(distinct)
            if not known.all():
                return self.apart(data, start, end, offsets)
        self.uses[at] = np.minimum(self.uses[at] + np.bincount(inverse, minlength=len(at)), 1 << 30)
        at = at[inverse]
        return gathered(self.flat, self.starts[at], self.lengths[at]), np.r_[0, np.cumsum(self.lengths[at], dtype=np.int64)][offsets]

    def apart(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where the distinct words of one slice don't fit: they are encoded without being kept."""
        ids = self.encode([data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist())])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum())), np.r_[0, np.cumsum(lengths)][offsets]


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    lengths = lengths.astype(np.int64)
    before = np.cumsum(lengths) - lengths
    return values[np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)]

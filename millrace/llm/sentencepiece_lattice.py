"""SentencePiece encoding and decoding with a batched lattice in numpy.

Words of equal length advance together, one column of characters at a time. The hashes of all substrings that begin at
the column probe the sorted hashes of the pieces; a vectorised maximum keeps the best candidate of each end as its
backpointer. For a unigram model a candidate scores its log probability plus the best score where it
begins. A BPE model's scores are ranks of merges, and the path of the greatest sum is not what its merges give. There,
a candidate counts only if the merges would leave it and the piece before it apart, which exactly one candidate does
in every column that merges can end in; the path is then that of the merges, id by id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import kernels as K
from millrace.llm.lexicon import Lexicon, gathered
from millrace.llm.stage import texts_of

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
UNKNOWN, NONE = -2, -1
SLOTS = 1 << 22  # 9 bytes each
PRESENT_SHIFT = np.uint64(44)
_code = np.random.default_rng(99).integers(1, 2**63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_models: dict = {}


def code_values(codes: np.ndarray) -> np.ndarray:
    return K.mix(_code[codes & 4095] + codes.astype(np.uint64))


class Model:
    """Pieces of a model file, by the hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = {}
        pieces = {}
        surface = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                surface.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                surface.append(b"")
            else:
                surface.append(piece.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    pieces[piece] = i
        self.unknown = sp.unk_id()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_lengths = np.array([len(s) for s in surface], np.int64)
        self.surface_starts = np.cumsum(self.surface_lengths) - self.surface_lengths
        self.pieces, self.texts = pieces, {i: p for p, i in pieces.items()}
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        self.merges = bool(len(self.texts)) and all(float(s).is_integer() for s in self.scores[list(self.texts)])  # ranks
        self.longest = max(map(len, pieces))
        hashes, ids = [], []
        for length in range(1, self.longest + 1):
            own = [p for p in pieces if len(p) == length]
            if own:
                hashes.append(self.substrings(codes_of(own, length))[:, 0, -1])
                ids += [pieces[p] for p in own]
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(ids, np.int64)[order]
        self.present = np.zeros(1 << 20, bool)  # leading bits of the keys: tells most other substrings before a search
        self.present[self.keys >> PRESENT_SHIFT] = True
        self.ranks, self.histories = self.scores.tolist(), {}
        self.slot_keys, self.slot_apart = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)  # the pairs met last, by hash

    @staticmethod
    def substrings(codes: np.ndarray) -> np.ndarray:
        """Prefix sums of each row, as a row vector for ``pieces_from``; of whole rows when asked with full length."""
        up, _ = K.powers(codes.shape[1] + 1)
        sums = np.zeros((len(codes), 1, codes.shape[1] + 1), np.uint64)
        np.cumsum(code_values(codes) * up[: codes.shape[1]], axis=1, out=sums[:, 0, 1:])
        whole = K.mix(sums[:, :, -1:])
        return np.concatenate([sums, whole], axis=2)

    def pieces_from(self, sums: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces that begin at ``start`` in rows of prefix sums: row, end, piece. A character without one is UNKNOWN."""
        _, down = K.powers(start + 1)
        h = K.mix((sums[:, start + 1 : start + 1 + self.longest] - sums[:, start : start + 1]) * down[start])
        maybe = self.present[h >> PRESENT_SHIFT]
        maybe[:, 0] = True
        rows, ahead = np.nonzero(maybe)
        h = h[rows, ahead]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        own = np.where(self.keys[at] == h, self.key_ids[at], NONE)
        own[(own == NONE) & (ahead == 0)] = UNKNOWN
        kept = np.flatnonzero(own != NONE)
        return rows[kept], start + 1 + ahead[kept], own[kept]

    def history(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """How the merges make a piece of its characters: the best adjacent pair first, the leftmost of equals.

        The score of each merge (then -inf), and the first and the last part before it. None if they make it not whole.
        """
        if piece not in self.histories:
            parts = list(self.texts[piece])
            scores, first, last = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, where = -np.inf, -1
                for i in range(len(parts) - 1):
                    joined = self.pieces.get(parts[i] + parts[i + 1])
                    if joined is not None and self.ranks[joined] > best:
                        best, where = self.ranks[joined], i
                if where < 0:
                    break
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
                scores.append(best)
                first.append(parts[0])
                last.append(parts[-1])
            self.histories[piece] = ([*scores, -np.inf], first, last) if len(parts) == 1 else None
        return self.histories[piece]

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges leave two pieces apart; NONE or UNKNOWN on the left stands for a boundary."""
        key = (left + 2) * (len(self.scores) + 2) + right
        slot = (K.mix(key.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        known = self.slot_keys[slot] == key
        out = self.slot_apart[slot]
        new = np.flatnonzero(~known)
        if len(new):
            distinct, first, inverse = np.unique(key[new], return_index=True, return_inverse=True)
            first = new[first]
            found = np.array([self.never_joined(a, b) for a, b in zip(left[first].tolist(), right[first].tolist())])
            out[new] = found[inverse]
            self.slot_keys[slot[first]], self.slot_apart[slot[first]] = distinct, found
        return out

    def never_joined(self, left: int, right: int) -> bool:
        """Follow the merges on both sides of the border, best first, until one across it would be due."""
        theirs = self.history(right)
        if left < 0 or theirs is None:
            return theirs is not None
        own = self.history(left)
        if own is None:
            return False
        i = j = 0
        while True:
            joined = self.pieces.get(own[2][i] + theirs[1][j])
            if joined is not None and self.ranks[joined] > own[0][i] and self.ranks[joined] >= theirs[0][j]:
                return False
            if own[0][i] == theirs[0][j] == -np.inf:
                return True
            if own[0][i] >= theirs[0][j]:
                i += 1
            else:
                j += 1

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of units: runs of spaces (as U+2581) and the characters up to the next."""
        by_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_length.setdefault(len(u), []).append(i)
        out: list[list[int]] = [[] for _ in units]
        for length, rows in by_length.items():
            step = max(1, (1 << 18) // max(length, 1))
            for a in range(0, len(rows), step):
                own = rows[a : a + step]
                for i, ids in zip(own, self.paths([units[i] for i in own], length)):
                    out[i] = ids
        return out

    def paths(self, units: list[str], length: int) -> Iterator[list[int]]:
        n = len(units)
        sums = self.substrings(codes_of(units, length))[:, 0, : length + 1]
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        piece = np.full((n, length + 1), NONE, np.int64)
        back = np.zeros((n, length + 1), np.int32)
        for start in range(length):
            here = np.flatnonzero(best[:, start] > -np.inf)
            if not len(here):
                continue
            rows, end, own = self.pieces_from(sums[here], start)
            rows = here[rows]
            real = own >= 0
            if self.merges:
                ok = ~real
                ok[real] = self.stay_apart(piece[rows[real], start], own[real])
                rows, end, own = rows[ok], end[ok], own[ok]
                score = best[rows, start] + 1
            else:
                score = best[rows, start] + np.where(real, self.scores[own], self.scores.min() - 10)
            better = score > best[rows, end]
            rows, end, own = rows[better], end[better], own[better]
            best[rows, end], piece[rows, end], back[rows, end] = score[better], own, start
        return self.traced(units, piece, back)

    def traced(self, units: list[str], piece: np.ndarray, back: np.ndarray) -> Iterator[list[int]]:
        """The ids of all paths, followed from their ends one piece at a time."""
        n, end = len(units), np.full(len(units), piece.shape[1] - 1)
        rows, steps = np.arange(n), []
        count, odd = np.zeros(n, np.int64), np.zeros(n, bool)
        while len(rows):
            own = piece[rows, end[rows]]
            step = np.full(n, NONE, np.int64)
            step[rows] = own
            steps.append(step)
            odd[rows[own < 0]] = True
            count[rows] += 1
            end[rows] = back[rows, end[rows]]
            rows = rows[end[rows] > 0]
        paths = np.stack(steps[::-1], axis=1).tolist() if steps else [[]] * n
        for r, (path, size, unknown) in enumerate(zip(paths, count.tolist(), odd.tolist())):
            yield self.with_bytes(units[r], piece[r], back[r]) if unknown else path[len(path) - size :]

    def with_bytes(self, unit: str, piece: np.ndarray, back: np.ndarray) -> list[int]:
        """The ids of one path, characters without a piece as their bytes."""
        ids: list[int] = []
        end = len(unit)
        while end:
            start, p = int(back[end]), int(piece[end])
            if p >= 0:
                ids.append(p)
            else:
                raw = unit[start:end].encode("utf-8", "replace")
                ids += [self.bytes.get(b, self.unknown) for b in reversed(raw)] if self.bytes else [self.unknown]
            end = start
        return ids[::-1]


def codes_of(units: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), length)


def units_of(text: str) -> list[str]:
    """The parts no piece crosses: a run of spaces and what follows up to the next. A space goes before the text."""
    if not text:
        return []
    text = text.replace(" ", SPACE)
    return UNIT.findall(SPACE + text)


def unit_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, a space before each, where their units start and end, and where each text's units begin."""
    data = np.frombuffer(b"".join(b" " + t for t in texts if t), np.uint8)
    first = np.r_[0, np.cumsum([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)]
    edge = np.zeros(len(data) + 1, bool)
    edge[first] = True
    space = data == 32
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = space[:-1]
    start = np.flatnonzero(space & (~before | edge[:-1]))
    return data, start, np.r_[start[1:], len(data)][: len(start)], np.searchsorted(start, first)


def model_of(path: str) -> tuple[Model, Lexicon]:
    if path not in _models:
        own = Model(path)
        _models[path] = own, Lexicon(lambda units: own.encode([u.decode("utf-8", "replace").replace(" ", SPACE) for u in units]))
    return _models[path]


def decode(own: Model, flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The texts of id runs, without the space that encoding put before each."""
    lengths = own.surface_lengths[flat]
    data = gathered(own.surface, own.surface_starts[flat], lengths).tobytes()
    ends = np.r_[0, np.cumsum(lengths)][offsets].tolist()
    return [data[a:b][1:] if data[a : a + 1] == b" " else data[a:b] for a, b in zip(ends, ends[1:])]


def id_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = model_of(path)
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                want = [texts.raw(i).replace(SPACE.encode(), b" ") for i in range(texts.n)]
                flat, offsets = words.ids(*unit_spans(want))
                back = decode(own, flat, offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(texts.first, texts.n), lists, pa.array(np.diff(offsets)), pa.array([a == b for a, b in zip(back, want)])],
                    ["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return rows


def text_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = model_of(path)
        for batch in batches:
            ids = batch.column("ids")
            lengths = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decode(own, flat, np.r_[0, np.cumsum(lengths)].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts])], ["doc_id", "text"])

    return rows


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """The ids of every whole text: doc_id, ids, n_tokens, and whether they decode to the text again (``round_trip``).

    For models whose normaliser is the identity and that put a space before a text. U+2581 in a text counts as a
    space. A null or empty text has no ids. Repeated rows and null ids stay as they are; other columns are ignored.
    """
    return texts_of(docs).mapInArrow(id_rows(model), "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(tokens: DataFrame, model: str) -> DataFrame:
    """The texts of ``ids`` by doc_id; null or no ids give an empty text."""
    return tokens.select("doc_id", "ids").mapInArrow(text_rows(model), "doc_id long, text string")

"""A hidden Markov language model over word classes.

P(text) = sum over state paths of transitions and class emissions, times the probability of each word in its class.
Word counts cover all training documents; classes are shapes of words, so the emission table has a fixed size. Baum-Welch
runs to its end on a sample first; from there each step sums expected counts over all training documents, partition by
partition, until a step gains less than the tolerance on all of them. A text is scored by the
scaled forward recursion over the whole of it, all texts of a task one token further at a time.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm import kernels as K
from millrace.llm.stage import forget, text_bytes, texts_of, written

END_CLASS = 72
CLASSES = END_CLASS + 1
END_WORD = np.uint64(0x5851F42D4C957F2D)
SEGMENT = 2048  # words between restarts while training; scores never restart
BLOCK = 1_000_000  # tokens held at once while training
HELD = 1_000_000  # distinct words held at once while counting
SAMPLE = 250_000  # tokens, about, that the first model is fitted on
SAMPLE_STEPS, SAMPLE_TOLERANCE = 100, 1e-6

log = logging.getLogger(__name__)


def word_classes(texts: K.Texts, words: K.Words) -> np.ndarray:
    """Shape of each word: its length in eight steps, the kind of its first byte, the kind of its last."""
    if not len(words.start):
        return np.zeros(0, np.uint8)
    kind = np.full(256, 2, np.uint8)
    kind[[*range(97, 123), *range(65, 91)]] = 0
    kind[128:] = 1
    first, last = kind[texts.data[words.start]], kind[texts.data[words.end - 1]]
    return (np.minimum((words.end - words.start) // 2, 7).astype(np.uint8) * 9 + first * 3 + last).astype(np.uint8)


def counted(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, cls, n = (np.concatenate(x) for x in zip(*parts))
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return keys, cls[first], np.bincount(inverse, weights=n, minlength=len(keys)).astype(np.int64)


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, summed over the task as far as they fit."""

    def out(kept):
        return pa.RecordBatch.from_arrays([K.signed(kept[0]), pa.array(kept[1].astype(np.int32)), pa.array(kept[2])], ["h", "cls", "c"])

    parts, size = [], 0
    for batch in batches:
        for texts in K.slices(batch.column("text")):
            words = K.Words(texts, lower=True)
            h = np.r_[words.hash, END_WORD]
            cls = np.r_[word_classes(texts, words), np.uint8(END_CLASS)]
            parts.append(counted([(h, cls, np.r_[np.ones(len(words.hash)), texts.n])]))
            size += len(parts[-1][0])
            if size > HELD:
                parts = [counted(parts)]
                size = len(parts[0][0])
                if size > HELD // 2:
                    yield out(parts[0])
                    parts, size = [], 0
    if parts:
        yield out(counted(parts))


def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class sequence of each text, its end included, in segments."""
    for batch in batches:
        for texts in K.slices(batch.column("text")):
            words = K.Words(texts, lower=True)
            cls = word_classes(texts, words)
            out = []
            for a, b in zip(words.offsets.tolist(), words.offsets[1:].tolist()):
                own = cls[a:b].tobytes() + bytes([END_CLASS])
                out += [own[i : i + SEGMENT] for i in range(0, len(own), SEGMENT)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["seq"])


class Layout:
    """Sequences side by side: step t of all that reach it is one slice."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        self.order, self.lengths = order, lengths[order]
        longest = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(longest), "left")
        self.first = np.r_[0, np.cumsum(self.active)]
        self.symbols = np.empty(len(flat), np.uint8)
        for t, n in enumerate(self.active.tolist()):
            self.symbols[self.first[t] : self.first[t] + n] = flat[starts[:n] + t]

    def steps_and_ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Step and place among the sequences, longest first, of each symbol."""
        step = np.repeat(np.arange(len(self.active)), self.active)
        return step, np.arange(len(step)) - self.first[step]


def forward(seqs: Layout, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled state probabilities and scales, step by step."""
    seen = emit.T[seqs.symbols]
    alpha, scale = np.empty_like(seen), np.empty(len(seen))
    before = None
    for t, n in enumerate(seqs.active.tolist()):
        own = slice(seqs.first[t], seqs.first[t] + n)
        now = seen[own] * (start if before is None else before[:n] @ move)
        total = now.sum(axis=1)
        before = now / total[:, None]
        alpha[own], scale[own] = before, total
    return alpha, scale


def log_likelihoods(seqs: Layout, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 of the probability of each sequence, in the order they were given; only the last step is held."""
    by_symbol, total, before = emit.T, np.zeros(len(seqs.lengths)), None
    for t, n in enumerate(seqs.active.tolist()):
        now = by_symbol[seqs.symbols[seqs.first[t] : seqs.first[t] + n]] * (start if before is None else before[:n] @ move)
        scale = now.sum(axis=1)
        before = now / scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty_like(total)
    out[seqs.order] = total
    return out


def expected(seqs: Layout, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Expected counts of starts, moves and emissions."""
    return expected_and_log(seqs, start, move, emit)[:3]


def expected_and_log(seqs: Layout, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Expected counts, then log10 of the probability of all sequences and their symbols."""
    alpha, scale = forward(seqs, start, move, emit)
    weighted = emit.T[seqs.symbols] / scale[:, None]
    beta = np.ones_like(alpha)
    steps = seqs.active.tolist()
    for t in range(len(steps) - 2, -1, -1):
        n, a, b = steps[t + 1], seqs.first[t], seqs.first[t + 1]
        beta[a : a + n] = (weighted[b : b + n] * beta[b : b + n]) @ move.T
    gamma = alpha * beta
    step, rank = seqs.steps_and_ranks()
    later = np.flatnonzero(step > 0)
    before = seqs.first[step[later] - 1] + rank[later]
    moves = move * (alpha[before].T @ (weighted[later] * beta[later]))
    emits = np.stack([np.bincount(seqs.symbols, weights=gamma[:, k], minlength=CLASSES) for k in range(len(start))])
    return gamma[: steps[0]].sum(axis=0), moves, emits, np.array([np.log10(scale).sum(), len(scale)])


def layout_of(held: list[bytes]) -> Layout:
    return Layout(np.frombuffer(b"".join(held), np.uint8), np.array([len(s) for s in held]))


def expectation_rows(start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """One row of expected counts for each block of sequences."""

    def out(held):
        return np.concatenate([p.ravel() for p in expected_and_log(layout_of(held), start, move, emit)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0
        for batch in batches:
            for seq in batch.column("seq").to_pylist():
                held.append(seq)
                size += len(seq)
                if size > BLOCK:
                    total = total + out(held)
                    held, size = [], 0
        if held:
            total = total + out(held)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    return rows


def reestimated(values: np.ndarray, states: int):
    """The next start, moves and emissions, and log10 per token under those that gave the counts."""
    a, b, c, (total, tokens) = np.split(values, np.cumsum([states, states * states, states * CLASSES]))
    move = b.reshape(states, states) + 1e-3
    emit = c.reshape(states, CLASSES) + 1e-2
    return ((a + 1e-3) / (a + 1e-3).sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True)), total / tokens


def trained(seqs: DataFrame, class_counts: np.ndarray, states: int, steps: int, tolerance: float):
    """Baum-Welch from a fixed start near the class frequencies, on a sample and then on all sequences."""
    rng = np.random.default_rng(11)
    emit = (class_counts + 1) * rng.uniform(0.5, 1.5, (states, CLASSES))
    emit /= emit.sum(axis=1, keepdims=True)
    model = np.full(states, 1 / states), np.full((states, states), 0.3 / states) + 0.7 * np.eye(states), emit
    some = [r.seq for r in seqs.sample(min(1.0, SAMPLE / max(class_counts.sum(), 1)), 11).collect()]  # about SAMPLE bytes
    layout, before = layout_of(some) if some else None, -np.inf
    for _ in range(SAMPLE_STEPS if some else 0):
        model, now = reestimated(np.concatenate([p.ravel() for p in expected_and_log(layout, *model)]), states)
        if now - before < SAMPLE_TOLERANCE:
            break
        before = now
    before = -np.inf
    for step in range(1, steps + 1):
        sums = seqs.mapInArrow(expectation_rows(*model), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()  # a row for each parameter
        if not sums:
            break
        values = np.zeros(states + states * states + states * CLASSES + 2)
        for r in sums:
            values[r.place] = r.value
        model, now = reestimated(values, states)
        log.info("step %d over all sequences: %.6f log10 per token before it", step, now)
        if now - before < tolerance:
            break
        before = now
    else:
        log.warning("%d steps did not bring the gain below %g log10 per token", steps, tolerance)
    return model


def wanted_rows(chunk: pa.Table) -> pa.Table:
    """The distinct words of a chunk of documents."""
    kept = np.zeros(0, np.uint64)
    for texts in K.slices(chunk.column("text"), 1 << 22):
        kept = np.union1d(kept, K.Words(texts, lower=True).hash)
    number = chunk.column("chunk")[0].as_py()
    return pa.table({"chunk": pa.array(np.full(len(kept), number, np.int32)), "h": K.signed(kept)})


def score_rows(start, move, emit, sizes, end_count, words_total, words_distinct):
    """Scores of a chunk of documents beside the counts of their words."""
    per_class = np.log10(sizes[:, 0] + 0.1 * (sizes[:, 1] + 1))
    whole = np.log10(words_total + 0.1 * (words_distinct + 1))

    def rows(docs: pa.Table, counts: pa.Table) -> pa.Table:
        h = counts.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, c = h[order], counts.column("c").to_numpy()[order]
        classes, lengths, logs, known, in_class = [], [], [], [], []
        for texts in K.slices(docs.column("text")):
            words = K.Words(texts, lower=True)
            if len(h):
                at = np.minimum(np.searchsorted(h, words.hash), len(h) - 1)
                n = np.where(h[at] == words.hash, c[at], 0)
            else:
                n = np.zeros(len(words.hash), np.int64)
            cls = word_classes(texts, words)
            logs.append(np.bincount(words.owner, weights=np.log10(n + 0.1), minlength=texts.n) + np.log10(end_count + 0.1))
            known.append(np.bincount(words.owner, weights=n > 0, minlength=texts.n).astype(np.int64) + int(end_count > 0))
            in_class.append(np.bincount(words.owner, weights=per_class[cls], minlength=texts.n) + per_class[END_CLASS])
            lengths.append(words.counts + 1)
            classes.append(np.insert(cls, words.offsets[1:], END_CLASS))
        lengths, logs, known, in_class = (np.concatenate(x) for x in (lengths, logs, known, in_class))
        path = log_likelihoods(Layout(np.concatenate(classes), lengths), start, move, emit)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": lengths, "n_known": known,
                "train_tokens": np.full(len(lengths), words_total, np.int64), "base_score": logs - lengths * whole, "score": path + logs - in_class,
            }
        )

    return rows


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def language_scores(docs: DataFrame, states: int = 4, steps: int = 10, folds: int = 10, chunk_bytes: int = 16 << 20, tolerance: float = 1e-4) -> DataFrame:
    """The log10 probability of every whole text under a hidden Markov model and under smoothed word counts.

    Documents whose crc32(doc_id as text) is divisible by ``folds`` are held out, the others train. Tokens are words
    (runs of bytes other than space and 0x09-0x0D, A-Z lower-cased) and one end. base_score sums
    log10((c + 0.1) / (N + 0.1 (V + 1))); n_known counts tokens with c > 0; ``score`` is the model's, whose words are
    smoothed the same way within their class, so that unseen words share 0.1 of a count. Training ends when a step over
    all training documents gains less than ``tolerance`` in log10 per token; it warns if ``steps`` do not get there.

    A null or empty text has its end alone. A null doc_id counts as the empty text in crc32 and is held out. Repeated
    rows each count. Without training rows all counts are 0. Other columns are ignored. No rows give no rows.
    """
    d = texts_of(docs)
    chunks = max(1, -(-text_bytes(d) // chunk_bytes))
    d = d.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0)
    train = d.where("NOT held_out").select("text")
    counts = written(train.mapInArrow(count_rows, "h long, cls int, c long").groupBy("h").agg(F.sum("c").alias("c"), F.max("cls").alias("cls")), "counts")
    seqs = written(train.mapInArrow(class_rows, "seq binary"), "classes")
    sizes = np.zeros((CLASSES, 2))
    for r in counts.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # a row for each class
        sizes[r.cls] = r.c, r.v
    start, move, emit = trained(seqs, sizes[:, 0], states, steps, tolerance)
    forget(seqs)
    chunked = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(chunks)).cast("int"))
    wanted = chunked.select("chunk", "text").groupBy("chunk").applyInArrow(wanted_rows, "chunk int, h long")
    known = wanted.join(counts.select(F.col("h").alias("h2"), "c"), F.col("h") == F.col("h2")).select("chunk", "h", "c")
    score = score_rows(start, move, emit, sizes, sizes[END_CLASS, 0], int(sizes[:, 0].sum()), sizes[:, 1].sum())
    return chunked.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, RESULT)

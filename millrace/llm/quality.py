"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of consecutive words. Each passage is encoded by what its bytes and words look like.
A gated attention network weighs the passages, the weighted mean represents the document, and a linear layer scores
it. All weights, those of the attention included, are learned from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import kernels as K
from millrace.llm.labelled import remainder, sampled, sigmoid
from millrace.llm.stage import texts_of

PASSAGE = 64  # words
MARKS = b"#*$%&!|.,?;:\"'()<>/\\=_-@{}[]"
KINDS = 10 + len(MARKS)


def kinds() -> np.ndarray:
    """Kind of each byte: the marks one by one, else a range."""
    out = np.zeros(256, np.int64)
    for kind, own in enumerate((range(97, 123), range(65, 91), range(48, 58), [32], [10], [9, 11, 12, 13], range(128, 192), range(192, 256)), 1):
        out[[*own]] = kind
    for i, mark in enumerate(MARKS):
        out[mark] = 10 + i
    return out


KIND = kinds()
WIDTH = KINDS + 6


def encode(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the offsets of passages by text; a text without words has one empty passage."""
    words = K.Words(texts)
    n = np.maximum(1, -(-words.counts // PASSAGE))
    offsets = np.r_[0, np.cumsum(n)]
    total = int(offsets[-1])
    at = np.arange(len(words.start)) - words.offsets[words.owner]
    passage = offsets[words.owner] + at // PASSAGE
    begins = np.zeros(len(texts.data) + 1, np.int64)
    begins[words.start[at % PASSAGE == 0]] = 1
    of_text = np.repeat(np.arange(texts.n), texts.lengths)
    inside = np.cumsum(begins)[:-1]
    before = np.r_[0, np.cumsum(begins)][texts.offsets[:-1]]
    own = offsets[of_text] + np.maximum(0, inside - before[of_text] - 1) if len(of_text) else of_text
    shape = np.bincount(own * KINDS + KIND[texts.data], minlength=total * KINDS).reshape(total, KINDS).astype(float)
    size = np.maximum(1, shape.sum(axis=1))
    in_passage = np.maximum(1, np.bincount(passage, minlength=total))
    distinct = np.unique(np.rec.fromarrays([passage.astype(np.int64), words.hash]))["f0"]
    twice = np.r_[False, (words.hash[1:] == words.hash[:-1]) & (passage[1:] == passage[:-1])] if len(passage) else np.zeros(0, bool)
    long = np.bincount(passage, weights=words.end - words.start, minlength=total) / in_passage
    first, last = (texts.data[words.start], texts.data[words.end - 1]) if len(passage) else (np.zeros(0, np.uint8),) * 2
    upper = np.bincount(passage, weights=(KIND[first] == 2) & (KIND[last] != 1), minlength=total) / in_passage
    extra = [
        np.bincount(distinct, minlength=total) / in_passage, np.bincount(passage, weights=twice, minlength=total) / in_passage,
        np.log1p(long), upper, np.bincount(passage, weights=KIND[last] >= 10, minlength=total) / in_passage, in_passage / PASSAGE,
    ]
    return np.hstack([np.sqrt(shape / size[:, None]), np.stack(extra, axis=1)]), offsets


def passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in K.slices(batch.column("text")):
            x, offsets = encode(texts)
            bags = [x[a:b].astype(np.float32).tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(texts.first, texts.n), pa.array(bags, pa.binary())], ["label", "bag"])


class Model:
    """Gated attention over standardised passages: tanh(Vx) * sigmoid(Ux) -> weight; weighted mean -> score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.p = {"V": rng.normal(0, 0.2, (d, hidden)), "U": rng.normal(0, 0.2, (d, hidden)), "a": rng.normal(0, 0.2, hidden), "w": np.zeros(d), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, offsets: np.ndarray):
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        tanh, gate = np.tanh(x @ p["V"]), sigmoid(x @ p["U"])
        e = (tanh * gate) @ p["a"]
        first, n = offsets[:-1], np.diff(offsets)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        weight = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(weight[:, None] * x, first, axis=0)
        return x, tanh, gate, weight, z, sigmoid(z @ p["w"] + p["b"])

    def score(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.forward(x, offsets)[-1]

    def gradients(self, x: np.ndarray, offsets: np.ndarray, y: np.ndarray, decay: float) -> dict:
        p, n = self.p, np.diff(offsets)
        x, tanh, gate, weight, z, s = self.forward(x, offsets)
        d = (s - y) / len(y)
        from_score = np.repeat(d, n) * (x @ p["w"])
        pull = weight * from_score
        de = pull - weight * np.repeat(np.add.reduceat(pull, offsets[:-1]), n)
        inner = de[:, None] * p["a"]
        return {
            "V": x.T @ (inner * gate * (1 - tanh**2)) + decay * p["V"], "U": x.T @ (inner * tanh * gate * (1 - gate)) + decay * p["U"],
            "a": (tanh * gate).T @ de + decay * p["a"], "w": z.T @ d + decay * p["w"], "b": np.array([d.sum()]),
        }

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(3)
        m, v, t = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                own = [bags[i] for i in rows]
                g = self.gradients(np.concatenate(own), np.r_[0, np.cumsum([len(b) for b in own])], y[rows], decay)
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = 6_000) -> Model:
    """A model from all passages of at most ``rows`` labelled training documents, which bounds what is gathered."""
    got = sampled(texts_of(docs), labels, "quality", folds, held, rows).mapInArrow(passage_rows, "label int, bag binary").collect()
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, WIDTH).astype(float) for r in got]
    every = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
    model = Model(every.mean(axis=0), every.std(axis=0) + 0.02)
    if bags:
        model.fit(bags, np.array([r.label for r in got], float))
    return model


def score_rows(model: Model, limit: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in K.slices(batch.column("text")):
                own, score = batch.slice(texts.first, texts.n), model.score(*encode(texts))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("held_out"), pa.array(score), pa.array((score >= limit).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return rows


def quality(docs: DataFrame, labels: DataFrame, limit: float = 0.3, folds: int = 5, held: int = 0, rows: int = 6_000) -> DataFrame:
    """Score of every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= limit).

    Labels are learned from documents whose crc32(doc_id as text) modulo ``folds`` is not ``held``. A null or empty
    text is one empty passage. Null ids are scored; their crc32 is that of the empty text. Repeated rows are scored
    alike. Without labels every score is 0.5. Other columns are ignored. No rows give no rows.
    """
    model = learn(docs, labels, folds, held, rows)
    own = texts_of(docs).withColumn("held_out", remainder(folds) == held)
    return own.mapInArrow(score_rows(model, limit), "doc_id long, held_out boolean, score double, predicted int")

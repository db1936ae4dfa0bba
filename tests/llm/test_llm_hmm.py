import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, documents, frame, words

from millrace.llm import hmm
from millrace.llm.queries import QUERIES


def brute(docs):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    tokens = {i: [w.lower() for w in words(t)] + [None] for i, t in docs}
    counts = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    return [(i, held[i], len(t), sum(w in counts for w in t), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens.items()]


def check(got, want):
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert all(math.isclose(r.base_score, w[5], rel_tol=1e-9) for r, w in zip(got, want))


def test_query_against_brute_force(spark):
    got = QUERIES["op10_hmm_scores"](spark, SF).orderBy("doc_id").collect()
    check(got, brute(documents(spark)))
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_forward_and_counts_against_all_paths():
    rng = np.random.default_rng(2)
    start, move, emit = (x / x.sum(axis=-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, hmm.CLASSES))))
    seqs = [rng.integers(0, hmm.CLASSES, n).astype(np.uint8) for n in (4, 1, 5, 3)]
    layout = hmm.Layout(np.concatenate(seqs), np.array([len(s) for s in seqs]))
    _, scale = hmm.forward(layout, start, move, emit)
    likelihoods = hmm.log_likelihoods(layout, start, move, emit)
    a, b, c = hmm.expected(layout, start, move, emit)
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES))
    for i, seq in enumerate(seqs):
        probs = {}
        for path in product(range(3), repeat=len(seq)):
            p = start[path[0]] * emit[path[0], seq[0]]
            for x, y, s in zip(path, path[1:], seq[1:]):
                p *= move[x, y] * emit[y, s]
            probs[path] = p
        total = sum(probs.values())
        own = np.log(scale[layout.steps_and_ranks()[1] == list(layout.order).index(i)]).sum()
        assert math.isclose(own, math.log(total)) and math.isclose(likelihoods[i], math.log10(total))
        for path, p in probs.items():
            starts[path[0]] += p / total
            for x, y in zip(path, path[1:]):
                moves[x, y] += p / total
            for x, s in zip(path, seq):
                emits[x, s] += p / total
    assert np.allclose(starts, a) and np.allclose(moves, b) and np.allclose(emits, c)


@pytest.mark.parametrize("sample", [250_000, 40_000])
def test_training_goes_on_until_a_step_gains_little(spark, monkeypatch, sample):
    models, trained = [], hmm.trained
    monkeypatch.setattr(hmm, "SAMPLE", sample, raising=False)
    monkeypatch.setattr(hmm, "trained", lambda *args: models.append(trained(*args)) or models[-1])
    QUERIES["op10_hmm_scores"](spark, SF)
    batch = pa.RecordBatch.from_arrays([pa.array([t for i, t in documents(spark) if zlib.crc32(str(i).encode()) % 10], pa.string())], ["text"])
    seqs = [np.frombuffer(s, np.uint8) for out in hmm.class_rows([batch]) for s in out.column("seq").to_pylist()]
    layout = hmm.Layout(np.concatenate(seqs), np.array([len(s) for s in seqs]))
    a, b, c = hmm.expected(layout, *models[0])
    after = a / a.sum(), b / b.sum(axis=1, keepdims=True), c / c.sum(axis=1, keepdims=True)
    gain = (hmm.log_likelihoods(layout, *after).sum() - hmm.log_likelihoods(layout, *models[0]).sum()) / len(layout.symbols)
    assert 0 <= gain < 1e-4


def test_odd_rows(spark, monkeypatch):
    long = " ".join(f"w{i % 977}" for i in range(20000))
    texts = [None, "", "A b a", long, long, "é . "]
    got = hmm.language_scores(frame(spark, texts).selectExpr("*", "1 AS chunk", "2 AS h", "3 AS c"), chunk_bytes=1000).orderBy("doc_id").collect()
    check(got, brute(list(enumerate(texts))))
    assert all(np.isfinite(r.score) for r in got)
    only_held = hmm.language_scores(frame(spark, ["a", "b"], [None, None])).collect()
    assert [(r.held_out, r.n_known, r.train_tokens) for r in only_held] == [(True, 0, 0)] * 2
    assert hmm.language_scores(frame(spark, [])).collect() == []

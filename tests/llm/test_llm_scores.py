import zlib

import numpy as np
from helpers import frame

from millrace.llm.quality import Model, quality
from millrace.llm.toxicity import INSULT, NEGATION, OTHER, PUT, MOVE, REPORT, TARGET, THREAT, Grammar, toxicity
from millrace.llm.queries import QUERIES
from millrace.llm import kernels as K
import pyarrow as pa

SF = "/root/testdata/sf0.01"


def balance(spark, rows, label):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    right = [[r.predicted == y for r, t in held if t == y] for y in (0, 1)]
    return [np.mean(x) for x in right]


def test_toxicity_on_held_out_documents(spark):
    rows = QUERIES["op3_toxicity"](spark, SF).collect()
    assert len({r.doc_id for r in rows}) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    clean, toxic = balance(spark, rows, "toxic")
    assert clean > 0.97 and toxic > 0.6


def test_quality_on_held_out_documents(spark):
    rows = QUERIES["op4_quality"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    poor, good = balance(spark, rows, "quality")
    assert poor > 0.8 and good > 0.95


def test_composed_transducer():
    def read(*symbols):
        state, out = 0, []
        for s in symbols:
            if PUT[state, s] >= 0:
                out.append(int(PUT[state, s]))
            state = MOVE[state, s]
        return out

    assert read(INSULT) == [0] and read(THREAT) == [8] and read(TARGET, OTHER, INSULT) == [4]
    assert read(NEGATION, OTHER, INSULT) == [2] and read(NEGATION, OTHER, OTHER, OTHER, INSULT) == [0]
    assert read(REPORT, TARGET, INSULT) == [5]


def test_clauses_end_at_punctuation():
    texts = next(K.slices(pa.array(["You are not an IDIOT. idiot", None, "", "he said: you moron"])))
    counts = Grammar().patterns(texts)
    assert counts[0, 6] == 1 and counts[0, 0] == 1 and counts[1:3, :-1].sum() == 0 and counts[3, 5] == 1


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = Model(np.zeros(4), np.ones(4), 3)
    model.p["w"] = rng.normal(size=4)
    x, offsets, y = rng.normal(size=(6, 4)), np.array([0, 1, 4, 6]), np.array([0.0, 1.0, 1.0])

    def loss():
        s = model.score(x, offsets)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = model.gradients(x, offsets, y, 0)
    for name in model.p:
        for at in np.ndindex(model.p[name].shape):
            old = model.p[name][at]
            model.p[name][at] = old + 1e-5
            up = loss()
            model.p[name][at] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - g[name][at]) < 1e-6
            model.p[name][at] = old


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    texts = [("you idiot scum. " if i % 2 else "a fine day. ") * 3 for i in range(40)] + [None, "", "x " * 50000]
    docs = frame(spark, texts, [*range(40), None, 40, 41]).selectExpr("*", "1 AS label", "0 AS score", "2 AS h")
    for operator in (toxicity, quality):
        got = operator(docs, labels).collect()
        assert len(got) == 43 and all(0 <= r.score <= 1 for r in got)
        assert operator(docs.limit(0), labels).collect() == []
        assert {r.score for r in operator(docs, labels.limit(0)).collect()} == {0.5}

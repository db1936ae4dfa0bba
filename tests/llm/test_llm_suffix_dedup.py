import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import SF, documents, frame

from millrace.llm.queries import QUERIES
from millrace.llm.suffix_dedup import inner, multikey_order, neighbours, remove_repeated_bytes


def brute(docs, window=200):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[p : p + window] for _, t in texts for p in range(len(t) - window + 1))
    out = []
    for doc_id, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def summary(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.orderBy("doc_id").collect()]


def test_query_against_brute_force(spark):
    got = [tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, SF).orderBy("doc_id").collect()]
    want = brute(documents(spark))
    assert sum(r[2] for r in want) > 0
    assert got == want


@pytest.mark.parametrize(("seed", "block"), [(0, 1 << 16), (1, 1 << 16), (2, 3), (3, 10)])
def test_small_alphabets_and_cut_blocks(spark, seed, block):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abé" if seed == 1 else "abcdefgh") for _ in range(rng.randrange(60))) for _ in range(8)]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 6))) + "".join(rng.choice("xyz") for _ in range(9)) for _ in range(60)]
    assert summary(remove_repeated_bytes(frame(spark, texts), 20, 6, block)) == brute(list(enumerate(texts)), 20)


def test_multikey_order():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 2, size=(300, 24)).astype(np.uint8)
    rows[100:200] = rows[:100]
    order, common = neighbours(rows)
    keys = [r.tobytes() for r in rows[order]]
    assert keys == sorted(keys) and sorted(order) == list(range(300))
    assert common[0] == -1
    for a, b, n in zip(keys, keys[1:], common[1:]):
        assert a[:n] == b[:n] and (n == 24 or a[n] != b[n])
    assert len(multikey_order(rows[:0])) == 0


def test_whole_characters(spark):
    text = "é".encode() + b"ab" + "ü".encode()
    assert inner(text, 1, 5) == (2, 4)
    a, b = "x" * 10 + "é" * 30 + "ü", "y" * 7 + "à" + "é" * 30 + "ö"
    for r in remove_repeated_bytes(frame(spark, [a, b]), 20, 6, whole_characters=True).collect():
        assert r.kept.decode()


def test_nulls_empty_long_and_repeated_rows(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(200000))
    texts = [None, "", long, long, "z" * 199, "q" * 201]
    got = summary(remove_repeated_bytes(frame(spark, texts)))
    assert [r[1:4] for r in got] == [(0, 0, 0), (0, 0, 0), (200000, 200000, 1), (200000, 200000, 1), (199, 0, 0), (201, 201, 1)]
    same = remove_repeated_bytes(frame(spark, [long, long, "w"], [None, None, 4])).collect()
    assert sorted(r.n_removed for r in same) == [0, 200000, 200000]
    assert remove_repeated_bytes(frame(spark, [])).collect() == []
    clash = frame(spark, ["a"]).selectExpr("*", "1 AS pos", "2 AS h", "3 AS th", "4 AS kept")
    assert remove_repeated_bytes(clash).first().n_bytes == 1

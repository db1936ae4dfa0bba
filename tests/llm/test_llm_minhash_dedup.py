import random

import numpy as np
import pytest
from helpers import SF, documents, frame, words

from millrace.llm.components import components
from millrace.llm.minhash_dedup import near_duplicates, signatures
from millrace.llm.queries import QUERIES


def sets(text, size):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs, size=3, percent=85):
    """All pairs that share a shingle."""
    docs = [(i, sets(t, size)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for n, (_, s) in enumerate(docs):
        for x in s:
            where.setdefault(x, []).append(n)
    common = {}
    for rows in where.values():
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(docs[a][1]) + len(docs[b][1]) - n):
            x, y = sorted((find(docs[a][0]), find(docs[b][0])))
            parent[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in docs]


def result(df):
    return [tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").orderBy("doc_id").collect()]


def test_query_against_brute_force(spark):
    want = brute(documents(spark))
    assert sum(not r[3] for r in want) > 0
    assert result(QUERIES["op6_minhash_dedup"](spark, SF)) == want


@pytest.mark.parametrize("seed", range(2))
def test_leaves_of_a_star_and_chains(spark, seed):
    """Copies at the threshold: leaves link with the middle, some only with each other."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 9, 30, 90]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(own))
            if rng.random() < 0.5:
                base = own
    rng.shuffle(texts)
    assert result(near_duplicates(frame(spark, texts))) == brute(list(enumerate(texts)))


def test_densified_bins_collide_as_often_as_the_sets_overlap():
    rng = np.random.default_rng(3)
    hits = []
    for _ in range(300):
        pool = np.sort(rng.integers(0, 2**64 - 1, 12, dtype=np.uint64))
        a, b = pool[:11], pool[1:]
        both = signatures(np.r_[a, b], np.array([0, 11, 22]), 80)
        hits.append((both[0] == both[1]).mean())
    assert abs(np.mean(hits) - 10 / 12) < 0.03


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (300, 299)]
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.label, set()).add(r.node)
    assert sorted(got.values(), key=min) == [set(range(41)), set(range(100, 120)), {299, 300}]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_nulls_empty_long_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(20000))
    texts = [None, "", "A b", "a  B", "b", long, long + " y"]
    assert result(near_duplicates(frame(spark, texts))) == [
        (0, 0, 0, True), (1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 1, 4, True), (5, 19998, 5, True), (6, 19999, 5, False)
    ]
    odd = near_duplicates(frame(spark, [long, long, long, "q"], [None, 3, 3, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in odd) == [(-1, -1, True), (-1, 3, False), (3, 3, True), (3, 3, True)]
    assert near_duplicates(frame(spark, [])).collect() == []
    assert near_duplicates(frame(spark, ["a"]).selectExpr("*", "1 AS k", "2 AS cls", "3 AS label")).first().kept

"""The join beside all pairs, and the parts it is built from."""

import random

import numpy as np
import pytest
from helpers import SF, documents, frame, words
from pyspark.sql import functions as F

from millrace.llm import jaccard_join as J
from millrace.llm.queries import QUERIES


def sets(text, size=4):
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(docs, percent=85):
    """(doc_id, n_shingles, component_id) by all pairs that share a shingle; null ids come last."""
    docs = [(i, sets(t)) for i, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, common = {}, {}
    for n, (_, s) in enumerate(docs):
        for x in s:
            where.setdefault(x, []).append(n)
    for rows in where.values():
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(docs[a][1]) + len(docs[b][1]) - n):
            parent[find(b)] = find(a)
    least = {}
    for n, (i, _) in enumerate(docs):
        least.setdefault(find(n), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted([(i, len(s), least[find(n)] if s else i) for n, (i, s) in enumerate(docs)], key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()], key=repr)


def test_query_beside_all_pairs(spark):
    assert got(QUERIES["op13_jaccard_join"](spark, SF)) == brute(documents(spark))


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        kind, at = rng.random(), rng.randrange(len(w))
        if kind < 0.5:
            w[at] = f"e{rng.randrange(10**6)}"
        elif kind < 0.75:
            w.insert(at, f"i{rng.randrange(10**6)}")
        elif len(w) > 1:
            del w[at]
    return " ".join(w)


@pytest.mark.parametrize("entry_cost", [0, 4, 10**9])
def test_chains_of_edits_around_the_threshold(spark, entry_cost):
    """Chains that link by single steps, groups that share a passage, and sizes from one shingle up."""
    rng = random.Random(11)
    line = " ".join(f"common{i}" for i in range(12))
    texts = []
    for size in (4, 5, 8, 9, 10, 12, 15, 20, 30, 60, 150, 400, 1500):
        for _ in range(4):
            texts.append(" ".join(f"w{rng.randrange(10**6)}" for _ in range(size)))
            for _ in range(7):
                texts.append(edited(rng, rng.choice(texts[-7:]), max(1, rng.randint(0, size // 30))))
    texts += [f"{line} {' '.join(f'x{rng.randrange(10**6)}' for _ in range(rng.randint(0, 8)))}" for _ in range(120)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = frame(spark, texts, ids)
    assert got(J.jaccard_components(docs, entry_cost=entry_cost)) == brute(list(zip(ids, texts)))


def test_nulls_empty_ties_repeats_and_other_columns(spark):
    long = "very " * 40_000 + "long " * 3
    texts = [None, "", "  \t", "One two", "one TWO", "one", "a b c d", "A b c d", "a b c d", None, long, long + "x", "é ü \x0b ß", "é ü ß"]
    ids = [3, 4, 5, 9, 6, 7, 20, 12, None, None, 30, 31, 40, 41]
    docs = frame(spark, texts + ["a b c d"] * 300, ids + [12] * 150 + [None] * 150)
    more = docs.select("*", *[F.lit(1).alias(c) for c in ("key", "cls", "n", "th", "label", "a.b")])
    assert got(J.jaccard_components(more)) == brute(list(zip(ids, texts)) + [(12, "a b c d")] * 150 + [(None, "a b c d")] * 150)
    assert got(J.jaccard_components(docs.limit(0))) == []


def test_words_of_a_kilobyte_that_cancel_polynomials(spark):
    signs = [0]
    while len(signs) < 1024:
        signs += [1 - s for s in signs]
    a, b = ("".join(x[s] for s in signs) for x in ("ab", "ba"))
    docs = frame(spark, [f"{a} {b} {a} {a} {b}", f"{b} {a} {b} {b} {a}"])
    assert got(J.jaccard_components(docs)) == [(0, 2, 0), (1, 2, 1)]


def test_linked_sets_always_share_a_segment_and_a_neighbourhood():
    """Pairs at the greatest distance allowed, in one band and across two; every block whole, and none."""
    rng = np.random.default_rng(5)
    bands = J.Bands(85, 5000)
    for _ in range(300):
        n = int(rng.integers(6, 900))
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        lost, new = 0, 0
        while True:
            step = rng.random() < 0.5
            l2, n2 = lost + step, new + (not step)
            if (n - l2) * 100 < 85 * (n + n2):
                break
            lost, new = l2, n2
        b = np.r_[a[lost:], rng.integers(1, 2**63, new).astype(np.uint64)]
        h, offsets = np.r_[np.sort(a), np.sort(b)], np.array([0, len(a), len(a) + len(b)])
        keys, blocks = [set(), set()], [set(), set()]
        for at, band, take in bands.roles(np.diff(offsets)):
            if len(at):
                s = J.Segments(bands, h, offsets, at, band, take)
                whole = J.neighbourhoods(s, bands, np.ones(len(s.key), bool))
                for i in (0, 1):
                    keys[i] |= set(s.key[s.owner == i].tolist())
                    blocks[i] |= set(whole[0][whole[1] == i].tolist())
        if lost + new:
            assert keys[0] & keys[1] and blocks[0] & blocks[1], (n, lost, new)


def test_words_of_bits_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(8)
    bands = J.Bands(85, 5000)
    for n in (1, 7, 100, 3000):
        a = np.sort(rng.integers(1, 2**63, n).astype(np.uint64))
        b = np.sort(np.r_[a[n // 5 :], rng.integers(1, 2**63, n // 3).astype(np.uint64)])
        x, y = (np.frombuffer(w, np.uint64) for w in J.bit_words(np.r_[a, b], np.array([0, n, n + len(b)]), bands))
        x, y = sorted((x, y), key=len)
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))

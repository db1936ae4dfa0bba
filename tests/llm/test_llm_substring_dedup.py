import hashlib
import random

import pytest
from helpers import SF, documents, frame, words

from millrace.llm.queries import QUERIES
from millrace.llm.substring_dedup import remove_repeated_words


def brute(docs, window=20):
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_query_against_brute_force(spark):
    got = [tuple(r) for r in QUERIES["op8_substring_dedup"](spark, SF).orderBy("doc_id").collect()]
    want = brute(documents(spark))
    assert sum(r[2] for r in want) > 0
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets(spark, seed):
    rng = random.Random(seed)
    parts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(6)]
    texts = [rng.choice([" ", "\n"]).join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(30)]
    out = remove_repeated_words(frame(spark, texts), 6, 3)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()}
    assert got == {r[0]: r[1:] for r in brute(list(enumerate(texts)), 6)}


def test_nulls_empty_long_and_repeated_rows(spark):
    long = " ".join(str(i) for i in range(30000))
    texts = [None, "", " \n", long, long, "a b", "x " * 50]
    got = {r.doc_id: r for r in remove_repeated_words(frame(spark, texts)).collect()}
    assert [got[i].n_words for i in range(7)] == [0, 0, 0, 30000, 30000, 2, 50]
    assert [got[i].n_removed for i in range(7)] == [0, 0, 0, 0, 30000, 0, 49]
    assert got[4].text == "" and got[6].spans[0].start == 1
    null_id = remove_repeated_words(frame(spark, [long, long, "q"], [None, 1, 1])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in null_id) == [(False, 0), (False, 30000), (True, 0)]
    same = remove_repeated_words(frame(spark, [long, long], [1, 1])).collect()
    assert [r.n_removed for r in same] == [0, 0]
    assert remove_repeated_words(frame(spark, [])).collect() == []


def test_clashing_columns(spark):
    df = frame(spark, ["a b c"]).selectExpr("*", "1 AS pos", "2 AS h", "3 AS th", "4 AS first", "5 AS n_removed")
    assert remove_repeated_words(df).first().n_words == 3

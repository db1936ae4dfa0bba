import random
from itertools import combinations

import numpy as np
import pytest
from helpers import SF, documents, frame, words

from millrace.llm.decontamination import leaks, longest_overlap, masks_for, without_leaks
from millrace.llm.queries import QUERIES


def agree(same, least, percent=80):
    return any(100 * sum(same[a:b]) >= percent * (b - a) for a in range(len(same)) for b in range(a + least, len(same) + 1))


def brute(docs, items, least=13):
    out = set()
    for item_id, item in items:
        test = [w.lower() for w in words(item)]
        if len(test) < 5:
            continue
        vocabulary = set(test)
        for doc_id, text in docs:
            own = [w.lower() for w in words(text)]
            if sum(w in vocabulary for w in own) < 0.8 * min(least, len(test)):
                continue
            for shift in range(-len(test) + 1, len(own)):
                a, b = max(0, -shift), min(len(test), len(own) - shift)
                same = [own[i + shift] == test[i] for i in range(a, b)]
                if sum(same) >= 4 and agree(same, min(least, len(test))):
                    out.add((doc_id, item_id))
                    break
    return out


def test_longest_overlap():
    rng = random.Random(4)
    for _ in range(300):
        same = np.array([rng.random() < 0.7 for _ in range(rng.randrange(25))], bool)
        found = longest_overlap(same, 5, 80)
        assert (found is not None) == agree(same.tolist(), 5)
        if found:
            assert found[0] >= 5 and 100 * found[1] >= 80 * found[0]


def test_query_finds_what_is_there(spark):
    """Every reported leak is one; whole items that stand in a text are all reported."""
    docs = documents(spark)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, SF).collect()}
    squeezed = {i: b" " + b" ".join(words(t)).lower() + b" " for i, t in docs}
    whole = {(d, i) for i, t in items for d, s in squeezed.items() if len(words(t)) >= 5 and b" " + b" ".join(words(t)).lower() + b" " in s}
    assert whole and whole <= got
    some = dict(docs)
    assert got <= brute([(d, some[d]) for d in {d for d, _ in got}], items)


@pytest.mark.parametrize("seed", range(2))
def test_substitutions(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 9, 20, 40])))) for i in range(20)]
    docs, planted = [], set()
    for n in range(60):
        body = [f"v{rng.randrange(3000)}" for _ in range(80)]
        if n % 2:
            i, text = rng.choice(items)
            own = text.split()
            if len(own) >= 20:
                for k in range(rng.randrange(5), len(own), rng.choice([6, 7, 9])):
                    own[k] = "other"
            at = rng.randrange(70)
            body[at:at] = [w.upper() for w in own]
            planted.add((n, i))
        docs.append((n, "\n".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, [t for _, t in docs])
    got = {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()}
    assert got == planted == {(r.doc_id, r.item_id) for r in leaks(df, bench, block_bytes=500).collect()}
    clean = without_leaks(df.selectExpr("*", "1 AS item_id"), bench, block_bytes=500)
    assert {r.doc_id for r in clean.collect()} == {n for n, _ in docs} - {n for n, _ in planted}


@pytest.mark.parametrize("overlap, percent, longest", [(13, 80, 25), (6, 70, 11), (8, 80, 15), (13, 60, 14), (13, 100, 25)])
def test_masks_hit_every_placement(overlap, percent, longest):
    for n in range(5, longest + 1):
        run = min(n, overlap) if n < 2 * overlap else overlap
        for length in {run, n}:
            places = []
            for mask in masks_for(n, overlap, percent):
                bits = sum(1 << i for i, c in enumerate(mask) if c == "1")
                places += [bits << at for at in range(length - len(mask) + 1)]
            for differ in combinations(range(length), length * (100 - percent) // 100):
                hidden = sum(1 << i for i in differ)
                assert any(not p & hidden for p in places), (n, length, differ)


@pytest.mark.parametrize("overlap, percent", [(13, 80), (6, 70)])
def test_random_substitutions_against_brute_force(spark, overlap, percent):
    rng = random.Random(overlap)
    items = [(n, " ".join(f"i{n}w{rng.randrange(60)}" for _ in range(n))) for n in range(5, 31)]
    docs = []
    for n in range(150):
        own = rng.choice(items)[1].split()
        for k in rng.sample(range(len(own)), min(len(own), len(own) * (100 - percent) // 100 + rng.randrange(2))):
            own[k] = "other"
        docs.append((n, " ".join([f"v{rng.randrange(9)}" for _ in range(rng.randrange(9))] + own[rng.choice([0, 0, 3]) :] + ["end"] * rng.randrange(4))))
    got = {(r.doc_id, r.item_id) for r in leaks(frame(spark, [t for _, t in docs]), spark.createDataFrame(items, "item_id long, text string"), overlap, percent).collect()}
    want = set()
    for i, item in items:
        for d, text in docs:
            test, own = item.split(), text.split()
            for shift in range(-len(test) + 1, len(own)):
                same = [own[k + shift] == test[k] for k in range(max(0, -shift), min(len(test), len(own) - shift))]
                if any(same) and agree(same, min(overlap, len(test)), percent):
                    want.add((d, i))
    assert len(want) > 50 and got == want


def test_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "too short"), (None, "a b c d e f")], "item_id long, text string")
    long = " ".join(f"y{i}" for i in range(20000))
    df = frame(spark, [None, "", "too short", long + " " + item, item, item, "A B C D E F"], [0, 1, 2, 3, 4, 4, None])
    got = sorted((r.doc_id or -1, r.item_id or -1) for r in leaks(df, bench).collect())
    assert got == [(-1, -1), (3, 1), (3, 1), (4, 1), (4, 1), (4, 1), (4, 1)]
    assert leaks(df, bench.limit(0)).collect() == [] and leaks(df.limit(0), bench).collect() == []
    assert without_leaks(df, bench).count() == 3 and without_leaks(df, bench.limit(0)).count() == 7

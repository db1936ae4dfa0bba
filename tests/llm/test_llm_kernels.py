import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from millrace.llm import kernels as K


def texts(values):
    return next(K.slices(pa.array(values, pa.string()), 1 << 30))


@settings(deadline=None, max_examples=50)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té", max_size=30)), min_size=1, max_size=8))
def test_words_are_those_of_the_pattern(values):
    import re

    t = texts(values)
    w = K.Words(t)
    want = [[m.encode() for m in re.findall(r"[^\x20\x09-\x0D]+", v or "")] for v in values]
    got = [[t.data[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.offsets, w.offsets[1:])]
    assert got == want
    by_word = {}
    for word, h in zip((x for d in want for x in d), w.hash):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_sliding_min():
    v = np.random.default_rng(1).integers(0, 100, 50).astype(np.uint64)
    for w in (1, 2, 3, 7, 13, 50):
        assert K.sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(51 - w)]
    assert len(K.sliding_min(v, 51)) == 0


@settings(deadline=None, max_examples=50)
@given(st.lists(st.text(alphabet="ab", max_size=40), min_size=1, max_size=4))
def test_every_window_has_an_anchor_chosen_by_content(values):
    t = texts(values)
    sums = K.byte_prefix(t)
    at, _ = K.anchors(sums, t.offsets, 8, 3)
    places = {}
    for i, text in enumerate(values):
        for p in range(len(text) - 7):
            own = at[(at >= t.offsets[i] + p) & (at <= t.offsets[i] + p + 5)] - t.offsets[i] - p
            assert len(own)
            places.setdefault(text[p : p + 8], []).append(set(own.tolist()))
    assert all(set.intersection(*v) for v in places.values())


def test_runs_and_slices():
    s, e = K.runs(np.array([5, 0, 2, 9]), np.array([7, 2, 3, 10]))
    assert list(zip(s, e)) == [(0, 3), (5, 7), (9, 10)]
    column = pa.array(["ab", None, "", "c" * 10, "d"])
    assert [(t.first, t.n, t.data.tobytes()) for t in K.slices(column, 3)] == [(0, 3, b"ab"), (3, 1, b"c" * 10), (4, 1, b"d")]
    assert list(K.slices(pa.array([], pa.string()))) == []


def test_words_of_a_pattern_that_cancels_polynomials_differ():
    signs = [0]
    while len(signs) < 4096:
        signs += [1 - s for s in signs]
    for n in (8, 64, 65, 512, 1024, 2048, 4096):
        a = "".join("ab"[s] for s in signs[:n])
        b = "".join("ba"[s] for s in signs[:n])
        h = K.Words(texts([f"{a} {b} {a}"])).hash
        assert h[0] == h[2] != h[1]


def test_run_hash_is_that_of_the_bytes_alone():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    start = rng.integers(0, 3000, 3000)
    end = start + rng.integers(0, 200, 3000)
    seen = {}
    for s, e, h in zip(start, end, K.run_hash(data, start, end)):
        assert seen.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
    moved = np.r_[np.zeros(5, np.uint8), data]
    assert (K.run_hash(moved, start + 5, end + 5) == K.run_hash(data, start, end)).all()

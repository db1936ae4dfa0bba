"""The whole pipeline, stage by stage, against plain versions over planted copies, repeated rows, nulls and leaks."""

import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from helpers import words
from test_llm_decontamination import brute as brute_leaks

import corpus_pipeline
from millrace.llm.sentencepiece_lattice import decode_documents
from millrace.llm.toxicity import toxicity


def shingles(text):
    own = [w.lower() for w in words(text)]
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def plain_near(rows):
    """One row for each id and text that is first of its group."""
    distinct = sorted({(r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or "") for r in rows})
    sets, group = [shingles(d[3]) for d in distinct], list(range(len(distinct)))
    for a in range(len(distinct)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {g: distinct[i] for i, g in reversed(list(enumerate(group)))}
    kept = [distinct[i] if not sets[i] else first[g] for i, g in enumerate(group) if not sets[i] or first[g] == distinct[i]]
    return [(None if no_id else i, text if given else None) for no_id, i, given, text in kept]


def plain_suffix(rows):
    seen = Counter(t[i : i + 200] for t in (r.text or "" for r in rows) for i in range(len(t) - 199))
    out = []
    for r in rows:
        gone = set()
        for i in range(len(r.text or "") - 199):
            if seen[r.text[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        out.append((r.doc_id, None if r.text is None else "".join(c for i, c in enumerate(r.text) if i not in gone)))
    return out


def in_order(pairs):
    return sorted(pairs, key=repr)


def test_every_stage_against_a_plain_version(spark, tmp_path, monkeypatch):
    rng = random.Random(5)

    def body(n):
        return " ".join(f"w{rng.randrange(100000)}" for _ in range(n))

    repeated, nameless, near = body(60), body(70), body(80).split()
    items = [(1, body(30)), (2, body(9)), (3, body(16))]
    leaked = [items[0][1].split(), items[1][1].split(), items[2][1].split()]
    leaked[0][3], leaked[1][4], leaked[2][7] = "x", "y", "z"
    shared = body(40)
    docs = [(i, body(50)) for i in range(100, 120)]
    docs += [(i, f"{body(12)} you are an idiot and a moron, shut up you stupid idiot. {body(5)}") for i in range(40)] + [(i, body(30)) for i in range(40, 80)]
    docs += [(200, repeated)] * 3 + [(None, nameless)] * 2 + [(None, body(50)), (201, None), (201, ""), (201, None), (None, None), (None, None), (None, ""), (None, "")]
    docs += [(210, " ".join(near)), (211, " ".join([*near[:-1], "other"])), (None, " ".join(["first", *near[1:]])), (None, " ".join(["first", *near[1:]]))]
    docs += [(220 + i, f"{body(20)} {' '.join(own)} {body(20)}") for i, own in enumerate(leaked)]
    docs += [(230 + i, f"{body(60)} {shared} {body(60)}") for i in range(2)]
    rng.shuffle(docs)
    ids, texts = zip(*docs)
    n = len(docs)
    table = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": [str(i) for i in range(n)], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(table), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": [t for _, t in items]}), tmp_path / "benchmark.parquet")
    labels = {"doc_id": pa.array(range(80), pa.int64()), "quality": pa.array([1] * 80, pa.int32()), "toxic": pa.array([int(i < 40) for i in range(80)], pa.int32())}
    pq.write_table(pa.table(labels), tmp_path / "labels.parquet")

    inputs = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            inputs[name] = docs, docs.collect()
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(name, stage) for name, stage in corpus_pipeline.STAGES])
    last = corpus_pipeline.run(spark, str(tmp_path))
    pairs = {name: in_order((r.doc_id, r.text) for r in rows) for name, (_, rows) in inputs.items()}
    assert pairs["toxicity"] == in_order(docs)

    first, rows = inputs["toxicity"]
    scored = toxicity(first, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert [r.doc_id for r in scored] == [r.doc_id for r in rows]
    assert pairs["near_dedup"] == in_order((r.doc_id, r.text) for r, s in zip(rows, scored) if not s.predicted)
    assert {r.doc_id for r, s in zip(rows, scored) if s.predicted} == set(range(40))

    assert pairs["suffix_dedup"] == in_order(plain_near(inputs["near_dedup"][1]))
    assert pairs["suffix_dedup"].count((200, repeated)) == pairs["suffix_dedup"].count((None, nameless)) == 1
    given = {r.source: r for r in inputs["near_dedup"][1]}
    assert all(given[r.source] == r for r in inputs["suffix_dedup"][1])

    assert pairs["decontamination"] == in_order(plain_suffix(inputs["suffix_dedup"][1]))
    assert pairs["decontamination"].count((200, repeated)) == pairs["decontamination"].count((None, nameless)) == 1
    assert pairs["decontamination"] != pairs["suffix_dedup"]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in inputs["decontamination"][1])

    rows = inputs["decontamination"][1]
    leaks = {d for d, _ in brute_leaks([(n, r.text) for n, r in enumerate(rows)], items)}
    assert pairs["sentencepiece"] == in_order((r.doc_id, r.text) for n, r in enumerate(rows) if n not in leaks)
    assert {rows[n].doc_id for n in leaks} == {220, 221, 222}

    got = decode_documents(last, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert in_order((r.doc_id, r.text) for r in got) == in_order((i, t or "") for i, t in pairs["sentencepiece"])
    assert all(r.round_trip for r in last.collect())


def test_near_dedup_keeps_columns_no_order_is_defined_for(spark, where):
    rows = [(1, "a b c d e f g", {"k": 1}), (1, "a b c d e f g", {"k": 2}), (2, "a b c d e f g", {"k": 3}), (3, "", {}), (3, None, None), (None, "x", None), (None, "x", None)]
    spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>").write.parquet(where("mapped"))
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(where("mapped")), "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, "a b c d e f g"), (3, ""), (3, None), (None, "x")])
    assert next(r.m for r in got if r.doc_id == 1)["k"] in (1, 2)

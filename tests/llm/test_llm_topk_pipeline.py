import duckdb
import numpy as np
import pytest
from helpers import SF, documents

import corpus_pipeline
from millrace.llm.queries import ORACLES, QUERIES
from millrace.llm.topk import top_k


def test_topk_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert sorted(tuple(r) for r in QUERIES["op5_topk"](spark, SF).collect()) == sorted(db.execute(ORACLES["op5_topk"]).fetchall())


@pytest.mark.parametrize("block", [4096, 4])
def test_ties_copies_and_odd_vectors(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 4)]) for i in range(120)] + [(200 + i, [1.0] * 4) for i in range(60)]
    odd = [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 0.0, 0.0, 0.0]), (350, [float("inf")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_k(df.selectExpr("*", "1 AS v", "2 AS q"), block=block).collect())
    want = []
    for q, a in rows:
        if q % 50 == 0:
            best = sorted((-int(sum(np.floor(256 * x) * np.floor(256 * y) for x, y in zip(a, b))), i) for i, b in rows if i != q)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert top_k(few).count() == 2 and top_k(df.limit(0)).collect() == []


def test_pipeline(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in list(stages)[:4]:
        after = stages[name](spark, docs, SF)
        assert after.columns == docs.columns
        if name == "suffix_dedup":
            assert after.count() == docs.count()
        docs = spark.createDataFrame(after.collect(), after.schema)
    ids = {r.doc_id for r in docs.collect()}
    assert ids < {i for i, _ in documents(spark)}
    last = stages["sentencepiece"](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == ids and all(r.round_trip for r in last)

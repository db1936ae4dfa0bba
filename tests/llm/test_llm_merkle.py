"""The manifest beside a plain tree built in Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from helpers import DOCS, SF
from pyspark.sql import functions as F

from millrace.llm.merkle import folded, manifest, proof_hash
from millrace.llm.queries import QUERIES

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    """The top of some hashes and, for each, its siblings left and right, level by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = at // fanout * fanout
            paths[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fanout])))
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        where = [at // fanout for at in where]
    return nodes[0], paths


def brute(rows, fanout=16):
    """(doc_id, leaf, subroot, root, proof, folded, verified) for rows (doc_id, source, lang, n_chars, text)."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(((r[0] is not None, r[0] or 0, leaf_of(r)), r))
    trees = []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        ordered = [r for _, r in sorted(by_source[source], key=lambda x: x[0])]
        trees.append((ordered, *tree([leaf_of(r) for r in ordered], fanout)))
    if not trees:
        return []
    root, above = tree([top for _, top, _ in trees], fanout)
    out = []
    for (ordered, top, paths), upper in zip(trees, above):
        for r, path in zip(ordered, paths):
            path = path + upper
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf_of((*r[:4], text))
            for left, right in path:
                h = H(left, h, right)
            out.append((r[0], leaf_of(r), top, root, H(*[x for p in path for x in p]), h, h == root))
    return sorted(out, key=repr)


def result(docs, fanout=16):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    m = manifest(docs, fanout=fanout, claims={"text": text}).withColumn("back", folded(F.col("claimed"), F.col("path")))
    out = m.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")), "back", F.col("back") == F.col("root"))
    return sorted([tuple(r) for r in out.collect()], key=repr)


def test_query_beside_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = sorted([tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, SF).collect()], key=repr)
    want = brute([tuple(r) for r in docs.collect()])
    assert got == want
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_sizes_nulls_ties_and_repeats(spark, fanout):
    rows = [(i, f"T{i} Ä", "en", f"s{n}", i) for n in range(1, 20) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "A", None, None, 1), (7, "", "en", None, 0), (7, None, "en", None, 0), (5, "Same", "en", "s9", 4), (5, "Same", "en", "s9", 4)]
    rows += [(1, "x" * 300_000, "en", "", 300_000), (10, "AB", "é", "ÿ", 2), (-3, "AB", "é", "\U0001f600", 2)]
    docs = spark.createDataFrame(rows, DOCS)
    assert result(docs, fanout) == brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows], fanout)


def test_one_source_of_equal_rows(spark):
    rows = [(3, "Twice", "en", "s", 5)] * 300
    assert result(spark.createDataFrame(rows, DOCS)) == brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows])


def test_one_leaf_empty_table_and_other_columns(spark):
    one = spark.createDataFrame([(1, "A", "en", "s", 1)], DOCS)
    assert result(one) == brute([(1, "s", "en", 1, "A")])
    assert result(one.limit(0)) == []
    more = one.select("*", *[F.lit(1).alias(c) for c in ("h", "tree", "at", "n", "node", "path", "top", "id", "claimed", "a.b")])
    assert result(more) == result(one)
    assert manifest(one).first().claimed is None

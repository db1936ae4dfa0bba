"""The trie beside a plain one built in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import SF, words
from pyspark.sql import functions as F

from millrace.llm.prefix_trie import numbered_turns, prefix_trie, with_shared_heads
from millrace.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        own = (len(members[node]) - 1) * len(words(node[-1][1])) if node else 0
        saved[node] = own + sum(saved[b] for b in below)
        ends = [c for c in members[node] if len(convs[c]) == len(node)]
        parent = members[node[:-1]][0] if node else None
        out.append((members[node][0], len(node), parent, len(members[node]), len(below), leaves[node], saved[node], SHA(",".join(map(str, ends)))))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted([tuple(r) for r in df.select(COLUMNS).collect()], key=repr)


def test_query_beside_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_prefix_trie"](spark, SF)
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert rows_of(got) == trie(rebuilt(rows))


def planted():
    """A conversation with a third of all turns and a copy of it, copies, nulls, ties, negative ids, hot first turns, a turnless one."""
    rng = random.Random(3)
    rows = [(0, i, "user", f"long {i % 7} x") for i in range(400)] + [(41, i, "user", f"long {i % 7} x") for i in range(400)]
    for c in range(2, 120):
        rows.append((c, 0, "user", "Hello there"))
        for i in range(1, rng.randint(1, 6)):
            rows.append((c, i, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "é 　 d", "a  b"])))
    rows += [(c, None if i == 1 else i, "user", f"copy {i}") for c in range(200, 260) for i in range(5)]
    rows += [(-7, 1, "user", "x"), (-7, 1, "user", "y"), (-7, 1, "user", "y"), (-20, 3, "u", "z"), (-20, 4, "u", "z"), (None, 1, "user", "nobody")]
    return rows + [(c, 0, "user", "one turn") for c in range(301, 318)]


@pytest.mark.parametrize("cells", [1 << 3, 1 << 24])
def test_planted(spark, cells):
    """Equal rows whatever the sketch can prove: with eight cells it proves nothing."""
    rows = planted()
    random.Random(5).shuffle(rows)
    table = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("key", "words", "i", "depth", "x", "single", "piece")})
    convs = rebuilt(rows)
    assert any(not c for c in convs.values())
    assert rows_of(prefix_trie(*with_shared_heads(numbered_turns(table)), most_cells=cells)) == trie(convs)


def test_plain_conversations_and_empty_table(spark):
    rows = [(1, 0, "u", "a b"), (1, 1, "v", "c"), (2, 0, "u", "a b"), (3, 5, "u", "a b"), (3, 6, "v", "d")]
    turns = numbered_turns(spark.createDataFrame(rows, TURNS))
    convs = spark.createDataFrame([(1,), (2,), (3,)], "conv_id long")
    assert rows_of(prefix_trie(turns, convs)) == trie({1: [("u", "a b"), ("v", "c")], 2: [("u", "a b")], 3: [("u", "a b"), ("v", "d")]})
    assert rows_of(prefix_trie(*with_shared_heads(numbered_turns(spark.createDataFrame([], TURNS))))) == []

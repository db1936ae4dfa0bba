"""The trie of all conversation prefixes: what each shares, and what a cache of prefixes would save.

Every prefix has a digest, a running xor over hashes of turn and depth, so a conversation of any length is digested in
pieces. A count-min sketch of fixed size counts all digests; a prefix it has seen once at most has one member, and so
has whatever goes on from it. Those tails are put out where they are. Only prefixes that may be shared are shuffled
and grouped exactly. Sums over subtrees need no walk: each node belongs to its smallest member, so a subtree is what
its members own from that depth on, a running sum along each conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.stage import written
from millrace.operators import Segments
from millrace.operators.segments import PIECE

BLOCK = 1 << 16
CHUNK = 1000
NODE = ["depth", "x", "y"]


def numbered_turns(conversations: DataFrame) -> Segments:
    """Turns in their order: conv_id, turn, key (a digest of role and text), words, i from 1.

    Null turns come first, turns of one number by the digest of role and text. Null role or text is empty.
    Rows without conv_id belong to no conversation and take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return Segments(turns, ["conv_id"], ["turn", "key"]).row_number("i")


def with_shared_heads(turns: Segments, family: int = 20, most: int = 4) -> tuple[Segments, DataFrame]:
    """Conversations rebuilt on the first turns of another one, and the ids of all of them.

    Conversation c starts with the first h turns of c - c % ``family`` (all if fewer, none if it is absent), then come
    its own after the first h; h = crc32(c) % ``most``.
    """
    own = turns.rows().select("conv_id", PIECE, "i", "key", "words")
    own = written(own.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most), "turns")
    convs = own.groupBy("conv_id", "h").agg(F.min(PIECE).alias(PIECE))
    heads = own.where((F.col("i") < most) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("i", "key", "words"))).alias("head"))  # fewer than ``most``
    lent = convs.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("base"))
    lent = lent.select("conv_id", PIECE, "h", F.inline("head")).where("i <= h").drop("h")
    rows = own.where("i > h").drop("h").unionByName(lent)
    return turns.relaid(written(rows, "rebuilt"), ["i"]), convs.select("conv_id")


def digests(turns: Segments) -> DataFrame:
    """Every prefix, written: conv_id, depth, x, y (its digest), px, py (that of its parent), words, ends (the whole conversation)."""
    placed = turns.row_number("depth").total({"turns": ("count", F.lit(1))})
    one, two = F.xxhash64("depth", "key"), F.xxhash64("key", "depth", F.lit("y"))
    rows = placed.running({"x": ("bit_xor", one), "y": ("bit_xor", two)}).frame()
    return written(
        rows.select("conv_id", "depth", "x", "y", F.col("x").bitwiseXOR(one).alias("px"), F.col("y").bitwiseXOR(two).alias("py"), "words", (F.col("depth") == F.col("turns")).alias("ends")),
        "prefixes",
    )


def cells(column: pa.Array, width: int) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(width - 1)


def counted(width: int):
    """Counts up to two of this task's digests, in blocks of bits: at least one, at least two."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, width), np.uint8)
        for batch in batches:
            for line, name in enumerate("xy"):
                cell, n = np.unique(cells(batch.column(name), width), return_counts=True)
                counts[line, cell] = np.minimum(counts[line, cell] + np.minimum(n, 2), 2)
        flat = counts.reshape(-1, min(BLOCK, width))
        for block in np.flatnonzero(flat.any(axis=1)):
            once, twice = (np.packbits(flat[block] >= k).tobytes() for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([once]), pa.array([twice])], ["block", "once", "twice"])

    return rows


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of all tasks as one each; only one block is held, since they come in order."""
    at, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([twice.tobytes()])], ["block", "twice"])

    for batch in batches:
        for block, one, two in zip(*(batch.column(i).to_pylist() for i in range(3))):
            one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
            if block != at:
                if at is not None:
                    yield done()
                at, once, twice = block, one, two
            else:
                twice = twice | two | (once & one)
                once = once | one
    if at is not None:
        yield done()


def sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """Which of ``width`` cells, in each of two lines, count more than one digest: 2 * ``width`` bits on the driver."""
    blocks = prefixes.select("x", "y").mapInArrow(counted(width), "block long, once binary, twice binary")
    whole = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block long, twice binary")
    each = min(BLOCK, width) // 8
    bits = np.zeros(2 * width // 8, np.uint8)
    for row in whole.toLocalIterator():
        bits[row.block * each : (row.block + 1) * each] = np.frombuffer(row.twice, np.uint8)
    return bits.reshape(2, -1)


def screened(prefixes: DataFrame, most_cells: int) -> DataFrame:
    """The prefixes with ``single`` and ``parent_single``: the sketch proves one member. Written."""
    n = prefixes.count()
    width = min(most_cells, max(1 << 16, 1 << int(4 * n).bit_length()))
    bits = prefixes.sparkSession.sparkContext.broadcast(sketch(prefixes, width))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = []
            for names in ("xy", ("px", "py")):
                shared = np.ones(len(batch), bool)
                for line, name in enumerate(names):
                    cell = cells(batch.column(name), width)
                    shared &= (bits.value[line][cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
                alone.append(~shared)
            alone[1] &= batch.column("depth").to_numpy() > 1
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, alone)], [*batch.schema.names, "single", "parent_single"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema)
    return written(prefixes.mapInArrow(rows, f"{kinds}, single boolean, parent_single boolean"), "screened")


def hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined parts of each node; parts come in order and are not held."""
    at, state = None, None

    def done():
        return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in at], pa.array([state.hexdigest()])], [*NODE, "ends_sha256"])

    for batch in batches:
        for *node, part in zip(*(batch.column(c).to_pylist() for c in (*NODE, "part"))):
            if node != at:
                if at is not None:
                    yield done()
                at, state = node, hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
    if at is not None:
        yield done()


def ends_of(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) from (depth, x, y, conv_id): ids ascend and are joined a thousand to a row first."""
    s = Segments(ends, NODE, ["conv_id"], tie=["conv_id"]).row_number("r")
    parts = s.frame().groupBy(*NODE, F.floor((F.col("r") - 1) / CHUNK).alias("chunk"))
    parts = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("part"))
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInArrow(hashed_lists, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(turns: Segments, convs: DataFrame, most_cells: int = 1 << 24) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included.

    ``turns`` holds conv_id, key, words in the order of each conversation (``numbered_turns``); ``convs`` the ids of
    all, turnless ones too. Returns conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree: members beyond the first,
    times the words of the last turn) and ends_sha256 (of the ids of conversations that end there, ascending).

    The sketch takes four cells per prefix or more, ``most_cells`` at most (a quarter of a byte each on the driver and
    in every task that reads it); beyond that it proves less and more is grouped exactly, with equal results.
    No conversations give no rows, not even a root.
    """
    prefixes = digests(turns)
    flagged = screened(prefixes, most_cells)
    tails = flagged.where("single")
    turnless = convs.join(prefixes.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(True).alias("ends"))
    zero = F.lit(0).cast("long")
    roots = turnless.unionByName(prefixes.where("depth = 1").select("conv_id", F.lit(False).alias("ends")))
    roots = roots.select("conv_id", zero.alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("px"), zero.alias("py"), zero.alias("words"), "ends", F.lit(False).alias("parent_single"))
    shared = flagged.where("NOT single").drop("single").unionByName(roots)

    grouped = written(
        shared.groupBy(*NODE).agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("px").alias("px"), F.max("py").alias("py"), F.max("words").alias("words"),
            F.bool_or("parent_single").alias("parent_single"),
        ),
        "shared",
    )
    born = grouped.where("depth > 0").select("depth", "px", "py", "parent_single").unionByName(tails.select("depth", "px", "py", "parent_single")).where("NOT parent_single")
    children = born.groupBy((F.col("depth") - 1).alias("d"), F.col("px").alias("cx"), F.col("py").alias("cy")).agg(F.count("*").alias("n_children"))
    met = (F.col("depth") == F.col("d")) & (F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy"))
    nodes = written(grouped.join(children, met, "left").drop("d", "cx", "cy").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")

    # what each conversation owns: the nodes it is the smallest member of
    owned = nodes.select(F.col("conv_id").alias("owner"), F.col("depth").alias("d"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    last = tails.where("ends").select("conv_id", *NODE, F.lit(True).alias("single"))
    members = shared.select("conv_id", *NODE, F.lit(False).alias("single")).unionByName(last)
    valued = members.join(owned, (F.col("conv_id") == F.col("owner")) & (F.col("depth") == F.col("d")), "left").select(
        "conv_id", *NODE, "single", F.coalesce("saved", zero).alias("saved"), F.coalesce("leaf", F.col("single").cast("long")).alias("leaf")
    )
    along = Segments(valued, ["conv_id"], ["-depth"], tie=["x"]).running({"below": ("sum", "saved"), "leaves": ("sum", "leaf")}).frame()
    sums = along.where("NOT single").groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("below").alias("saved_tokens"))

    done = nodes.join(sums, NODE).join(ends_of(shared.where("ends").select(*NODE, "conv_id")), NODE, "left")
    no_ends = F.sha2(F.lit(""), 256)
    done = done.select("conv_id", *NODE, "px", "py", "parent_single", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", no_ends).alias("ends_sha256"))
    alone = tails.select(
        "conv_id", *NODE, "px", "py", "parent_single", F.lit(1).cast("long").alias("n_convs"), (~F.col("ends")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"), F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(no_ends).alias("ends_sha256"),
    )
    columns = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = done.unionByName(alone)
    inside = every.where("parent_single").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *columns)
    root = nodes.where("depth = 0").select("conv_id").first()
    first = F.lit(root[0] if root else None).cast("long")
    top = every.where("depth < 2 AND NOT parent_single").select("conv_id", "depth", F.when(F.col("depth") == 1, first).alias("parent_conv_id"), *columns)
    parents = written(nodes.where("n_children > 0 AND depth > 0").select(F.col("depth").alias("d"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("conv_id").alias("parent_conv_id")), "parents")
    seek = (F.col("depth") - 1 == F.col("d")) & (F.col("px") == F.col("cx")) & (F.col("py") == F.col("cy"))
    under = every.where("depth > 1 AND NOT parent_single").join(parents, seek).select("conv_id", "depth", "parent_conv_id", *columns)
    return inside.unionByName(top).unionByName(under)

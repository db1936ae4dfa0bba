"""A Merkle manifest of a dataset: one tree per source, one over the sources, proofs and checks for every row.

The tree is built by pivoting: the children of a parent are spread by their slot into as many columns as a node has
children at most. Joining the columns and hashing gives the parent; leaving out a child's own slot gives its siblings.
Going down again, each child takes the path of its parent and puts its own siblings before it, so a level costs one
join of one row per parent. Places within a source come from a segmented scan, which splits a source of any size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.stage import written
from millrace.operators import Segments

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other; a null part is left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A field so that no two lists of fields give one text: its length in bytes, a colon, itself; ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Forest:
    """Trees over leaves: ``leaves`` and each of ``levels``, the parents of the one below, as written tables.

    Nodes have the ``tree`` they belong to, their place ``at`` in it, the number ``n`` of nodes beside them and
    themselves, and a struct ``node`` that holds their hash ``h``. Parents have ``slots``, the structs of their children.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    fanout: int

    @classmethod
    def over(cls, leaves: DataFrame, fanout: int) -> Forest:
        """Every ``fanout`` nodes of a tree become one, until one is left. One job per level."""
        forest, nodes = cls(leaves, [], fanout), leaves
        most = leaves.agg(F.max("n")).first()[0] or 0
        while most > 1:
            parents = written(pivot(nodes.where("n > 1"), fanout), f"level_{len(forest.levels)}")
            forest.levels.append(parents)
            nodes, most = parents, -(-most // fanout)
        return forest

    def tops(self) -> DataFrame:
        """The one node each tree ends in: tree, the ``height`` it stands at, its hash."""
        every = [self.leaves, *self.levels]
        parts = [nodes.where("n = 1").select("tree", F.lit(k).alias("height"), F.col("node.h").alias("h")) for k, nodes in enumerate(every)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """Every leaf with its path: tree, node, path, top.

        A path lists, from the leaf up, what stands left and right of the node in each run. ``above`` (tree, height,
        path, top) goes on from the top of each tree; ``top`` is handed down.
        """
        down = None
        for k in range(len(self.levels), 0, -1):
            known = above.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("at"), "path", "top")
            known = known if down is None else known.unionByName(down.select("tree", "at", "path", "top"))
            known = known.select(F.col("tree").alias("t"), F.col("at").alias("place"), "path", "top")
            met = self.levels[k - 1].join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("place")))
            child = met.select("tree", "at", "path", "top", F.transform("slots", lambda c: c["h"]).alias("hs"), F.posexplode("slots").alias("k", "node"))
            beside = F.struct(
                F.concat_ws("", F.slice("hs", F.lit(1), F.col("k"))).alias("left"),
                F.concat_ws("", F.slice("hs", F.col("k") + 2, F.lit(self.fanout))).alias("right"),
            )
            place = F.col("at") * self.fanout + F.col("k")
            down = child.select("tree", place.alias("at"), "node", F.concat(F.array(beside), F.col("path")).alias("path"), "top")
        alone = above.where("height = 0").select(F.col("tree").alias("t"), "path", "top")
        lone = self.leaves.where("n = 1").join(alone, F.col("tree").eqNullSafe(F.col("t"))).select("tree", "node", "path", "top")
        return lone if down is None else lone.unionByName(down.select("tree", "node", "path", "top"))


def pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes to their parents, the children in one column per slot."""
    slot = F.pmod(F.col("at"), F.lit(fanout))
    spread = nodes.groupBy("tree", F.floor(F.col("at") / fanout).alias("at")).agg(
        F.max("n").alias("n"), *[F.max(F.when(slot == k, F.col("node"))).alias(f"c{k}") for k in range(fanout)]
    )
    slots = [F.col(f"c{k}") for k in range(fanout)]
    return spread.select(
        "tree", "at", F.ceil(F.col("n") / fanout).alias("n"), F.struct(digest(*[s["h"] for s in slots]).alias("h")).alias("node"),
        F.filter(F.array(*slots), lambda c: c.isNotNull()).alias("slots"),
    )


def placed(nodes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Nodes with their place ``at`` in the order and their number ``n``, written."""
    s = Segments(nodes, keys, order)
    numbered = s.row_number("place").total({"n": ("count", F.lit(1))}).frame()
    out = written(numbered.withColumn("at", F.col("place") - 1).drop("place"), "placed")
    s.close()
    return out


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "source", order: str = "doc_id", fanout: int = FANOUT, claims: dict[str, Column] | None = None
) -> DataFrame:
    """Every row with its leaf hash and its proof: doc_id (``order``), leaf, claimed, subroot, root, path.

    A leaf is the hash of ``fields``, each with its length (``field``). Leaves of one ``tree`` value ascend by
    ``order``, nulls first; every ``fanout`` nodes become the hash of their hashes until one is left, the subroot.
    Subroots in the order of the tree values, null first, give the root alike. ``path`` lists the siblings left and
    right of the row's node in each run up to the root (``proof_hash``, ``folded``).
    ``claims`` replaces fields by what someone says they are; ``claimed`` is the leaf of that, null without claims.

    Null and empty fields differ in the hash. Rows of one tree and id come by their leaf hash; rows that repeat in all
    fields are leaves each. A null tree is a tree. Other columns are ignored. No rows give no rows and no root.
    """
    value = lambda c, said: field(said.get(c, F.col(f"`{c}`")))
    claimed = digest(*[value(c, claims) for c in fields]) if claims else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{tree}`").alias("tree"), F.col(f"`{order}`").alias("id"), digest(*[value(c, {}) for c in fields]).alias("h"), claimed.alias("claimed"))
    leaves = placed(rows, ["tree"], ["id", "h"]).select("tree", "at", "n", F.struct("h", "id", "claimed").alias("node"))
    forest = Forest.over(leaves, fanout)
    subroots = placed(forest.tops(), [], ["tree"])
    over = Forest.over(subroots.select(F.lit(0).alias("tree"), "at", "n", F.struct("h", F.col("tree").alias("of"), "height").alias("node")), fanout)
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    start = over.tops().select("tree", "height", no_path.alias("path"), F.col("h").alias("top"))
    above = over.paths(start).select(F.col("node.of").alias("tree"), "node.height", "path", F.struct(F.col("top").alias("root"), F.col("node.h").alias("subroot")).alias("top"))
    return forest.paths(above).select(
        F.col("node.id").alias(order), F.col("node.h").alias("leaf"), "node.claimed", "top.subroot", "top.root", "path"
    )


def proof_hash(path: Column) -> Column:
    """One hash for a whole proof: its siblings level by level, left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(path, lambda p: F.array(p["left"], p["right"])))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))

"""Merkle manifest of a table, and octopus multiproofs of its rows.

Every row is a leaf; the leaves of a language, in the order of their ids, form a tree in
which every eight consecutive nodes become one, and the roots of the languages form a tree
in the same way.  A tree is built in blocks of ``SPAN`` leaves: one task climbs
``DEPTH`` levels of a block, so a tree of any size takes few rounds and no task holds
more than a block.

A multiproof works for all leaves of a block at once: the task computes the smallest set of
node coordinates that its leaves cannot derive themselves, the set is fetched in one join,
shared interiors are derived once, and each leaf's own proof is expanded from them.

Rows: a null id comes first and is never tampered with; equal rows are leaves of their own
next to each other; rows with the same id and different content are ordered by their leaf.
An empty table has no rows and no root.  Only ``doc_id, source, lang, n_chars, text`` are
read; other columns, whatever their names, have no influence.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.session import broadcast_if_small, materialise

from .common import arrow_map

FAN = 8
"""Children of a node."""

DEPTH = 4
"""Levels that one round climbs."""

SPAN = FAN ** DEPTH
"""Leaves (about 100 bytes each) of a block."""

TOP = ""
"""Key of the tree over the languages; a language's key is its encoded name and never empty."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """The 32 bytes of a row's leaf, with ``text`` as its text."""
    return F.unhex(F.sha2(F.concat(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, lang, doc_id, digest, tampered (null where the row is not tampered with), copies of equal rows."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(field(F.col("lang")).alias("tree"), "lang", "doc_id", leaf(F.col("text")).alias("digest"),
                       F.when(changed, leaf(F.translate("text", UPPER, LOWER))).alias("tampered"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def width(size: int, level: int) -> int:
    """Nodes of a level in a tree of ``size`` leaves."""
    return -(-size // FAN ** level)


def combine(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def missing(positions: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The smallest set of (level, index) from which, with the leaves at ``positions``, the root follows."""
    have, out = np.unique(positions), []
    for level in range(height(size)):
        parents = np.unique(have // FAN)
        children = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        children = children[children < width(size, level)]
        out += [(level, int(i)) for i in np.setdiff1d(children, have, assume_unique=True)]
        have = parents
    return out


# --- building ----------------------------------------------------------------
def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``first``, a row's place in its tree, and ``size``, the tree's leaves.

    Rows are dealt by range of (tree, order) and numbered inside each part; the counts of the
    parts before are added.  No tree has to fit one task.
    """
    def number(batch):
        nonlocal at
        out = []
        for key, n in zip(zip(batch.column("part").to_pylist(), batch.column("tree").to_pylist()), batch.column("copies").to_pylist()):
            at = (key, at[1] if at[0] == key else 0)
            out.append(at[1])
            at = (key, at[1] + n)
        return {**{name: batch.column(name) for name in names}, "local": out}

    at = (None, 0)
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("part", F.spark_partition_id())
    names = dealt.columns
    numbered = materialise(arrow_map(dealt, number, ", ".join(f"{n} {t}" for n, t in dealt.dtypes) + ", local bigint"))
    parts = numbered.groupBy("tree", "part").agg(F.sum("copies").alias("held"))
    of_tree = Window.partitionBy("tree")
    before = F.sum("held").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = broadcast_if_small(parts.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(of_tree).alias("size")))
    return numbered.join(offsets, ["tree", "part"]).withColumn("first", F.col("before") + F.col("local")).drop("part", "before", "local")


def in_blocks(rows: DataFrame) -> DataFrame:
    """One row per block that a row's copies lie in: they stand from ``low`` up to ``high``."""
    first, end = F.col("first"), F.col("first") + F.col("copies")
    cut = rows.withColumn("block", F.explode(F.sequence(F.floor(first / SPAN), F.floor((end - 1) / SPAN))))
    return cut.withColumn("low", F.greatest(first, F.col("block") * SPAN)).withColumn("high", F.least(end, (F.col("block") + 1) * SPAN))


def climb(blocks: DataFrame, base: int) -> DataFrame:
    """tree, level, index, digest of the nodes above the blocks' rows, which are nodes of level ``base``."""
    def run(table: pa.Table) -> pa.Table:
        tree, size = table.column("tree")[0].as_py(), table.column("size")[0].as_py()
        nodes = {}
        for low, high, digest in zip(*(table.column(c).to_pylist() for c in ("low", "high", "digest"))):
            nodes.update(dict.fromkeys(range(low, high), digest.hex()))
        out = []
        for level in range(base + 1, min(base + DEPTH, height(size)) + 1):
            last = width(size, level - 1)
            nodes = {p: combine([nodes[i] for i in range(p * FAN, min(p * FAN + FAN, last))]) for p in sorted({i // FAN for i in nodes})}
            out += [(tree, size, level, p, bytes.fromhex(d)) for p, d in nodes.items()]
        columns = zip(*out) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                                    ["tree", "size", "level", "index", "digest"])

    return blocks.select("tree", "size", "block", "low", "high", "digest").groupBy("tree", "block").applyInArrow(
        run, "tree string, size bigint, level int, index bigint, digest binary")


def build(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The placed rows, all inner nodes, and (tree, size, root) of trees over rows with ``tree``, ``digest`` and ``copies``."""
    stored = placed(rows, order)
    largest = stored.agg(F.max("size")).first()[0] or 0
    level, below, rounds = 0, stored.filter("size > 1"), []
    while True:
        rounds.append(materialise(climb(in_blocks(below), level)))
        level += DEPTH
        if height(largest) <= level:
            break
        below = rounds[-1].filter((F.col("level") == level) & (F.col("size") > FAN ** level)).select(
            "tree", "size", "digest", F.col("index").alias("first"), F.lit(1).alias("copies"))
    nodes = reduce(DataFrame.unionByName, rounds)
    # The one node of the topmost level: no level below the root has a single node.
    ends = nodes.filter((F.col("index") == 0) & (F.col("size") <= F.pow(F.lit(FAN), F.col("level"))))
    alone = stored.filter("size = 1")
    return stored, nodes.select("tree", "level", "index", "digest"), ends.select("tree", "size", F.col("digest").alias("root")).unionByName(
        alone.select("tree", "size", F.col("digest").alias("root")))


@dataclass
class Manifest:
    leaves: DataFrame
    """Rows by place: tree, lang, doc_id, digest, tampered, copies, first, size, and their tree's place, langs, subroot and root."""

    nodes: DataFrame
    """tree, level, index, digest of all inner nodes and of all nodes of the tree over languages."""


def manifest(docs: DataFrame) -> Manifest:
    rows, nodes, subroots = build(leaves(docs), ["doc_id", "digest", "tampered"])
    named = rows.groupBy("tree").agg(F.first("lang").alias("lang")).join(subroots, "tree")
    tops, top_nodes, roots = build(materialise(named.select(
        F.lit(TOP).alias("tree"), F.col("tree").alias("key"), "lang", F.col("root").alias("digest"), F.lit(1).cast("bigint").alias("copies"))), ["lang"])
    whole = tops.join(roots.select("tree", "root"), "tree").select(
        F.col("key").alias("tree"), F.col("first").alias("place"), F.col("size").alias("langs"), F.col("digest").alias("subroot"), "root")
    ends = tops.select("tree", F.lit(0).alias("level"), F.col("first").alias("index"), "digest")
    return Manifest(rows.join(broadcast_if_small(whole), "tree"), nodes.unionByName(top_nodes).unionByName(ends))


# --- proving -----------------------------------------------------------------
def coordinates(blocks: DataFrame) -> DataFrame:
    """tree, block, and (at, level, index) of every node that the block's leaves need from elsewhere."""
    def run(table: pa.Table) -> pa.Table:
        tree, block, size, place, langs = (table.column(c)[0].as_py() for c in ("tree", "block", "size", "place", "langs"))
        have = np.concatenate([np.arange(a, b) for a, b in zip(table.column("low").to_pylist(), table.column("high").to_pylist())])
        out = [(tree, block, tree, *c) for c in missing(have, size)] + [(tree, block, TOP, *c) for c in missing(np.array([place]), langs)]
        columns = zip(*out) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()))],
                                    ["tree", "block", "at", "level", "index"])

    return blocks.select("tree", "block", "low", "high", "size", "place", "langs").groupBy("tree", "block").applyInArrow(
        run, "tree string, block bigint, at string, level int, index bigint")


class _Path:
    """Nodes of one tree, as far as a block knows them: level by level, its leaves' ancestors and what was fetched."""

    def __init__(self, have: dict[int, str], size: int, fetched: dict[tuple[int, int], str]):
        self.size, self.levels, self.ends = size, [], {}
        for level in range(height(size)):
            known = have | {i: d for (at, i), d in fetched.items() if at == level}
            self.levels.append(known)
            have = {p: combine([known[i] for i in self.run(level, p)]) for p in {i // FAN for i in have}}
        (self.root,) = have.values()

    def run(self, level: int, parent: int) -> range:
        return range(parent * FAN, min(parent * FAN + FAN, width(self.size, level)))

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """What stands left and right of a leaf's ancestors in their runs, level by level."""
        out = []
        for level in range(len(self.levels)):
            key = (level, at)
            if key not in self.ends:
                known, run = self.levels[level], self.run(level, at // FAN)
                self.ends[key] = "".join(known[i] for i in run if i < at), "".join(known[i] for i in run if i > at)
            out.append(self.ends[key])
            at //= FAN
        return out


def fold(digest: str, siblings: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in siblings:
        digest = combine([left, digest, right])
    return digest


PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _expand(own: pa.Table, fetched: pa.Table) -> pa.Table:
    rows = own.to_pylist()
    if not rows:
        return pa.Table.from_pylist([], _PROOF_ARROW)
    tree, parts = rows[0]["tree"], {}
    for f in fetched.to_pylist():
        parts.setdefault(f["at"], {})[f["level"], f["index"]] = f["digest"].hex()
    have = {i: r["digest"].hex() for r in rows for i in range(r["low"], r["high"])}
    path = _Path(have, rows[0]["size"], parts.get(tree, {}))
    above = _Path({rows[0]["place"]: path.root}, rows[0]["langs"], parts.get(TOP, {}))
    shared = above.siblings(rows[0]["place"])
    subroot, root = rows[0]["subroot"].hex(), rows[0]["root"].hex()
    out = []
    for r in rows:
        for i in range(r["low"], r["high"]):
            siblings = path.siblings(i) + shared
            # An untampered leaf's fold is the root that the block's shared interiors gave.
            folded = above.root if r["tampered"] is None else fold(r["tampered"].hex(), siblings)
            out.append((r["doc_id"], have[i], subroot, root, combine([x for s in siblings for x in s]), folded, folded == root))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PROOF_ARROW)], schema=_PROOF_ARROW)


_PROOF_ARROW = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in PROOF.split(", "))])


def proofs(tree: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """One proof per leaf: of all leaves, or of ``wanted``, rows of ``tree.leaves``."""
    nodes = tree.nodes
    if wanted is not None:  # siblings may then be leaves that the block does not hold
        nodes = nodes.unionByName(tree.leaves.select("tree", F.lit(0).alias("level"), F.explode(F.sequence(
            F.col("first"), F.col("first") + F.col("copies") - 1)).alias("index"), "digest"))
    blocks = in_blocks(tree.leaves if wanted is None else wanted)
    fetched = coordinates(blocks).join(nodes.withColumnRenamed("tree", "at"), ["at", "level", "index"])
    own = blocks.select("tree", "block", "doc_id", "digest", "tampered", "low", "high", "size", "place", "langs", "subroot", "root")
    return own.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(_expand, PROOF)


def verify(docs: DataFrame) -> DataFrame:
    """The proof of every row of ``docs``, folded from its tampered leaf where it is tampered with."""
    return proofs(manifest(docs))

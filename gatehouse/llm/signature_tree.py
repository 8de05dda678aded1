"""Exact n-gram Jaccard self-join with a forest of signature trees.

A document is the set of its distinct word shingles.  Equal sets are one class.  The
forest has a tree for every cluster of classes that could link at all: the shingles
of a set are dealt into more buckets than two linked sets can differ in, so linked
sets have a bucket in common that is equal and not empty; classes that share such a
bucket, directly or by others, are a cluster.  Low similarities take the first
shingles in hash order instead, of which linked sets have a certain number in common;
sets that share fewer with all others together are left out first.  A tree's leaves hold classes, its
nodes the OR of their bitmaps, their size range and the most shingles that a bitmap
hides.  Dual traversal compares node with node, starting at the root, and drops a
pair when sizes or the largest overlap that the bitmaps allow rule out every link, or
when links found already connect all below it.  Pairs of classes that are left are
counted exactly.

A cluster too large for one task is cut into blocks that all hold one pivot.  Classes
of a block that no chain of links joins to the pivot are compared with every other
block as well.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.session import broadcast_if_small, materialise

from .common import arrow_map, hand_back, own_names
from .components import components

CACHED = 300_000
BAND = 1.5
"""Ratio of the size bands that share a number of buckets."""

SPARE = 2
"""Buckets beyond the least number, so that a set with this many empty ones still has an equal bucket that is not empty."""

BLOCK_SHINGLES = 1_000_000
"""Shingles (8 bytes each) of a block that one task compares."""

BUCKETS_FROM = 85
"""Least similarity in percent with buckets; below it they hold too few shingles to tell documents apart, and prefixes are used."""

PREFIX_SHARE = 10
"""Percent of a set by which its prefix is longer than one common shingle needs."""

LEAF = 16
FANOUT = 8
PARTS = 1 << 24
"""Block numbers of a size band."""

_WORDS: dict[bytes, int] = {}
"""Hashes of words of the running task."""


def _forget() -> None:
    _WORDS.clear()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes.  Words are cut at white space, A-Z lower-cased."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > CACHED:
        _WORDS.clear()
    for w in set(words):
        if w not in _WORDS:
            _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + ids[i:len(ids) - width + 1 + i])
    return np.unique(h)


def band_bounds(up_to: int) -> list[int]:
    bounds = [1]
    while bounds[-1] <= up_to:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * BAND)))
    return bounds


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Bucket signatures of a set: linked, different sets have one in common.

    A link of sets of a <= b shingles leaves at most a * (100 - percent) / percent of
    them unshared, where b is at most a * 100 / percent.
    """
    size = len(shingles)
    bounds = band_bounds(size)
    own = len(bounds) - 2
    out = []
    for band in (own - 1, own):
        top = bounds[band + 1] - 1 if band >= 0 else 0
        differ = top * (100 - percent) // percent
        if band < 0 or not differ or (band < own and -(-size * percent // 100) > top):
            continue
        k = differ + 1 + SPARE
        bucket = (_mix(shingles + np.uint64(band)) % np.uint64(k)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sums = np.add.reduceat(_mix(shingles[order] + np.uint64(0x51ED270B)), starts)
        used = bucket[starts]
        if k - len(used) > SPARE:  # too many empty buckets to leave them out
            empty = np.setdiff1d(np.arange(k), used)
            used, sums = np.r_[used, empty], np.r_[sums, np.zeros(len(empty), np.uint64)]
        out.append(_mix(_mix(sums + used.astype(np.uint64)) + np.uint64(band)) >> np.uint64(16))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def prefix(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in hash order: linked sets have at least ``in_common`` of them in common."""
    size = len(shingles)
    length = size - -(-size * percent // 100) + max(1, size * PREFIX_SHARE // 100)
    return np.sort(_mix(shingles))[:length] >> np.uint64(16)


def in_common(size: Column, percent: int) -> Column:
    """Prefix shingles that a set shares with the prefix of every set it is linked with; that one has ``percent`` of its size or more."""
    return F.greatest(F.lit(1), F.floor(F.ceil(size * percent / 100) * PREFIX_SHARE / 100))


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64).tolist())


def features(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, v (digest of the set, null for an empty one), check (more of it), signatures."""
    sign = signatures if percent >= BUCKETS_FROM else prefix

    def run(batch):
        sets = [shingle_set(t or "", n) for t in batch.column(1).to_pylist()]
        digests = [_digest(s) if len(s) else (None, None) for s in sets]
        return {"doc_id": batch.column(0), "n_shingles": [len(s) for s in sets], "v": [d[0] for d in digests], "check": [d[1] for d in digests],
                "signatures": [sign(s, percent).astype(np.int64) if len(s) else [] for s in sets]}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, n_shingles bigint, v bigint, check bigint, signatures array<bigint>", _forget)


class Tree:
    """A signature tree over sets in the order given."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = max(512, 1 << int(2 * sizes.max() - 1).bit_length())
        self.bits = min(bits, 1 << 16)
        packed = np.zeros((len(sets), self.bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = s % np.uint64(self.bits)
            np.bitwise_or.at(packed[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        hidden = sizes - np.bitwise_count(packed).sum(1, dtype=np.int64)
        self.levels = [(packed, sizes, sizes, hidden)]
        self.spans = [[(i, i + 1) for i in range(len(sets))]]
        width = LEAF
        while len(self.spans[-1]) > 1:
            maps, low, high, hidden = self.levels[-1]
            starts = np.arange(0, len(low), width)
            self.levels.append((np.bitwise_or.reduceat(maps, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(hidden, starts)))
            below = self.spans[-1]
            self.spans.append([(below[a][0], below[min(a + width, len(below)) - 1][1]) for a in starts])
            width = FANOUT

    def width(self, level: int) -> int:
        return LEAF if level == 1 else FANOUT

    def possible(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """For nodes x by y, whether sizes and bitmaps leave room for a link below them."""
        maps, low, high, hidden = self.levels[level]
        fits = (100 * high[x][:, None] >= percent * low[y][None]) & (100 * high[y][None] >= percent * low[x][:, None])
        most = np.bitwise_count(maps[x][:, None, :] & maps[y][None]).sum(2, dtype=np.int64) + np.minimum(hidden[x][:, None], hidden[y][None])
        most = np.minimum(most, np.minimum(high[x][:, None], high[y][None]))
        return fits & ((100 + percent) * most >= percent * (low[x][:, None] + low[y][None]))


def linked_groups(sets: list[np.ndarray], percent: int, start: np.ndarray | None = None) -> np.ndarray:
    """Group number of each set under links and ``start``, by dual traversal of one tree."""
    n = len(sets)
    group = np.arange(n) if start is None else np.unique(start, return_inverse=True)[1]
    order = np.array(sorted(range(n), key=lambda i: (int(sets[i][0]), len(sets[i]), i)), np.int64)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    tree, group = Tree([sets[i] for i in order]), group[order]
    sets = [sets[i] for i in order]

    def link(i: int, j: int) -> None:
        a, b = sets[i], sets[j]
        if group[i] == group[j] or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return
        shared = int((b[np.minimum(b.searchsorted(a), len(b) - 1)] == a).sum())
        if 100 * shared >= percent * (len(a) + len(b) - shared):
            group[group == group[j]] = group[i]

    top = len(tree.levels) - 1
    todo = [(top, 0, 0)]
    while todo:
        level, x, y = todo.pop()
        (a, b), (c, d) = tree.spans[level][x], tree.spans[level][y]
        if group[a] == group[c] and (group[a:b] == group[a]).all() and (group[c:d] == group[a]).all():
            continue
        w, size = tree.width(level), len(tree.spans[level - 1])
        xs, ys = np.arange(x * w, min((x + 1) * w, size)), np.arange(y * w, min((y + 1) * w, size))
        maybe = tree.possible(level - 1, xs, ys, percent) & (xs[:, None] <= ys)
        if level == 1:
            maybe &= group[xs][:, None] != group[ys]
        pairs = [(xs[i], ys[j]) for i, j in zip(*np.nonzero(maybe))]
        if level == 1:
            for i, j in pairs:
                link(i, j)
            continue
        # The nearest pairs come off the stack first: what they join need not be compared again.
        todo += ((level - 1, i, j) for i, j in sorted(pairs, key=lambda p: p[0] - p[1]))
    return group[inverse]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Consecutive rows with equal first columns, as (key, columns); of rows equal in the next column too, the first."""
    key, columns = None, []
    for batch in batches:
        rows = [c.to_pylist() for c in batch.columns]
        for row in zip(*rows):
            if row[:keys] != key:
                if key is not None:
                    yield key, columns
                key, columns = row[:keys], [[] for _ in row[keys:]]
            elif columns[0][-1] == row[keys]:
                continue
            for c, value in zip(columns, row[keys:]):
                c.append(value)
    if key is not None:
        yield key, columns


def _joined_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links inside each (cluster, block, part): v, its former label and its new one.

    Rows: cluster, block, part, v, label, shingles.  A label is the smallest v of the group.
    """
    def run(batches):
        for _, (v, label, shingles) in _grouped(batches, 3):
            labels = np.array(label, np.int64)
            group = linked_groups([np.frombuffer(s, np.uint64) for s in shingles], percent, labels)
            least = np.full(len(v), np.iinfo(np.int64).max)
            np.minimum.at(least, group, labels)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(label, pa.int64()), pa.array(least[group], pa.int64())], names=["v", "label", "joined"])
        hand_back()

    placed = rows.repartition("cluster", "block", "part").sortWithinPartitions("cluster", "block", "part", "v")
    return placed.select("cluster", "block", "part", "v", "label", "shingles").mapInArrow(run, "v bigint, label bigint, joined bigint")


def _sets(docs: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """The shingles of placed classes, made again from the texts of their smallest ids; a class has one row a task at most."""
    seen = set()  # of the task, which unpickles its own

    def run(batch):
        sets, same = [], []
        for t, v in zip(batch.column(4).to_pylist(), batch.column(0).to_pylist()):
            s = shingle_set("" if v in seen else t or "", n)
            same.append(len(s) > 0 and _digest(s)[0] == v)  # an id may have other texts too
            sets.append(s if same[-1] else s[:0])
            if same[-1]:
                seen.add(v)
        same = pa.array(same, pa.bool_())
        columns = [batch.column(i).filter(same) for i in range(4)] + [pa.array([s.tobytes() for s in sets], pa.binary()).filter(same)]
        return dict(zip(("v", "cluster", "band", "block", "shingles"), columns))

    wanted = broadcast_if_small(placed.select("v", "cluster", "band", "block", "least_id"))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("least_id"))).select("v", "cluster", "band", "block", "text")
    return arrow_map(texts, run, "v bigint, cluster bigint, band bigint, block bigint, shingles binary", _forget)


def _open_clusters(docs: DataFrame, placed: DataFrame, n: int, percent: int, block_shingles: int) -> DataFrame:
    """(v, root) of clusters in several blocks.  The pivot is the class that names the cluster.

    Blocks hold sets of one size band, a band being a little wider than a link's size ratio, so
    that sets meet only in neighbouring bands.
    """
    sets = materialise(_sets(docs, placed, n))
    slots = materialise(placed.select("cluster", "band", "block").distinct())
    columns = ["cluster", "block", "part", "v", "label", "shingles"]
    pivots = sets.filter("v = cluster").drop("band", "block").join(slots, "cluster")
    first = sets.filter("v <> cluster").unionByName(pivots).withColumn("part", F.lit(0).cast("bigint")).withColumn("label", F.col("v"))
    inside = materialise(_joined_blocks(first.select(*columns), percent).select("v", "joined").distinct())
    edges = inside.select(F.col("v").alias("a"), F.col("joined").alias("b"))
    known = placed.select("v", "cluster", "band", "size").join(inside.groupBy("v").agg(F.min("joined").alias("label")), "v")
    loose = materialise(known.filter("label <> cluster"))
    if not loose.isEmpty():
        split = loose.groupBy("cluster", "band").agg(F.ceil(F.sum("size") / block_shingles).alias("split"))
        parted = loose.join(split, ["cluster", "band"]).select("v", "label", F.col("band").alias("b"), (F.col("band") * PARTS + F.pmod(F.xxhash64("v"), F.col("split"))).alias("part"))
        near = F.abs(F.col("band") - F.col("b")) <= 1
        parts = parted.join(placed.select("v", "cluster"), "v").select("cluster", "b", "part").distinct()
        fixed = sets.join(known.select("v", "label").distinct(), "v").join(parts.withColumnRenamed("cluster", "c"), (F.col("cluster") == F.col("c")) & near)
        moved = sets.drop("band", "block").join(parted, "v").join(slots.withColumnRenamed("cluster", "c"), (F.col("cluster") == F.col("c")) & near)
        across = _joined_blocks(fixed.select(*columns).unionByName(moved.select(*columns)), percent)
        edges = edges.unionByName(across.select(F.col("label").alias("a"), F.col("joined").alias("b")))
    found = components(edges)
    return placed.select("v").join(found, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def _shared(dealt: DataFrame) -> DataFrame:
    """Rows (v, signature) of signatures that two sets or more have, with ``center``, the smallest of them.

    Signatures are dealt out once more before the join, so that a hot one's rows can be split.
    """
    shared = dealt.groupBy("signature").agg(F.min("v").alias("center"), F.max("v").alias("other")).filter("center < other").select("signature", "center")
    return dealt.join(shared.repartition("center"), "signature")


def _starred(dealt: DataFrame) -> DataFrame:
    """Edges from every set to the smallest set of each of its signatures."""
    return _shared(dealt).filter("v <> center").select(F.col("v").alias("a"), F.col("center").alias("b")).distinct()


def _worth_comparing(dealt: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Shared rows of sets that share enough of their prefix, with whatever sets, to be linked at all."""
    rows = dealt
    for _ in range(2):  # the second time among those the first has left
        # Only counts, not names, go with the signatures; they are dealt out once more so that a hot one's rows can be split.
        shared = rows.groupBy("signature").agg(F.count("*").alias("n")).filter("n > 1").select("signature").repartition(F.xxhash64("signature"))
        rows = materialise(rows.join(shared, "signature").select("v", "signature"))
        enough = rows.groupBy("v").agg(F.count("*").alias("n")).join(sizes, "v").filter(F.col("n") >= in_common(F.col("size"), percent)).select("v")
        rows = rows.join(enough, "v", "left_semi")
    return materialise(rows)


def link_components(docs: DataFrame, n: int = 3, percent: int = 90, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of every row of ``docs``.

    A null or wordless text has 0 shingles and its own id as component, as has a text
    nothing links with.  Repeated rows and copies are one class and share a component.
    A null doc_id counts as the smallest of no component with another id.
    """
    feats, roots = _linked(docs, n, percent, block_shingles)
    own = feats.filter(F.col("v").isNotNull()).groupBy("v").agg(F.min("doc_id").alias("least_id"))
    least = roots.join(own, "v").groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = own.join(roots, "v", "left").join(least, "root", "left").select("v", F.coalesce("component_id", "least_id").alias("component_id"))
    return (feats.select("doc_id", "n_shingles", "v").join(found, "v", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


@own_names
def keep_one_of_each(docs: DataFrame, n: int, percent: int, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs`` with one row of each component, and all rows without words.

    The row kept is one of the smallest doc_id, which null follows, and of its smallest
    digest; of rows equal in both the smallest one.  Ids alone decide where all rows of
    an id go or all stay; only rows of other ids, null among them, are digested again.
    Other columns may have any names.
    """
    feats, roots = _linked(docs, n, percent, block_shingles)
    own = feats.filter(F.col("v").isNotNull()).groupBy("v").agg(F.min("doc_id").alias("least_id"))
    reached = own.join(roots, "v", "left").select("v", "least_id", F.coalesce("root", "v").alias("root"))
    first = F.min(F.struct(F.col("least_id").isNull(), F.col("least_id").alias("id"), F.col("v").alias("v"))).alias("w")
    chosen = materialise(reached.groupBy("root").agg(first).select(F.col("w.v").alias("__v"), F.col("w.id").alias("__least"), F.lit(True).alias("__chosen")))
    rows = feats.select("doc_id", F.col("v").alias("__v")).join(chosen, "__v", "left")
    won = F.coalesce(F.col("__chosen") & F.col("doc_id").eqNullSafe(F.col("__least")), F.lit(False))
    ids = rows.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n"), F.count_if(won).alias("won"), F.count_if(F.col("__v").isNull()).alias("blank"))
    ids = materialise(ids.filter("won > 1 OR won + blank < n").select("__id", (F.col("won") + F.col("blank") > 0).alias("mixed")))
    same_id = docs["doc_id"].eqNullSafe(ids["__id"])
    whole = docs.join(ids, same_id, "left_anti")
    if ids.filter("mixed").isEmpty():
        return whole

    @F.arrow_udf("bigint")
    def digest(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(t or "", n) for t in texts.to_pylist())
        return pa.array([_digest(s)[0] if len(s) else None for s in sets], pa.int64())

    some = materialise(docs.join(ids.filter("mixed"), same_id, "left_semi").withColumn("__v", digest("text")))
    hit = (some["__v"] == chosen["__v"]) & some["doc_id"].eqNullSafe(chosen["__least"])
    one = some.join(chosen, hit, "left_semi").groupBy("__v").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return whole.unionByName(one).unionByName(some.filter("__v IS NULL").select(*docs.columns))


def _linked(docs: DataFrame, n: int, percent: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Features of all rows, and (v, root) of the classes that could link at all."""
    feats = materialise(features(docs, n, percent))
    classes = (feats.filter(F.col("v").isNotNull()).groupBy("v")
               .agg(F.min("doc_id").alias("least_id"), F.min("check").alias("c1"), F.max("check").alias("c2"), F.first("n_shingles").alias("size"), F.first("signatures").alias("signatures")))
    dealt = classes.select("v", F.explode("signatures").alias("signature"))
    clusters = components(_starred(dealt if percent >= BUCKETS_FROM else _worth_comparing(dealt, classes.select("v", "size"), percent)))

    ids = classes.select("v", "least_id", "size", (F.col("c1") != F.col("c2")).alias("clash"))
    members = materialise(clusters.join(ids, "v").select("v", F.col("root").alias("cluster"), "least_id", "size", "clash"))
    if not members.filter("clash").isEmpty():
        raise ValueError("two different sets share a 64-bit digest; change the mixing constants")
    total = members.groupBy("cluster").agg(F.sum("size").alias("total"))
    banded = members.join(total, "cluster").withColumn("band", F.floor(F.log("size") / (1.001 * math.log(100 / percent))))
    in_band = banded.groupBy("cluster", "band").agg(F.ceil(F.sum("size") / block_shingles).alias("split"))
    block = F.col("band") * PARTS + F.pmod(F.xxhash64("v"), F.col("split"))
    placed = materialise(banded.join(in_band, ["cluster", "band"]).withColumn("open", F.col("total") > block_shingles)
                         .select("v", "cluster", "least_id", "size", "open", "band", F.when(F.col("open"), block).otherwise(0).alias("block")))
    closed = _joined_blocks(_sets(docs, placed.filter("NOT open"), n).withColumn("part", F.lit(0).cast("bigint")).withColumn("label", F.col("v")), percent)
    roots = closed.select("v", F.col("joined").alias("root"))
    if not placed.filter("open").isEmpty():
        roots = roots.unionByName(_open_clusters(docs, placed.filter("open"), n, percent, block_shingles))
    return feats, materialise(roots.distinct())

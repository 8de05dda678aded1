"""Near copies: groups of texts that share most of their word runs, and splits that keep groups whole.

A text is the set of its distinct runs of ``RUN`` words.  Sketches put texts with much in
common together: a set's hashes are dealt into ``BANDS * ROWS`` cells, each cell keeps its
smallest hash (an empty one that of the next), and the cells of a band are one signature.
Texts that share a signature are in one group, directly or by others.  Two sets with eight
tenths in common miss each other in all bands once in about ten million times; sets with
little in common meet rarely, and a group that is too large does a split no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.core import bind
from ..functions.text import norm_words
from ..session import broadcast_if_small, materialise

RUN = 5
BANDS = 40
ROWS = 5


def digest_of(text: Column) -> Column:
    """The digest that :func:`~gatehouse.operators.decontam.hash_split` goes by."""
    return F.md5(F.encode(text, "UTF-8"))


def word_runs(text: Column, n: int = RUN) -> Column:
    """64-bit hashes of the distinct runs of ``n`` words; a shorter text has one, of all its words, and one without words none.

    Words are split once, and a run is hashed where its words stand, without an array of its own.
    """
    def hashes(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
        return F.when(F.size(words) >= n, F.array_distinct(runs)).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    return bind(norm_words(text), hashes)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists of numbers."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0]:offsets[-1]], offsets - offsets[0]


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


SKETCHED = 4096
"""Sets whose cells are filled at once."""


def _signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ``BANDS`` signatures of every set, a row each; no set is empty."""
    cells, n, none = BANDS * ROWS, len(offsets) - 1, np.iinfo(np.uint64).max
    values = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(32)
    least = np.full(n * cells, none, np.uint64)
    np.minimum.at(least, np.repeat(np.arange(n) * cells, np.diff(offsets)) + (values % np.uint64(cells)).astype(np.int64), values)
    least = least.reshape(n, cells)
    # An empty cell takes the value of the next filled one, round the end.
    twice = np.where(np.tile(least, 2) != none, np.arange(2 * cells), 2 * cells)
    nearest = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :cells] % cells
    rows = np.take_along_axis(least, nearest, axis=1).reshape(n, BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
    for i in range(ROWS):
        out = (out ^ rows[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, signatures) of batches of (digest, runs)."""
    for batch in batches:
        for start in range(0, batch.num_rows, SKETCHED):
            part = batch.slice(start, SKETCHED)
            hashes, offsets = _flat(part.column(1))
            filled = np.diff(offsets) > 0
            found = _signatures(hashes, np.append(offsets[:-1][filled], offsets[-1]))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(filled)), _lists(np.arange(len(found) + 1) * BANDS, found.ravel())], ["digest", "signatures"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the (a, b) edges with the smallest node it is connected with.

    Alternates between handing the smallest neighbour to all larger ones and to all smaller
    ones, which connects a group of any shape in few rounds.  A hub is met by a minimum with
    map-side combine and by a join that Spark can split.
    """
    links = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialise(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_groups(rows: DataFrame, text: str = "text") -> DataFrame:
    """(digest, root): the digest of each text that has near copies, and the smallest digest of its group.

    Equal texts are one digest.  Texts without words are in no group.  Sketches travel, neither
    texts nor their runs do.
    """
    runs = rows.where(F.col(text).isNotNull()).select(digest_of(F.col(text)).alias("digest"), word_runs(F.col(text)).alias("runs"))
    sketches = runs.mapInArrow(_sketch, "digest string, signatures array<bigint>").groupBy("digest").agg(F.first("signatures").alias("signatures"))
    # The leading digits keep the order of digests; texts that have all of them in common are one group.
    texts = materialise(sketches.withColumn("key", F.conv(F.substr("digest", F.lit(1), F.lit(15)), 16, 10).cast("bigint")))
    dealt = texts.select("key", F.explode(F.array_distinct("signatures")).alias("signature"))
    centers = dealt.groupBy("signature").agg(F.min("key").alias("center"), F.max("key").alias("other")).where("center <> other").select("signature", "center")
    groups = components(dealt.join(broadcast_if_small(centers), "signature").select(F.col("key").alias("a"), F.col("center").alias("b")))
    named = materialise(texts.select("digest", F.col("key").alias("node")).join(broadcast_if_small(groups), "node"))
    firsts = named.where("node = root").groupBy("root").agg(F.min("digest").alias("first"))
    return named.join(broadcast_if_small(firsts), "root").select("digest", F.col("first").alias("root"))


LARGE = 10_000
"""A group with more than one of so many rows is large; there are fewer of these."""


def _slack(n: int, share: float) -> float:
    """How far the share of rows held out may be from ``share`` by chance, and half a hundredth."""
    return 0.005 + 2 * (share * (1 - share) / n) ** 0.5


def _drawn(root: Column, part: float) -> Column:
    """A draw by digest that does not depend on :func:`digest_modulus`: ``part`` of all digests."""
    return F.pmod(F.xxhash64(root), F.lit(1_000_000)) < round(1_000_000 * part)


def cluster_split(rows: DataFrame, text: str = "text", modulus: int = 7) -> DataFrame:
    """Add ``split`` like :func:`~gatehouse.operators.decontam.hash_split`, by group of near copies.

    The smallest digest of a group decides for all of it; a text without near copies gets the
    split of its own digest, as does a missing one.  Where that does not hold out one in
    ``modulus`` rows, because a few groups are large, these are dealt by size, largest first:
    a group is held out if it still fits.  If the smaller groups alone hold out too few or too
    many rows to make up for it, as many of them change sides as are needed, drawn by digest.
    """
    share, n_rows, groups = 1 / modulus, F.count(F.lit(1)), broadcast_if_small(near_groups(rows, text).select(F.col("digest").alias("__digest"), F.col("root").alias("__near")))
    marked = rows.withColumn("__digest", digest_of(F.col(text))).join(groups, "__digest", "left").withColumn("__root", F.coalesce("__near", "__digest"))
    held = F.coalesce(H.digest_modulus(F.col("__root"), modulus) == 0, F.lit(False))
    sizes = materialise(marked.groupBy("__root").agg(n_rows.alias("n")).withColumn("held", held))
    total = sizes.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held"), F.col("n"))).alias("held")).first()
    if total.n and abs((total.held or 0) / total.n - share) > _slack(total.n, share):
        large = (F.col("n") > 1) & (F.col("n") * LARGE > total.n) & F.col("__root").isNotNull()
        small = sizes.where(~large).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held"), F.col("n"))).alias("held")).first()
        taken, dealt = small.held or 0, {}
        for r in sizes.where(large).orderBy(F.desc("n"), "__root").select("__root", "n").collect():  # fewer than LARGE rows
            dealt[r["__root"]] = taken + r.n <= total.n * share
            taken += r.n * dealt[r["__root"]]
        short = total.n * share - taken
        if abs(short) > _slack(total.n, share) * total.n:
            own = small.held or 0
            drawn = _drawn(F.col("__root"), min(1.0, abs(short) / max(1, small.n - own if short > 0 else own)))
            held = F.coalesce((held | drawn) if short > 0 else (held & ~drawn), F.lit(False))
        if dealt:
            sides = F.broadcast(rows.sparkSession.createDataFrame(list(dealt.items()), "__root STRING, __dealt BOOLEAN"))
            marked, held = marked.join(sides, "__root", "left"), F.coalesce("__dealt", held)
    return marked.withColumn("split", F.when(held, "heldout").otherwise("train")).select(*rows.columns, "split")


FREQUENT = 256
"""Texts with a run among their first beyond which it is put behind the rarer runs of each."""

FREQUENT_RUNS = 10_000
"""Most runs that are put behind the others in one round."""

ROUNDS = 6
"""Most rounds: where frequent runs make way, others come up."""

SPARE = 64
"""Runs stored beyond the first of each set, to take the place of frequent ones."""


def _one_of_equal(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(split, id, text): each distinct text of a side, with its smallest id.  Texts stay where they are while the ids are few."""
    keyed = rows.where(F.col(text).isNotNull()).select("split", digest_of(F.col(text)).alias("digest"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    firsts = broadcast_if_small(keyed.groupBy("split", "digest").agg(F.min("id").alias("id")).where("id IS NOT NULL"))
    found = keyed.join(firsts, ["split", "digest", "id"])
    # A row that is there twice, id and all.
    return found if found.count() == firsts.count() else found.dropDuplicates(["split", "digest", "id"])


def _heads(fronts: DataFrame) -> DataFrame:
    return fronts.select("split", "id", "n", F.posexplode("front").alias("pos", "run"))


def _behind(common: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts the runs of ``common`` behind the others of each set, in the order that ``common`` has, and keeps ``first`` of each.

    Batches hold (split, id, n, first, runs) and, in the result, ``known``: do the runs given
    settle which are first?
    """
    order = np.argsort(common)
    ascending = common[order]

    def ordered(batches):
        for batch in batches:
            runs, offsets = _flat(batch.column("runs"))
            n, first = (batch.column(c).to_numpy() for c in ("n", "first"))
            sizes = np.diff(offsets)
            at = np.searchsorted(ascending, runs)
            at[at == len(ascending)] = 0
            late = ascending[at] == runs
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rare = sizes - np.bincount(owner[late], minlength=len(sizes))
            # Only sets with a late run among them are dealt anew.
            moved = np.flatnonzero((rare < sizes)[owner])
            place = np.where(late[moved], 1 + order[at[moved]], 0)
            runs = runs.copy()
            runs[moved] = runs[moved][np.lexsort((place, owner[moved]))]
            head = np.arange(len(runs)) - np.repeat(offsets[:-1], sizes) < np.repeat(first, sizes)
            ends = np.concatenate([[0], np.cumsum(np.minimum(sizes, first))])
            known = pa.array((sizes == n) | (rare >= first))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("split", "id", "n")), _lists(ends, runs[head]), known], ["split", "id", "n", "front", "known"])

    return ordered


def _sets(texts: DataFrame, percent: int) -> DataFrame:
    """(split, id, runs, n, first): the runs of each text that has any, their number and how many of them come first."""
    n_first = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    # A generator is not inlined, so that the filter does not make the runs again.
    runs = F.explode(F.array(F.sort_array(word_runs(F.col("text"))))).alias("runs")
    return texts.select("split", "id", runs).withColumn("n", F.size("runs")).where("n > 0").withColumn("first", n_first)


def _rarest_first(texts: DataFrame, percent: int) -> DataFrame:
    return _fronts(texts, percent)[0]


def _fronts(texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(split, id, n, front): the first runs of each set, of which alike sets share one, and (run) those that both sides have.

    All sets keep one order: by hash, but runs that many texts share behind all others, the
    most frequent last.  Such runs are looked for where they would be joined on, among the
    first in hash order; a set with none of them there keeps its first.  Which runs these are
    changes the work, not the result.  They are a bounded array that every task searches in,
    so that a set costs the same however many there are.
    """
    plain = materialise(_sets(texts, percent).select("split", "id", "n", "first", F.slice("runs", F.lit(1), F.col("first") + SPARE).alias("runs")))
    fronts = plain.select("split", "id", "n", F.slice("runs", F.lit(1), F.col("first")).alias("front"))
    schema = fronts.withColumn("known", F.lit(True)).schema
    found, heads = {}, plain.agg(F.sum(F.least("n", "first"))).first()[0] or 0
    for turn in range(ROUNDS + 1):
        held = F.col("split") == "heldout"
        counts = _heads(fronts).groupBy("run").agg(F.count(F.lit(1)).alias("texts"), F.bool_or(held).alias("x"), F.bool_or(~held).alias("y"))
        both = materialise(counts.where("x AND y").select("texts", "run"))
        if turn == ROUNDS:
            break
        # Where a set has nothing else, a frequent run is among its first again.
        heavy = both.where(F.col("texts") > FREQUENT).orderBy(F.desc("texts"), "run").limit(FREQUENT_RUNS + len(found)).collect()
        new = [r for r in heavy if r.run not in found][:FREQUENT_RUNS]
        # A round reads every head; a few frequent runs make fewer pairs than that.
        if sum(r.texts ** 2 for r in new) <= heads:
            break
        found |= {r.run: r.texts for r in new}
        ordered = _behind(np.array(sorted(found, key=lambda run: (found[run], run)), np.int64))
        # What is stored will do where the whole set is, or enough rare runs are.
        tried = plain.mapInArrow(ordered, schema)
        lacking = broadcast_if_small(tried.where("NOT known").select("split", "id"))
        again = _sets(texts.join(lacking, ["split", "id"], "left_semi"), percent).select(plain.columns).mapInArrow(ordered, schema)
        fronts = tried.where("known").unionByName(again).drop("known")
    return fronts, both.select("run")


def split_leaks(rows: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(heldout, train, shared, total): pairs across a ``split`` whose runs are at least ``percent`` alike, exactly.

    Alike sets share a run among the first of each, rare runs before those of many texts, so
    only such pairs are counted, and of these only those that share enough of the first, with
    what the others can give; only the two sides meet, not a side with itself.  Runs are stored for the first of each
    set only; those of the few texts in pairs are made again.  Of equal texts of a side one
    stands for all, with its smallest id.
    """
    texts = _one_of_equal(rows, id_col, text)
    fronts, both = _fronts(texts, percent)
    heads = materialise(_heads(fronts).join(broadcast_if_small(both), "run", "left_semi"))
    alike = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    met = heads.where("split = 'heldout'").alias("a").join(heads.where("split <> 'heldout'").alias("b"), (F.col("a.run") == F.col("b.run")) & alike).groupBy(
        F.col("a.id").alias("heldout"), F.col("b.id").alias("train"), F.col("a.n").alias("x"), F.col("b.n").alias("y")).agg(
        F.count(F.lit(1)).alias("met"), F.min(F.col("a.pos")).alias("i"), F.min(F.col("b.pos")).alias("j"))
    # Of what two sets share, all that either has up to where the first runs of one end is met; the rest is among the others of that one.
    # And from the first run that they share on, neither has more than is left of it.
    most = F.least(F.col("met") + F.ceil(F.greatest("x", "y") * percent / 100) - 1, F.col("x") - F.col("i"), F.col("y") - F.col("j"))
    pairs = materialise(met.where(most * (100 + percent) >= (F.col("x") + F.col("y")) * percent).select("heldout", "train").distinct())
    held, train = (texts.where(c).withColumnRenamed("id", n).join(broadcast_if_small(pairs.select(n).distinct()), n, "left_semi").select(
        n, word_runs(F.col("text")).alias(f"{n}_runs")) for c, n in (("split = 'heldout'", "heldout"), ("split <> 'heldout'", "train")))
    shared = F.size(F.array_intersect("heldout_runs", "train_runs")).cast("bigint")
    met = pairs.join(held, "heldout").join(train, "train").select("heldout", "train", shared.alias("shared"), (
        F.size("heldout_runs") + F.size("train_runs")).cast("bigint").alias("sum"))
    return met.select("heldout", "train", "shared", (F.col("sum") - F.col("shared")).alias("total")).where(F.col("shared") * 100 >= F.col("total") * percent)

"""Source divergence audit: how each source of a language uses its words, against the others and the whole.

One ``CountVectorizer`` fits every language at once: a term carries its language, so the
least number of documents counts within the language and the vocabulary, whose size is not
limited, is that of all languages side by side.  It is fitted on each document's distinct terms and
gives exact sparse vectors of what a task reads of each group.  Their sums by (language, source), as a
summarizer would make them but without its dense buffers, are the cells of a sparse matrix.  Sources are compared in tiles over blocks of terms: a task
holds ``TILE`` sources twice and about ``BLOCK`` terms, and visits only terms that one of the
two sources has; terms that both lack are counted and added as a product.

Counts are integers, shares are fixed-point integers from decimal arithmetic, so every value is
exact at any size.  The vectorizer keeps its vocabulary (terms in ten documents or more) in the
driver and sends it to the executors: that much grows, slowly, with the corpus.

Rows: null text, lang and source count as empty text; repeated rows count each time; a group
without terms still appears, with the share of an absent term; an empty table has no rows.
Only ``text``, ``lang`` and ``source`` are read; other columns have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.session import broadcast_if_small, materialise, scratch

from .common import BATCH_ROWS, arrow_map, hand_back

FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
"""Bytes of UTF-8 text as terms have them: A-Z lower-cased, other letters and bytes beyond ASCII as they are, the rest blanks."""

MARK, NEXT = b"\0", b"\1"
"""Between a term's language and its letters, and before each term.  The mark alone is the term that keeps the vocabulary from being empty."""

LARGEST = 2**31 - 1
SCALE = 1_000_000_000
"""Shares are parts of this whole."""

SMALL = 9_000_000_000
"""Counts below this times ``SCALE`` are whole numbers of 64 bits."""

TILE = 64
BLOCK = 512

HELD = 8_000_000
"""Bytes of terms that a task gathers by group before it hands them on."""


def tag(lang: str) -> bytes:
    """What stands before each term of a language; any two languages differ in it, and neither ``MARK`` nor ``NEXT`` lies within."""
    return lang.translate({0: "\2a", 1: "\2b", 2: "\2c"}).encode() + MARK


def _words(batch: pa.RecordBatch, at: str) -> Iterator[tuple[int | str, bytes, list[bytes]]]:
    """The column ``at``, tag and terms of each text that has terms."""
    tags: dict[str, bytes] = {}
    for key, lang, text in zip(*(batch.column(c).to_pylist() for c in (at, "lang")), batch.column("text").cast(pa.binary()).to_pylist()):
        words = text.translate(FOLD).split()
        if words:
            yield key, tags.setdefault(lang, tag(lang)), words


def _listed(joined: list[bytes]) -> pa.Array:
    return pc.split_pattern(pa.array(joined, pa.string()), NEXT.decode()).cast(pa.list_(pa.field("element", pa.string())))


def document_terms(rows: DataFrame) -> DataFrame:
    """terms: the distinct terms of every text that has any, each with its language in front."""
    def run(batch):
        return {"terms": _listed([mark + (NEXT + mark).join(set(words)) for _, mark, words in _words(batch, "lang")])}

    return arrow_map(rows.select("lang", "text"), run, "terms array<string>")


def group_terms(rows: DataFrame) -> DataFrame:
    """group, terms: every term of every text, with its language in front; texts of one group that a task reads share rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        size = 0

        def hand_on():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), _listed([NEXT.join(parts) for parts in held.values()])], ["group", "terms"])
            held.clear()
            return out

        try:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    for group, mark, words in _words(batch.slice(at, BATCH_ROWS), "group"):
                        held.setdefault(group, []).append(mark + (NEXT + mark).join(words))
                        size += len(held[group][-1])
                        if size > HELD:
                            yield hand_on()
                            size = 0
            if held:
                yield hand_on()
        finally:
            hand_back()

    return rows.select("group", "lang", "text").mapInArrow(run, "group bigint, terms array<string>")


def share(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a term, at least one; decimals where the product would overflow."""
    def wide(c):
        return c.cast("decimal(19,0)")
    whole = total + 2 * kept
    small = F.call_function("div", (F.when(count < SMALL, count + 2)) * SCALE, whole)
    return F.lit(1) + F.when(count < SMALL, small).otherwise(F.call_function("div", wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(whole)))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


# --- counting ----------------------------------------------------------------
def cells(rows: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(group, index, n, lang_n, lead) of the kept terms of every group, and the (index, term) vocabulary.

    ``rows`` holds (group, lang, text).  ``lead`` marks one cell of each term.
    """
    spark = rows.sparkSession
    # A term that nobody has: the vectorizer refuses an empty vocabulary.
    spare = spark.range(min_docs).select(F.array(F.lit(MARK.decode())).alias("terms"))
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=LARGEST).fit(document_terms(rows).unionByName(spare))
    path = scratch(spark, "vocabulary")
    model.save(path)
    vocabulary = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("index", "tagged")).select(
        "index", F.substring_index("tagged", MARK.decode(), -1).alias("term"))
    vector = F.unwrap_udt("vector")
    found = model.transform(group_terms(rows)).select("group", F.inline(F.arrays_zip(vector["indices"].alias("index"), vector["values"].alias("n"))))
    sums = found.groupBy("group", "index").agg(F.sum(F.col("n").cast("bigint")).alias("n"))
    # An index belongs to one language, so its groups are that language's sources.
    of_term = Window.partitionBy("index")
    return materialise(sums.select("*", F.sum("n").over(of_term).alias("lang_n"), (F.min("group").over(of_term) == F.col("group")).alias("lead"))), vocabulary


def groups(named: DataFrame, found: DataFrame) -> DataFrame:
    """Every occurring (lang, source): its number and tile within the language, kept terms of the language, totals, and an absent term's share."""
    of_group = named.join(found.groupBy("group").agg(F.sum("n").alias("total"), F.count_if("lead").alias("leads")), "group", "left").na.fill(0, ["total", "leads"])
    of_lang = Window.partitionBy("lang")
    every = of_group.withColumn("kept", F.sum("leads").over(of_lang)).withColumn("lang_total", F.sum("total").over(of_lang)).drop("leads")
    numbered = every.withColumn("number", F.row_number().over(of_lang.orderBy("source")) - 1)
    return materialise(numbered.withColumn("tile", F.floor(F.col("number") / TILE)).withColumn(
        "absent", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))))


# --- pairs -------------------------------------------------------------------
def _compare(table: pa.Table) -> pa.Table:
    """Sums over the terms of a block that a pair of sources has: (lang, a, b, value, seen)."""
    lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
    number, tile, index, p = (table.column(c).to_numpy() for c in ("number", "tile", "index", "p"))
    mark = index < 0
    sources, first = np.unique(number[mark], return_index=True)
    absent, side = p[mark][first], tile[mark][first]
    row = np.searchsorted(sources, number[~mark])
    places, column = np.unique(index[~mark], return_inverse=True)
    order = np.lexsort((column, row))
    row, column, value = row[order], column[order], p[~mark][order]
    held = np.repeat(absent[:, None], len(places), axis=1)
    held[row, column] = value
    present = np.zeros(held.shape, bool)
    present[row, column] = True
    starts = np.searchsorted(row, np.arange(len(sources) + 1))
    out: list[list] = [[], [], [], []]
    for i in np.flatnonzero(side == low):
        others = np.flatnonzero(side == high)
        if low == high:
            others = others[others > i]
        if not len(others):
            continue
        own = column[starts[i]:starts[i + 1]]
        there = held[np.ix_(others, own)]
        mine = held[i, own][None, :]
        sums = ((mine - there) ** 2 // (mine + there)).sum(1)
        shared = present[np.ix_(others, own)].sum(1)
        # Terms of the others that source i lacks, cell by cell; `ahead` holds running sums.
        rest = ~present[i, column]
        beyond = np.where(rest, (value - absent[i]) ** 2 // (value + absent[i]), 0)
        ahead = np.r_[0, np.cumsum(beyond)]
        sums += ahead[starts[others + 1]] - ahead[starts[others]]
        seen = len(own) + (starts[others + 1] - starts[others]) - shared
        for part, found in zip(out, ([sources[i]] * len(others), sources[others], sums, seen)):
            part.extend(int(x) for x in found)
    return pa.Table.from_arrays([pa.array([lang] * len(out[0]), pa.string()), *(pa.array(c, pa.int64()) for c in out)], ["lang", "a", "b", "value", "seen"])


def pair_sums(found: DataFrame, known: DataFrame) -> DataFrame:
    """lang, a, b (numbers, a before b), value and seen: sums over all terms that one of the two has."""
    tiles = known.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))
    info = broadcast_if_small(known.filter("kept > 0").join(tiles, "lang").select(
        "group", "lang", "number", "tile", "tiles", "total", "kept", "absent", F.ceil(F.col("kept") / BLOCK).alias("blocks")))
    real = found.join(info, "group").select(
        "lang", "number", "tile", "tiles", F.pmod(F.col("index").cast("bigint"), "blocks").alias("block"), F.col("index").cast("bigint").alias("index"),
        share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    marks = info.select("lang", "number", "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                        F.lit(-1).cast("bigint").alias("index"), F.col("absent").alias("p"))
    dealt = real.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "lang", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "number", "tile", "index", "p")
    parts = dealt.groupBy("lang", "block", "low", "high").applyInArrow(_compare, "lang string, a bigint, b bigint, value bigint, seen bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))


def pairs(found: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value."""
    sums = pair_sums(found, known)
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value", "seen"))
    one = known.select("lang", "source", F.col("number").cast("bigint").alias("a"), "kept", F.col("absent").alias("p"))
    two = known.select("lang", F.col("source").alias("item"), F.col("number").cast("bigint").alias("b"), F.col("absent").alias("q"))
    listed = one.join(two, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left")
    lacking = F.when(F.col("kept") > 0, (F.col("kept") - F.coalesce("seen", F.lit(0))) * distance(F.col("p"), F.col("q"))).otherwise(0)
    return listed.select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + lacking).alias("value"))


# --- terms -------------------------------------------------------------------
def leading_terms(found: DataFrame, known: DataFrame, vocabulary: DataFrame, top: int) -> DataFrame:
    """lang, source, item (term), value, rank of the ``top`` terms that a group uses more than its language."""
    info = broadcast_if_small(known.select("group", "lang", "source", "total", "kept", "lang_total"))
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    more = found.join(info, "group").select("lang", "source", "index", p.alias("p"), q.alias("q")).filter("p > q").select(
        "lang", "source", "index", distance(F.col("p"), F.col("q")).alias("value"))
    group = Window.partitionBy("lang", "source")
    # Ranks with their ties first, so that only these terms need their names.
    near = more.withColumn("place", F.rank().over(group.orderBy(F.desc("value")))).filter(F.col("place") <= top)
    named = near.join(vocabulary, "index").select("lang", "source", F.col("term").alias("item"), "value")
    return named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    named = materialise(rows.select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id()))
    found, vocabulary = cells(rows.join(broadcast_if_small(named), ["lang", "source"]), min_docs)
    known = groups(named, found)
    compared = pairs(found, known).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return compared.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        leading_terms(found, known, vocabulary, top).withColumn("part", F.lit("term")).select(*columns))

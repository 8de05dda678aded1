"""Line deduplication by a suffix array over line-id sequences.

Suffixes of documents, as sequences of lines, are named by prefix doubling: a name of
a suffix's first 2h lines comes from the names of its first h and the next h, and
names are the first place in the corpus where those lines stand.  Suffixes with equal
names form an interval of the suffix array with a longest common prefix of at least h
lines, and all but the first of an interval start a run that stands before.  The union
of these runs, over all intervals, is the union of the maximal repeated runs; their
lines are deleted.

Everything is DataFrame expressions, joins, windows and aggregates.  Suffixes that no
other shares a prefix with leave the computation at once, so rounds carry only
repeated lines, and there are as many as the logarithm of the longest repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.session import materialise

from .common import WORD, own_names

MIN_WORDS = 3
"""Words that a repeated run has at least; shorter ones, such as a lone "Yes.", stay."""


def number_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """g, doc, doc_id, th, pos, h1, h2, words (counted up to ``min_words``): lines with a word, numbered by doc_id and place.

    ``g`` rises with doc_id (nulls first), text digest and place, and ``doc`` is the g
    of the document's first line.  Equal rows of a table are one document.
    """
    line = F.col("line")
    at_least = [F.when(line.rlike(rf"^(?:[\x20\x09-\x0D]*+{WORD}+){{{n}}}"), n) for n in range(min_words, 0, -1)]
    lines = (docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
             .select("doc_id", "th", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.coalesce(*at_least).alias("words"))
             .filter(F.col("words").isNotNull()))
    sorted_lines = lines.repartitionByRange("doc_id", "th").distinct().sortWithinPartitions("doc_id", "th", "pos")
    place = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("pos"))
    return materialise(sorted_lines.withColumn("place", place).withColumn("g", F.monotonically_increasing_id())
                       .withColumn("doc", F.col("g") - F.col("place") + 1).drop("place"))


def _named(pairs: DataFrame, *key: str) -> DataFrame:
    """Rows of keys that occur twice or more, with ``name``: the smallest g of the key.

    The names are dealt out once more before the join, so that a hot key's rows can be split.
    """
    names = pairs.groupBy(*key).agg(F.min("g").alias("name"), F.max("g").alias("most")).filter("name < most").drop("most").repartition("name")
    return pairs.join(names, list(key))


def _followed(level: DataFrame, step: int, n: int) -> DataFrame:
    """Names at g, g + step, ... (n of them) as n0, n1, ...; only where all are there."""
    def at(k: int) -> Column:
        w = Window.partitionBy("doc").orderBy("g").rangeBetween(k * step, k * step)
        return F.max("name").over(w).alias(f"n{k}")

    return level.select("doc", "g", F.col("name").alias("n0"), *map(at, range(1, n))).dropna(subset=[f"n{k}" for k in range(1, n)])


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """Level h: (doc, g, name) of suffixes whose first 4**h lines stand in two places or more.

    A round doubles the prefix twice before it names anew, which halves the shuffles.
    """
    level = materialise(_named(lines.select("doc", "g", "h1", "h2"), "h1", "h2").select("doc", "g", "name"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        four = _followed(level, 4 ** (len(levels) - 1), 4)
        level = materialise(_named(four, "n0", "n1", "n2", "n3").select("doc", "g", "name"))
    return levels


def windows(levels: list[DataFrame], min_words: int) -> list[tuple[int, DataFrame]]:
    """(lines, frame) of prefixes of a fixed length with ``name`` and ``g``: all levels, and the short lengths between them.

    A length between two levels is named by windows of the lower level that cover it.
    Runs of ``min_words`` lines have that many words, so longer lengths are covered by
    their parts.
    """
    found = [(4 ** h, level) for h, level in enumerate(levels)]
    for length in range(2, min_words + 1):
        h = next(h for h in range(len(levels) + 1) if 4 ** (h + 1) > length)
        if h >= len(levels) or length == 4 ** h:
            continue
        part = 4 ** h
        n = -(-length // part)
        if length % part:  # the last window ends with the run
            whole = _followed(levels[h], part, n - 1)
            last = levels[h].select((F.col("g") - (length - part)).alias("g"), F.col("name").alias("last"))
            rows, key = whole.join(last, "g"), [*(f"n{k}" for k in range(n - 1)), "last"]
        else:
            rows, key = _followed(levels[h], part, n), [f"n{k}" for k in range(n)]
        found.append((length, _named(rows, *key).select("doc", "g", "name")))
    return found


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(numbered lines, runs): runs have doc, g, source and n_lines of repeats of what stands at ``source`` before.

    At each g the longest level or short length that repeats is given; the union of
    all runs of a document is the union of its maximal repeated runs.
    """
    lines = number_lines(docs, min_words)
    levels = suffix_levels(lines)
    if not levels:
        return lines, lines.select("doc", "g", F.col("g").alias("source"), F.lit(1).alias("n_lines")).limit(0)
    first = lines.join(levels[0].select("g"), "g", "left_semi").select("doc", "g", "words")
    runs = None
    for n, frame in windows(levels, min_words):
        later = frame.filter("name < g").select("doc", "g", F.col("name").alias("source"), F.lit(n).alias("n_lines"))
        if n < min_words:  # the window's own words decide
            w = Window.partitionBy("doc").orderBy("g").rangeBetween(0, n - 1)
            enough = first.select("g", F.sum("words").over(w).alias("total")).filter(F.col("total") >= min_words).select("g")
            later = later.join(enough, "g", "left_semi").select("doc", "g", "source", "n_lines")
        runs = later if runs is None else runs.unionByName(later)
    longest = runs.groupBy("doc", "g").agg(F.max(F.struct("n_lines", "source")).alias("r"))
    return lines, longest.select("doc", "g", "r.source", "r.n_lines")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th (text digest), deleted (places of lines from 0), n_word_lines of documents that lose lines."""
    lines, runs = repeated_runs(docs, min_words)
    reach = F.max(F.col("g") + F.col("n_lines")).over(Window.partitionBy("doc").orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    covered = lines.select("doc", "g", "doc_id", "th", "pos").join(runs.select("g", "n_lines"), "g", "left").withColumn("reach", reach)
    return (covered.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.count("*").alias("n_word_lines"),
                                       F.sort_array(F.collect_list(F.when(F.col("reach") > F.col("g"), F.col("pos")))).alias("deleted"))
            .filter(F.size("deleted") > 0).drop("doc"))


def _without(text: Column, deleted: Column) -> Column:
    """The text without the lines at the given places."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), deleted)
    return F.when(deleted.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))


def dedupe_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs taken out of ``text``, and ``__lines``, ``__deleted``.

    Lines end at U+000A; lines without a word never count and stay.  The copy that
    stays is the one with the smallest doc_id, nulls first, and the earliest place.
    Null and empty texts stay as they are.  Repeated rows, equal in doc_id and text,
    are one document and all get the same text.
    """
    gone = deleted_lines(docs, min_words).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("deleted").alias("__deleted"), F.col("n_word_lines").alias("__lines"))
    joined = docs.withColumn("__text", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__th")), "left")
    return joined.withColumn("text", _without(F.col("text"), F.col("__deleted"))).select(*docs.columns, "__lines", "__deleted")


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_deleted, deleted (places of deleted lines from 0, joined by commas) and the text that is left; one row per row of ``docs``."""
    return dedupe_lines(docs.select("doc_id", "text"), min_words).select(
        "doc_id", F.coalesce(F.size("__deleted"), F.lit(0)).cast("bigint").alias("n_deleted"), F.coalesce(F.array_join("__deleted", ","), F.lit("")).alias("deleted"), "text")


@own_names
def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, same columns, with cut texts and ``n_chars`` to match; documents that lost every line with a word are dropped.  Other columns may have any names."""
    cut = dedupe_lines(docs, min_words).filter("__deleted IS NULL OR size(__deleted) < __lines")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cut = cut.withColumn("n_chars", F.when(F.col("__deleted").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)

"""Decontamination, duplicates and content-based splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..functions.fixed import ECHO_RUN
from ..session import broadcast_if_small, materialise
from .pairs import prompt_digest


def decontaminate_exact(rows: DataFrame, evaluation: DataFrame, id_col: str = "task_id",
                        text_col: str = "prompt") -> DataFrame:
    """Rows whose id and whose prompt are in no evaluation set.

    ``evaluation`` holds the same two columns.  Prompts are compared by digest, so
    no text is shuffled for the comparison.
    """
    ids = broadcast_if_small(evaluation.select(id_col).where(F.col(id_col).isNotNull()).distinct())
    digests = broadcast_if_small(evaluation.select(prompt_digest(F.col(text_col)).alias("__digest")).where(
        F.col("__digest").isNotNull()).distinct())
    marked = rows.withColumn("__digest", prompt_digest(F.col(text_col)))
    return marked.join(ids, id_col, "left_anti").join(digests, "__digest", "left_anti").drop("__digest")


def contaminated_exact(rows: DataFrame, evaluation: DataFrame, id_col: str = "task_id",
                       text_col: str = "prompt") -> DataFrame:
    """The rows :func:`decontaminate_exact` drops, with what matched."""
    ids = broadcast_if_small(evaluation.select(id_col).where(F.col(id_col).isNotNull()).distinct().withColumn("__id", F.lit(True)))
    digests = broadcast_if_small(evaluation.select(prompt_digest(F.col(text_col)).alias("__digest")).where(
        F.col("__digest").isNotNull()).distinct().withColumn("__text", F.lit(True)))
    marked = rows.withColumn("__digest", prompt_digest(F.col(text_col)))
    joined = marked.join(ids, id_col, "left").join(digests, "__digest", "left")
    why = F.when(F.col("__id"), "id").when(F.col("__text"), "prompt")
    return joined.withColumn("matched", why).where(F.col("matched").isNotNull()).drop("__id", "__text", "__digest")


def require_clean(rows: DataFrame, evaluation: DataFrame, id_col: str = "task_id",
                  text_col: str = "prompt") -> DataFrame:
    """Fail when any row is contaminated, else return the rows."""
    if not contaminated_exact(rows, evaluation, id_col, text_col).isEmpty():
        raise ValueError("training rows collide with evaluation material")
    return rows


def _candidate_grams(documents: DataFrame, benchmark: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, gram) of the few documents that share a 64-bit run hash with the benchmark."""
    words = X.norm_words(F.col(text))
    hashes = benchmark.select(F.explode(X.gram_hashes(words, n)).alias("h")).distinct()
    candidates = broadcast_if_small(documents.select(doc_id, F.explode(X.gram_hashes(words, n)).alias("h")).join(
        hashes, "h", "left_semi").select(doc_id).distinct())
    return documents.join(candidates, doc_id, "left_semi").select(doc_id, F.explode(X.gram_texts(words, n)).alias("gram"))


def decontaminate_ngram(documents: DataFrame, benchmark: DataFrame, n: int = ECHO_RUN, doc_id: str = "doc_id",
                        item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Document–benchmark pairs that share runs of ``n`` words, with the run count.

    Pass one joins 64-bit run hashes only and keeps document ids; where the
    benchmark is small Spark broadcasts its hashes and no document is shuffled.  Pass
    two reads the few candidate documents again and joins on the run text, so a
    hash collision cannot produce a pair.  The candidates are computed and counted
    when the operator is called.
    """
    bench = benchmark.select(item_id, F.explode(X.gram_texts(X.norm_words(F.col(text)), n)).alias("gram"))
    return _candidate_grams(documents, benchmark, n, doc_id, text).join(bench, "gram").groupBy(doc_id, item_id).agg(
        F.count(F.lit(1)).alias("shared_grams"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = ECHO_RUN, doc_id: str = "doc_id",
                      item_id: str = "item_id", text: str = "text", min_shared: int = 1) -> DataFrame:
    """Documents that share fewer than ``min_shared`` runs with every benchmark item."""
    return documents.join(contaminated_ids(documents, benchmark, n, doc_id, item_id, text, min_shared), doc_id, "left_anti")


def contaminated_ids(documents: DataFrame, benchmark: DataFrame, n: int = ECHO_RUN, doc_id: str = "doc_id",
                     item_id: str = "item_id", text: str = "text", min_shared: int = 1) -> DataFrame:
    """Ids of documents that share ``min_shared`` runs or more with a benchmark item; broadcast when few.

    One shared run needs no pairs: documents are looked up among the distinct runs of all items.
    """
    if min_shared == 1:
        runs = benchmark.select(F.explode(X.gram_texts(X.norm_words(F.col(text)), n)).alias("gram")).distinct()
        return broadcast_if_small(_candidate_grams(documents, benchmark, n, doc_id, text).join(runs, "gram", "left_semi").select(doc_id).distinct())
    return broadcast_if_small(decontaminate_ngram(documents, benchmark, n, doc_id, item_id, text).where(
        F.col("shared_grams") >= min_shared).select(doc_id).distinct())


def duplicate_prompts(rows: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Texts that occur more than once: digest, copies and first id.  Missing texts are no copies."""
    return rows.where(F.col(text_col).isNotNull()).groupBy(prompt_digest(F.col(text_col)).alias("digest")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id"),
    ).where(F.col("copies") > 1)


def first_seen(rows: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each text: that of the smallest id, and of its repeats the smallest row.

    Copies combine before the shuffle, where only digests and ids go; the rows themselves are
    met again by (digest, id).  An id may come with several texts.  Rows without a text are
    nobody's copies and stay; an id that is missing counts only where a text has no other.
    """
    digest, first = unused(rows, "digest"), unused(rows, "first")
    given = rows.where(F.col(text_col).isNotNull()).withColumn(digest, prompt_digest(F.col(text_col)))
    firsts = materialise(given.groupBy(F.col(digest).alias(first + "_of")).agg(F.min(id_col).alias(first), F.count(F.lit(1)).alias(first + "_n")))

    def met(some: DataFrame) -> DataFrame:
        return given.join(some, (F.col(digest) == F.col(first + "_of")) & F.col(id_col).eqNullSafe(F.col(first)), "left_semi")

    single, copied = met(firsts.where(F.col(first + "_n") == 1)).drop(digest), met(firsts.where(F.col(first + "_n") > 1))
    # Only texts with copies are reduced: where an id repeats with the same text, the smallest row stays.
    one = copied.groupBy(digest).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias(first))
    return single.unionByName(one.select(f"{first}.*")).unionByName(rows.where(F.col(text_col).isNull()))


def unused(rows: DataFrame, name: str) -> str:
    """A helper column name that ``rows`` does not have."""
    while any(c.startswith(f"__{name}") for c in rows.columns):
        name += "_"
    return f"__{name}"


def hash_split(rows: DataFrame, text_col: str = "text", modulus: int = 7) -> DataFrame:
    """Add ``split``: one text in ``modulus`` is heldout, by md5 of the content."""
    return rows.withColumn("split", F.when(H.is_held_out(F.col(text_col), modulus), "heldout").otherwise("train"))


def subtract(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def intersect(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key is also in ``right``."""
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def distinct_by(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the smallest by ``order``, all columns kept."""
    packed = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return packed.select("r.*")

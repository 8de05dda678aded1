"""Exact best documents per query without a table of all (query, document) pairs.

Documents are dealt into blocks of similar richness: documents that hold about as many of
the queries' tokens lie together.  A block's postings say which tokens any of its documents
holds, so the weights of a query's tokens that occur in the block, or the most tokens that
one of its documents holds, bound every score in it.  A query reads its most promising
blocks, its ``k``-th best score becomes a threshold, and only blocks whose bound passes the
threshold are read after that.  Where a bound equals the threshold, a block still counts only
if it has a name small enough to win the tie.  The result is exact; what is pruned cannot
enter it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..session import broadcast_if_small, materialise
from .ordering import first_rows
from .retrieval import numbered_tokens, token_counts, token_sets

BLOCK = 1024
"""Documents of a block, on average at most."""

FIRST = 4
"""Blocks that a query reads in its first round; each further round reads sixteen times as many."""

BAND = 1.25
"""Ratio between the most and the fewest tokens held in a block."""


@dataclass
class Index:
    tokens: DataFrame
    """(token, number) of the queries' tokens."""

    documents: DataFrame
    """(doc, numbers, held, size, block): one row for each document that holds tokens of the queries, with their numbers."""

    blocks: DataFrame
    """(block, number, most, first, least): with the most tokens one document holds, the smallest name and the smallest size."""


def build_index(documents: DataFrame, tokens: DataFrame, doc_id: str = "doc_id", text: str = "text",
                name: str | None = None, size: str | None = None) -> Index:
    """Blocks of the documents for the ``token`` column of ``tokens``; ``size`` names a column that budgets are counted in."""
    numbered = numbered_tokens(tokens)
    sets = token_sets(documents, numbered, doc_id, text, name).select(F.col(doc_id).alias("doc"), "numbers", F.size("numbers").alias("held"))
    if size:
        sets = sets.join(documents.select(F.col(doc_id).alias("doc"), F.col(size).cast("bigint").alias("size")), "doc")
    else:
        sets = sets.withColumn("size", F.lit(0).cast("bigint"))
    banded = materialise(sets.withColumn("band", F.floor(F.log(BAND, F.col("held")))))
    # One row for each of a few dozen bands.
    split = broadcast_if_small(banded.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("split")))
    placed = banded.join(split, "band").withColumn(
        "block", F.shiftleft(F.col("band"), 32) + F.pmod(F.xxhash64("doc"), F.col("split"))).drop("band", "split")
    ends = placed.groupBy("block").agg(F.max("held").alias("most"), F.min("doc").alias("first"), F.min("size").alias("least"))
    in_block = placed.select("block", F.explode("numbers").alias("number")).distinct()
    return Index(numbered, placed, materialise(in_block.join(ends, "block")))


def best(index: Index, weights: DataFrame, k: int, query_id: str = "query_id", limits: DataFrame | None = None,
         min_score: int = 1) -> DataFrame:
    """(query_id, doc, size, score): the ``k`` best documents by score, ties to the smaller name.

    ``weights`` holds (query_id, token, weight).  ``limits`` restricts queries to documents
    within ``room`` that rank after (``after_score``, ``after_doc``), both nullable; queries
    that it does not name find nothing.
    """
    asked = broadcast_if_small(weights.join(index.tokens, "token").select(query_id, "number", "weight"))
    heaviest = weights.groupBy(query_id).agg(F.max("weight").alias("heaviest"))
    bound = F.least(F.sum("weight"), F.first("most") * F.first("heaviest"))
    bounds = asked.join(heaviest, query_id).join(index.blocks, "number").groupBy(query_id, "block").agg(
        bound.alias("bound"), F.first("first").alias("first"), F.first("least").alias("least"))
    if limits is not None:
        bounds = bounds.join(limits, query_id).where((F.col("least") <= F.col("room"))).withColumn(
            "bound", F.least("bound", "after_score")).drop("room", "after_score", "after_doc", "least")
    pending = materialise(bounds.where(F.col("bound") >= min_score).drop("least"))
    order = [F.desc("score"), F.col("doc")]
    found, last, step = None, None, FIRST
    while True:
        chosen = broadcast_if_small(first_rows(pending, [query_id], [F.desc("bound"), F.col("first"), F.col("block")], step).select(query_id, "block"))
        held = index.documents.join(broadcast_if_small(chosen.select("block").distinct()), "block", "left_semi").select(
            "doc", "size", "block", F.explode("numbers").alias("number"))
        scored = held.join(asked, "number").join(chosen, [query_id, "block"]).groupBy(query_id, "doc", "size").agg(
            F.sum("weight").alias("score")).where(F.col("score") >= min_score)
        if limits is not None:
            after = F.col("after_score").isNull() | (F.col("score") < F.col("after_score")) | (
                (F.col("score") == F.col("after_score")) & (F.col("doc") > F.col("after_doc")))
            scored = scored.join(limits, query_id).where((F.col("size") <= F.col("room")) & after).drop("room", "after_score", "after_doc")
        if found is not None:
            # What a full query's last row beats cannot enter and is not sorted.
            behind = (F.col("n") == k) & ((F.col("score") < -F.col("last.s")) | ((F.col("score") == -F.col("last.s")) & (F.col("doc") > F.col("last.d"))))
            scored = scored.join(last, query_id, "left").where(~F.coalesce(behind, F.lit(False))).drop("n", "last").unionByName(found)
        found = materialise(first_rows(scored, [query_id], order, k))
        last = broadcast_if_small(found.groupBy(query_id).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct((-F.col("score")).alias("s"), F.col("doc").alias("d"))).alias("last")))
        beaten = (F.col("n") == k) & ((F.col("bound") < -F.col("last.s")) | (
            (F.col("bound") == -F.col("last.s")) & (F.col("first") > F.col("last.d"))))
        rest = pending.join(chosen, [query_id, "block"], "left_anti").join(last, query_id, "left")
        pending = materialise(rest.where(~F.coalesce(beaten, F.lit(False))).drop("n", "last"))
        if pending.isEmpty():
            return found
        step *= 16


def top_documents(queries: DataFrame, documents: DataFrame, k: int = 6, query_id: str = "query_id", doc_id: str = "doc_id",
                  query_text: str = "query", text: str = "text", name: str | None = None, size: str | None = None,
                  preferred: Sequence = (), count_repeats: bool = False, min_score: int = 1) -> DataFrame:
    """(query_id, doc_id, score[, size]): the rows of ``relevance_join`` that are among the ``k`` best of their query.

    With ``size`` documents whose size is not above zero do not count.
    """
    weights = materialise(token_counts(queries, query_id, query_text).select(
        query_id, "token", (F.col("repeats") if count_repeats else F.lit(1).cast("bigint")).alias("weight")))
    given = documents if size is None else documents.where(F.col(size) > 0)
    index = build_index(given, weights, doc_id, text, name, size)
    found = best(index, weights, k, query_id, min_score=1 if preferred else min_score)
    if preferred:
        named = given.where(F.col(doc_id).isin(list(preferred))).select(F.col(doc_id).alias("doc"), (
            F.col(size).cast("bigint") if size else F.lit(0).cast("bigint")).alias("size"))
        boosts = queries.select(query_id).distinct().join(F.broadcast(named)).withColumn("score", F.lit(V.PREFERRED_BOOST).cast("bigint"))
        own = index.documents.where(F.col("doc").isin(list(preferred))).select("doc", "size", F.explode("numbers").alias("number")).join(
            index.tokens, "number").join(weights, "token").groupBy(query_id, "doc", "size").agg(F.sum("weight").alias("score"))
        raised = own.unionByName(boosts).groupBy(query_id, "doc", "size").agg(F.sum("score").alias("score"))
        others = found.where(~F.col("doc").isin(list(preferred)))
        found = first_rows(others.unionByName(raised).where(F.col("score") >= min_score), [query_id], [F.desc("score"), F.col("doc")], k)
    columns = [query_id, F.col("doc").alias(doc_id), "score", *([F.col("size").alias(size)] if size else [])]
    return found.select(*columns)


def skip_over(queries: DataFrame, documents: DataFrame, budget: int, limit: int = 2, query_id: str = "query_id", doc_id: str = "doc_id",
              query_text: str = "query", text: str = "text", name: str | None = None, size: str = "n_chars") -> DataFrame:
    """(query_id, doc_id, score, size, turn): best documents that still fit a budget, those that do not being skipped.

    Postings are made once, of the documents that can fit at any turn; each turn is a search for
    the one best document behind the last pick that fits the room left.
    """
    # Room grows only where a size is below zero.
    least = documents.agg(F.least(F.min(size), F.lit(0)).cast("bigint").alias("least")).first()["least"]
    documents = documents.where(F.col(size) <= budget - (limit - 1) * (least or 0))
    weights = materialise(token_counts(queries, query_id, query_text).select(query_id, "token", F.lit(1).cast("bigint").alias("weight")))
    index = build_index(documents, weights, doc_id, text, name, size)
    kind = index.documents.schema["doc"].dataType
    limits = weights.select(query_id).distinct().select(
        query_id, F.lit(budget).cast("bigint").alias("room"), F.lit(None).cast("bigint").alias("after_score"), F.lit(None).cast(kind).alias("after_doc"))
    picks = []
    for turn in range(1, limit + 1):
        pick = materialise(best(index, weights, 1, query_id, limits).join(limits.select(query_id, "room"), query_id))
        picks.append(pick.select(query_id, F.col("doc").alias(doc_id), "score", F.col("size").alias(size), F.lit(turn).alias("turn")))
        limits = pick.select(query_id, (F.col("room") - F.col("size")).alias("room"), F.col("score").alias("after_score"), F.col("doc").alias("after_doc"))
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out

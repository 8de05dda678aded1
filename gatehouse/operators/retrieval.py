"""Context retrieval: substring relevance and selection under budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import fixed as V
from ..functions.text import trim_middle
from ..session import broadcast_if_small, materialise
from .ordering import first_rows
from .scan import held_tokens

TOKEN = f"[a-z0-9-]{{{V.MIN_TOKEN},}}"


def query_tokens(text: Column) -> Column:
    """Tokens of a query, of four characters or more, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def grams(word: Column) -> Column:
    """Distinct pieces of ``MIN_TOKEN`` characters of a word that is at least as long."""
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(word) - (V.MIN_TOKEN - 1)),
        lambda i: F.substr(word, i, F.lit(V.MIN_TOKEN))))


def rarest_grams(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """(token, gram): the piece of each token that the fewest ``pieces`` rows hold.

    A token with a piece that no word has occurs nowhere and is left out.
    """
    wanted = tokens.select("token").distinct().select("token", F.explode(grams(F.col("token"))).alias("gram"))
    held = pieces.join(broadcast_if_small(wanted.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(held, "gram", "left").groupBy("token").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("lacking"),
    ).where(F.col("lacking") == 0).drop("lacking")


def numbered_tokens(queries: DataFrame) -> DataFrame:
    """(token, number) of the distinct values of ``token``."""
    return materialise(queries.select("token").distinct().withColumn("number", F.monotonically_increasing_id()))


TRIE_BYTES = 500_000
"""Most bytes of tokens that one trie is made of; its nodes are no more."""


def few_tokens(tokens: DataFrame) -> list | None:
    """The rows (token, number) of a materialised frame, if a trie of them fits a task, counted by an aggregate."""
    found = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token").cast("bigint")).alias("bytes")).first()
    return tokens.collect() if found.n <= session.BROADCAST_ROWS and (found.bytes or 0) <= TRIE_BYTES else None


def token_sets(documents: DataFrame, tokens: DataFrame, doc_id: str, text: str, name: str | None = None) -> DataFrame:
    """(doc_id, numbers): numbers of the ``tokens`` (token, number) that occur inside a document, as substring.

    With ``name`` that column is searched as well, as a line of its own.  A token holds
    only ``[a-z0-9-]``, so it can only lie within one run of such characters.  The
    distinct runs of the corpus are matched to the tokens through the token's rarest
    four-character piece (an equi-join), checked for containment, and joined back to the
    documents that hold the run: no nested loop over texts, and no hot piece such as the
    start of every address as a key.  A document is one row, so that what it holds is
    shuffled and stored as numbers, and its scores are summed where the row lies.

    Tokens that fit one trie are searched for in the texts themselves instead, see :mod:`.scan`:
    the vocabulary grows with the corpus and would pass every broadcast bound.
    """
    searched = F.col(text) if name is None else F.concat_ws("\n", F.col(name).cast("string"), F.col(text))
    listed = few_tokens(tokens)
    if listed is not None:
        found = held_tokens(documents.select(doc_id, F.lower(searched).alias("__text")), listed)
        return found.groupBy(doc_id).agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"))
    runs = documents.select(doc_id, F.explode(F.array_distinct(query_tokens(searched))).alias("run"))
    vocabulary = materialise(runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")))
    pieces = vocabulary.select("run", "n", F.explode(grams(F.col("run"))).alias("gram"))
    keys = broadcast_if_small(rarest_grams(tokens, pieces).join(tokens, "token"))
    matched = materialise(pieces.join(keys, "gram").where(F.contains("run", "token")).groupBy("run", "n").agg(F.collect_list("number").alias("numbers")))
    common, seldom = by_use(matched)
    held = runs.join(F.broadcast(common), "run").select(doc_id, "numbers")
    if seldom is not None:
        held = held.unionByName(runs.join(F.broadcast(common.select("run")), "run", "left_anti").join(seldom, "run").select(doc_id, "numbers"))
    return held.groupBy(doc_id).agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"))


def by_use(matched: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The runs of ``matched`` (run, n, numbers) that most documents hold, as many as may be broadcast, and the others if there are any.

    Runs are counted by classes of ``n``, each four times as wide as the one before.  The
    vocabulary grows with the corpus, but the runs that make up most texts do not, so only
    documents' seldom runs are shuffled to be looked up.
    """
    width = F.octet_length("run") + 8 * F.size("numbers")
    classes = matched.groupBy(F.floor(F.log(4.0, F.col("n"))).alias("class")).agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes"))
    rows, size, least = 0, 0, None
    for c in classes.orderBy(F.desc("class")).collect():  # a few dozen rows
        rows, size = rows + c.rows, size + c.bytes
        if rows > session.BROADCAST_ROWS or size > session.BROADCAST_BYTES:
            break
        least = c["class"]
    else:
        return matched, None
    often = F.floor(F.log(4.0, F.col("n"))) >= least if least is not None else F.lit(False)
    return matched.where(often), matched.where(~often)


def token_counts(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, token, repeats) of every query."""
    listed = queries.select(query_id, F.explode(query_tokens(F.col(text))).alias("token"))
    return listed.groupBy(query_id, "token").agg(F.count(F.lit(1)).alias("repeats"))


def relevance_join(queries: DataFrame, documents: DataFrame, query_id: str = "query_id",
                   doc_id: str = "doc_id", query_text: str = "query", text: str = "text",
                   preferred: Sequence = (), count_repeats: bool = False,
                   min_score: int = 1, name: str | None = None) -> DataFrame:
    """Score of each document for each query: how many of its tokens it contains.

    This is every pair that shares a token.  For the best few documents of each query
    :func:`gatehouse.operators.search.top_documents` gets by without them.  ``preferred`` names the few documents that get five points for every query, even
    without a token.  ``count_repeats`` counts a repeated query token each time.
    """
    counts = materialise(token_counts(queries, query_id, query_text))
    tokens = numbered_tokens(counts)
    points = F.sum("repeats") if count_repeats else F.count(F.lit(1))
    asked = broadcast_if_small(counts.join(tokens, "token").select(query_id, "number", "repeats"))

    def scores(rows: DataFrame) -> DataFrame:
        held = token_sets(rows, tokens, doc_id, text, name).select(doc_id, F.explode("numbers").alias("number"))
        return held.join(asked, "number").groupBy(query_id, doc_id).agg(points.alias("score"))

    if preferred:
        names = F.array(*[F.lit(p) for p in preferred]).cast(f"array<{documents.schema[doc_id].dataType.simpleString()}>")
        boosts = queries.select(query_id, F.explode(names).alias(doc_id)).distinct().withColumn(
            "score", F.lit(V.PREFERRED_BOOST).cast("bigint"))
        # Only the rows of these documents, read for themselves, are added up again; all others stay where they are.
        named = F.coalesce(F.col(doc_id).isin(list(preferred)), F.lit(False))
        raised = scores(documents.where(named)).unionByName(boosts).groupBy(query_id, doc_id).agg(F.sum("score").alias("score"))
        scored = scores(documents.where(~named)).unionByName(raised)
    else:
        scored = scores(documents)
    return scored.where(F.col("score") >= min_score)


def select_context(scored: DataFrame, budget: int, query_id: str = "query_id", name: str = "doc_id",
                   size: str = "n_chars", limit: int = 6) -> DataFrame:
    """Best documents per query: at most ``limit``, and none once the budget is used.

    Adds ``rank`` and ``prior`` (characters selected before).  The document that
    crosses the budget is still selected, cut to what is left.
    """
    order = [F.col("score").desc(), F.col(name).asc()]
    top = first_rows(scored.where(F.col(size) > 0), [query_id], order, limit)
    w = Window.partitionBy(query_id).orderBy(*order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = top.withColumn("rank", F.row_number().over(w)).withColumn("prior", before)
    return ranked.where(F.col("prior") < budget).withColumn(
        "taken", F.least(F.col(size), F.lit(budget) - F.col("prior")))


def select_skip_over(scored: DataFrame, budget: int, query_id: str = "query_id", name: str = "doc_id",
                     size: str = "n_chars", limit: int = 2) -> DataFrame:
    """Best documents that still fit, skipping those that do not.

    Each pick is one aggregate over the documents ranked after the previous pick
    that fit the room left, so no ranked list is ever collected.
    """
    rank = F.struct((-F.col("score")).alias("s"), F.col(name).alias("n"))
    pool = scored.withColumn("__rank", rank)
    state = scored.select(query_id).distinct().select(
        query_id, F.lit(budget).cast("bigint").alias("__room"), F.lit(None).cast(
            pool.schema["__rank"].dataType).alias("__after"))
    picked = None
    for turn in range(1, limit + 1):
        fits = pool.join(state, query_id).where(
            (F.col(size) <= F.col("__room"))
            & (F.col("__after").isNull() | (F.col("__rank") > F.col("__after"))))
        pick = fits.groupBy(query_id).agg(
            F.min_by(F.struct(name, "score", F.col(size).alias("size"), "__rank", "__room"), "__rank").alias("p"))
        rows = pick.select(query_id, f"p.{name}", "p.score", F.col("p.size").alias(size),
                           F.lit(turn).alias("turn"))
        picked = rows if picked is None else picked.unionByName(rows)
        state = pick.select(query_id, (F.col("p.__room") - F.col("p.size")).alias("__room"),
                            F.col("p.__rank").alias("__after"))
    return picked


def trim_to_running_budget(selected: DataFrame, budget: int, used: Column | int = 0,
                           query_id: str = "query_id", rank: str = "rank", text: str = "text") -> DataFrame:
    """Each selected document keeps what is left of the budget, trimmed in the middle.

    Runs on the few documents :func:`select_context` kept per query.
    """
    start = F.lit(used) if isinstance(used, int) else used
    w = Window.partitionBy(query_id).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    left = F.lit(budget) - start - prior
    room = selected.withColumn("left", left.cast("int")).where(F.col("left") > 0)
    return room.withColumn("content", trim_middle(F.col(text), F.col("left")))

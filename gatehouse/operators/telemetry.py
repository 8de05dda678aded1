"""Roll-ups of calls, runs and leaderboard entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import presence
from ..session import broadcast_if_small
from .ordering import position

NAME_HEAD = 4
"""Characters of a name that cut rows of equal rank and measure."""

COUNTERS = ["calls", "total_tokens", "tool_runs", "errors"]


def calls_to_metrics(calls: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Call records to run metrics; failed calls count as errors, not as calls.

    ``calls`` holds (run_id, ts, model, tokens, error, tool).
    """
    good = ~F.col("error")
    return calls.groupBy(*keys).agg(
        F.count_if(good).alias("calls"),
        F.coalesce(F.sum(F.when(good, F.col("tokens"))), F.lit(0)).alias("total_tokens"),
        F.count_if(F.col("tool")).alias("tool_runs"), F.count_if(F.col("error")).alias("errors"),
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"),
        F.min_by("model", F.struct("ts", "call_id")).alias("model"))


def run_totals(runs: DataFrame, keys: Sequence[str], counters: Sequence[str] = COUNTERS,
               order: str = "run_id") -> DataFrame:
    """Counters summed over runs, with the first non-empty model.

    The records themselves stay rows: a union, never one nested list.
    """
    model = presence(F.col("model"))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in counters],
        F.min_by(model, F.when(model.isNotNull(), F.col(order))).alias("model"))


def leaderboard_rank(entries: DataFrame, board: str = "board", mode: str = "auto",
                     edges: int = 64) -> DataFrame:
    """Add ``computed_rank`` per board: given rank first, then the mode's measure.

    Entries with a given rank lead; others follow by tokens (fewest first) or by
    score or accuracy (highest first), missing values last, ties by name.  A board is
    cut at about ``edges`` approximate percentiles of its ranks and measures, and a value
    common enough to be one at the head of the name, so that no board is ranked in one
    task, whatever its range.
    The percentiles are computed when the operator is called.
    """
    tokens_first = F.lower(F.coalesce("rank_by", F.lit(""))).contains("tokens")
    measure = {
        "tokens": F.col("tokens").cast("double"),
        "accuracy": -F.col("accuracy"),
        "score": -F.col("score"),
        "auto": F.when(tokens_first, F.coalesce(F.col("tokens").cast("double"), F.col("score"))).otherwise(
            -F.col("score")),
    }[mode]
    keyed = entries.withColumn("__given", F.col("rank").isNull()).withColumn(
        "__measure", F.when(F.col("rank").isNull(), measure)).withColumn("__none", F.col("__measure").isNull())
    order = ["__given", "rank", "__none", "__measure", "name"]
    keyed = keyed.withColumn("__value", F.coalesce(F.col("rank").cast("double"), "__measure"))
    shares = [i / edges for i in range(1, edges)]
    cuts = broadcast_if_small(keyed.groupBy(F.col(board).alias("__board"), F.col("__given").alias("__free")).agg(
        F.percentile_approx("__value", shares, 10 * edges).alias("__cuts")))
    keyed = keyed.join(cuts, F.col(board).eqNullSafe(F.col("__board")) & (F.col("__given") == F.col("__free")))
    below = F.size(F.filter("__cuts", lambda cut: cut < F.col("__value")))
    common = F.array_contains("__cuts", F.col("__value"))
    # The bucket follows the order: values between two cuts, or one common value cut further by name.
    bucket = F.struct(
        F.col("__given").alias("a"), F.col("__none").alias("b"), F.coalesce(below, F.lit(0)).alias("c"),
        F.coalesce(common, F.lit(False)).alias("d"), F.when(common, F.substring("name", 1, NAME_HEAD)).alias("e"))
    ranked = position(keyed, [board], order, bucket, "computed_rank")
    return ranked.drop("__given", "__measure", "__none", "__board", "__free", "__cuts", "__value")


def leaders(entries: DataFrame, k: int, *order: Column) -> DataFrame:
    """Top-k over all boards: sort and limit, which Spark runs as one bounded heap per task."""
    return entries.orderBy(*order).limit(k)

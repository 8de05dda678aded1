"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): root is the smallest vertex that links reach.

    Each round points every vertex to its smallest neighbour, follows the pointer there,
    and replaces edges by edges between the ends.  A hot vertex is one row of the
    unique side of each join.  Loops and repeated edges do no harm; without edges
    the result is empty.
    """
    def ordered(e: DataFrame) -> DataFrame:
        return materialise(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())

    e, labels = ordered(edges), None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        near = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("p")).select("u", F.least("u", "p").alias("p"))
        parent = materialise(near.join(near.select(F.col("u").alias("q"), F.col("p").alias("r")), F.col("p") == F.col("q")).select("u", F.col("r").alias("p")))
        ends = parent.select(F.col("u").alias("root"), F.col("p").alias("next"))
        labels = (parent.select(F.col("u").alias("v"), F.col("p").alias("root")) if labels is None else
                  labels.join(ends, "root", "left").select("v", F.coalesce("next", "root").alias("root")))
        e = ordered(e.join(parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
                    .join(parent.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
                    .select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    return labels if labels is not None else e.select(F.col("a").alias("v"), F.col("b").alias("root"))

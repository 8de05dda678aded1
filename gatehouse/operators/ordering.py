"""Exact positions and running sums over groups of any size.

A plain window gives a whole group to one task, which fails when one key holds a
third of the rows.  Here a group is cut into buckets that follow the order: each
bucket is numbered on its own, and the totals of the buckets before it (one small
row per bucket) are added.  The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
                value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the key up to this row.

    ``bucket`` must not decrease along ``order`` and should split a hot key into
    pieces that fit a task.  ``inclusive=False`` leaves the row itself out.  NULL is
    a key and a bucket like any other.
    """
    marked = df.withColumn("__bucket", bucket).withColumn("__value", value)
    totals = marked.groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    joined = [*keys, "__bucket"]
    offsets = totals.select(*(F.col(c).alias(f"__at{i}") for i, c in enumerate(joined)), F.coalesce(
        F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__at{i}")) for i, c in enumerate(joined)))
    local = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    summed = marked.join(offsets, same).withColumn("__local", F.sum("__value").over(local))
    total = F.col("__offset") + F.col("__local")
    result = total if inclusive else total - F.col("__value")
    return summed.withColumn(out, result).drop("__bucket", "__value", "__offset", "__local", *(f"__at{i}" for i in range(len(joined))))


def position(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
             out: str = "pos") -> DataFrame:
    """Add ``out``: the 1-based position of the row within its key."""
    return running_sum(df, keys, order, bucket, F.lit(1).cast("bigint"), out)


GROUP_LIMIT = 1000
"""Largest ``k`` for which Spark limits each key before the shuffle, by default."""

SPLITS = 64
"""Pieces a key is cut into where Spark does not limit it before the shuffle."""


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
               rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key; ``rank`` names a column for their position from 1.

    Spark limits each key before the shuffle (WindowGroupLimit), so a hot key
    sends at most ``k`` rows per input partition.  It does so up to ``GROUP_LIMIT``
    only; for a larger ``k`` each key is cut into pieces by a hash of the row, the
    first ``k`` of each piece are taken, and the first ``k`` of those are the result.
    """
    if k > GROUP_LIMIT:
        hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
        pieces = df.withColumn("__piece", F.pmod(F.xxhash64(*hashed), F.lit(SPLITS)))
        local = Window.partitionBy(*keys, "__piece").orderBy(*order)
        df = pieces.withColumn("__rn", F.row_number().over(local)).where(F.col("__rn") <= k).drop("__rn", "__piece")
    name = rank or "__rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def md5_bucket(digest: Column, digits: int = 3) -> Column:
    """Bucket that follows the order of an md5 text: its leading hex digits."""
    return F.substr(digest, F.lit(1), F.lit(digits))


EDGE = 4096
"""Rows of an edge cell that are ranked in one task; a larger cell is counted once more by further digits."""

DIGITS = 3
"""Hex digits of a digest that a cell has: 4096 cells at a time."""


def first_by_digest(df: DataFrame, keys: Sequence[str], limit: Column, digest: str, tie: Sequence[str] = (), rank_first: Sequence[str] = (),
                    edge: int = EDGE) -> DataFrame:
    """The first ``limit`` rows of each key by (``rank_first``, ``digest``, ``tie``), for limits and keys of any size.

    No key meets in one task, nor do the rows that are taken: rows are counted by the leading
    digits of their digest, a hex text, the counts are summed in order, cells before the
    limit are taken whole, and only the one cell per key that the limit falls into is counted
    by further digits or, when small, ranked.  ``rank_first`` has few values.  ``limit`` depends
    on the keys alone; where it is NULL no row is taken.
    """
    names, out, depth = [*keys, *rank_first], [], DIGITS
    cell = F.substr(F.col(digest), F.lit(1), F.lit(depth))
    rows = df.withColumn("__need", limit.cast("bigint")).where("__need > 0").withColumn("__cell", cell)
    group = [*names, "__cell"]
    outer = list(keys)
    while True:
        counted = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.first("__need").alias("__of"))
        before = Window.partitionBy(*outer).orderBy(*(c for c in group if c not in outer)).rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("__of") - F.coalesce(F.sum("__n").over(before), F.lit(0))
        cells = counted.withColumn("__left", left).where("__left > 0").select(
            *(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(group)), "__n", "__left")
        cells = broadcast_if_small(cells)
        same = reduce(Column.__and__, (F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(group)))
        met = rows.join(cells, same)
        columns = [F.col(f"`{c}`") for c in df.columns]
        out.append(met.where("__n <= __left").select(*columns))
        partly = met.where("__n > __left")
        last = depth >= 32
        small = partly if last else partly.where(F.col("__n") <= edge)
        ranked = Window.partitionBy(*group).orderBy(digest, *tie)
        out.append(small.withColumn("__rn", F.row_number().over(ranked)).where("__rn <= __left").select(*columns))
        if last or cells.where((F.col("__n") > F.col("__left")) & (F.col("__n") > edge)).isEmpty():
            return reduce(DataFrame.unionByName, out)
        # The cells that are left become the keys of the next round, with what they may still give.
        depth += DIGITS
        rows = partly.where(F.col("__n") > edge).select(*columns, F.col("__left").alias("__need"), *(F.col(c) for c in group if c.startswith("__cell")))
        outer = list(group)
        finer = f"__cell{depth}"
        rows = rows.withColumn(finer, F.substr(F.col(digest), F.lit(1), F.lit(depth)))
        group = [*group, finer]

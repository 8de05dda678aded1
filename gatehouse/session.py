"""Session helpers: shared scratch folders and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir`` setting.

    Where it is unset on one machine (master ``local``), as in tests, a new temporary
    folder is made and set for the session; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="gatehouse-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint a frame that several branches read, so that it is computed once.

    The data lives in the shared checkpoint folder and outlasts lost executors.
    """
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """A freshly read table, spread over all cores when it has fewer splits than cores.

    A large table has more splits than the cluster has cores and comes back as it
    is.  Only for plain scans: the split count is then known without running a job.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, *keys)


BROADCAST_ROWS = 2_000_000
"""Most key rows a broadcast may hold."""

BROADCAST_BYTES = 64_000_000
"""Most bytes of their values, as text, that a broadcast may hold."""


def broadcast_if_small(keys: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Computed key rows, marked for broadcast only when counted below both bounds.

    Spark plans a join from estimates, which are far too high for the few keys an
    expensive filter lets through; it would shuffle the large side for nothing.
    Beyond a bound the keys come back unmarked and Spark shuffles both sides.  Rows
    and bytes are counted by an aggregate, in parallel.
    """
    stored = materialise(keys)
    width = reduce(Column.__add__, (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(1)) for c in stored.columns))
    found = stored.agg(F.count("*").alias("n"), F.sum(width.cast("bigint")).alias("bytes")).first()
    return F.broadcast(stored) if found.n <= max_rows and (found.bytes or 0) <= max_bytes else stored


GROUP_ROWS = 100_000
"""Most rows that may be collected into one value, such as the tasks of a batch."""

GROUP_BYTES = 64_000_000
"""Most bytes of text that may be collected into one value."""


def require_bounded(rows: DataFrame, keys: Sequence[str], payload: Column, max_rows: int = GROUP_ROWS, max_bytes: int = GROUP_BYTES) -> DataFrame:
    """``rows``, checked: no group of ``keys`` has more rows or ``payload`` bytes than may be collected into one value.

    Groups are counted by an aggregate with map-side combine; a group beyond a bound is an
    error that names it, before any task collects it.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.octet_length(payload).cast("bigint")).alias("bytes"))
    worst = sizes.where((F.col("n") > max_rows) | (F.col("bytes") > max_bytes)).first()
    if worst is not None:
        raise ValueError(f"{dict(zip(keys, worst))} has {worst.n} rows with {worst.bytes} bytes; at most {max_rows} rows and {max_bytes} bytes become one value")
    return rows

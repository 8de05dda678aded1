"""A table with one current row per key, fed by micro-batches.

Each micro-batch writes only its own newest rows, as one folder of level 0.  Every
``FAN`` folders of a level are merged into one folder of the next level, so that over time
a row is written about once per level and the table has ``FAN`` folders per level at most.
What is written depends on the batch number alone: a batch that runs again after a failure
replaces its own folder and finishes the merge that it had begun.  Folders that a merge has
replaced stay for one more batch, for readers that are under way, and are then removed.
Rows older than ``ttl`` leave the table when they are merged, and are never returned.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

FAN = 8
"""Folders of a level that become one of the next."""

BATCH = "__batch"


class KeyedTable:
    """Rows under ``path`` by ``keys``; of a key's rows the greatest by ``order`` counts, then that of the latest batch.

    With ``ttl`` (an interval text) rows whose ``time`` lies that far behind the latest one
    are dropped.
    """

    def __init__(self, path: str, schema: StructType, keys: Sequence[str], order: Sequence[str] = (), time: str | None = None, ttl: str | None = None):
        self.path, self.schema, self.keys, self.order = path.rstrip("/"), schema, list(keys), list(order)
        self.time, self.ttl = time, ttl

    # --- folders -----------------------------------------------------------------
    def _files(self, spark: SparkSession):
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(spark._jsc.hadoopConfiguration()), root

    def folders(self, spark: SparkSession) -> list[tuple[int, int]]:
        """(level, batch) of every folder that was written to its end."""
        fs, root = self._files(spark)
        found = []
        for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "level=*/batch=*/_SUCCESS")) or []:
            level, batch = re.search(r"level=(\d+)/batch=(\d+)/_SUCCESS$", status.getPath().toString()).groups()
            found.append((int(level), int(batch)))
        return sorted(found)

    def _folder(self, level: int, batch: int) -> str:
        return f"{self.path}/level={level}/batch={batch}"

    def _load(self, spark: SparkSession, folders: Sequence[tuple[int, int]]) -> DataFrame:
        stored = StructType([*self.schema.fields, *spark.range(0).select(F.lit(0).cast("bigint").alias(BATCH)).schema.fields])
        return spark.read.schema(stored).parquet(*(self._folder(*f) for f in folders))

    # --- rows --------------------------------------------------------------------
    def newest(self, rows: DataFrame) -> DataFrame:
        """One row per key, with map-side combine."""
        rest = [c for c in rows.columns if c not in self.keys]
        by = F.struct(*self.order, BATCH)
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), by).alias("__row")).select(*self.keys, "__row.*").select(*rows.columns)

    def _alive(self, rows: DataFrame, horizon) -> DataFrame:
        return rows if horizon is None else rows.where(F.col(self.time) >= F.lit(horizon))

    def _horizon(self, rows: DataFrame):
        """The oldest time that is kept: the latest one less ``ttl``."""
        if self.ttl is None:
            return None
        return rows.agg((F.max(self.time) - F.expr(f"INTERVAL '{self.ttl}'")).alias("h")).first().h

    def write(self, batch: DataFrame, number: int) -> None:
        """Take in micro-batch ``number``."""
        spark = batch.sparkSession
        self._remove(spark, number)
        rows = batch.select(*self.schema.names).withColumn(BATCH, F.lit(number).cast("bigint"))
        self.newest(rows).write.mode("overwrite").parquet(self._folder(0, number))
        level, span = 0, FAN
        while (number + 1) % span == 0:
            there = self.folders(spark)
            if (level + 1, number) not in there:
                parts = [f for f in there if f[0] == level and number - span < f[1] <= number]
                # Without state of their own, merges take the horizon from the rows they see.
                merged = self.newest(self._load(spark, parts))
                self._alive(merged, self._horizon(self._load(spark, there))).write.mode("overwrite").parquet(self._folder(level + 1, number))
            level, span = level + 1, span * FAN

    def _remove(self, spark: SparkSession, number: int) -> None:
        """Folders that a merge of an earlier batch has replaced."""
        fs, _ = self._files(spark)
        there = self.folders(spark)
        for level, batch in there:
            span = FAN ** (level + 1)
            home = batch // span * span + span - 1
            if home < number and (level + 1, home) in there:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(self._folder(level, batch)), True)

    def read(self, spark: SparkSession) -> DataFrame:
        """The current row of every key."""
        there = self.folders(spark)
        if not there:
            return spark.createDataFrame([], self.schema)
        stored = self._load(spark, there)
        return self._alive(self.newest(stored), self._horizon(stored)).drop(BATCH)


def upsert_stream(rows: DataFrame, table: KeyedTable, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Feed a stream into a table until the available input is read.

    In ``update`` mode an aggregation hands over each window whenever it changes, so that
    windows still open when the input ends are in the table as well.
    """
    return (rows.writeStream.foreachBatch(table.write).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

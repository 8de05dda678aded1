"""Writers: JSON lines or Parquet, partitioned by run where that helps readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> str:
    """Write and return the path."""
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def write_results(results: DataFrame, path: str, partition_by: Sequence[str] = (), keys: Sequence[str] = (), folders: int = 64, **options) -> str:
    """(task_id, answer) rows as JSON lines.

    ``partition_by`` is for columns with few values, such as a date: each value is a folder.
    ``keys``, such as a run, may have any number of values: they stay in the rows, which go to
    ``folders`` folders named ``part=...`` by the hash of their keys, so that a reader of one
    key opens one folder.  A key with many rows is written by several tasks.
    """
    rows = results.select("task_id", "answer", *keys, *partition_by)
    if keys:
        rows = rows.withColumn("part", folder_of(folders, *keys)).repartition("part", F.pmod(F.xxhash64("task_id"), F.lit(SLICES)))
        partition_by = [*partition_by, "part"]
    return write_table(rows, path, "json", partition_by, **options)


SLICES = 8
"""Tasks, and so files, that write a folder of results."""


def folder_of(folders: int, *keys: str) -> Column:
    """Number of the folder that holds the rows of a key."""
    return F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int")


def write_report(report: DataFrame, path: str, **options) -> str:
    """A report with one row per category as JSON lines."""
    return write_table(report, path, "json", **options)


def nested_report(report: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per run with ``by_category`` as a map; a run has few categories."""
    cell = F.struct("total", "passed", "failed", "pass_rate")
    rows = report.where(F.col("category") != "(all)")
    overall = report.where(F.col("category") == "(all)").select(*keys, "total", "passed", "failed", "pass_rate")
    maps = rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct(F.col("category"), cell)))).alias("by_category"))
    return overall.join(maps, list(keys))


def write_chat_rows(rows: DataFrame, path: str, **options) -> str:
    """(messages, family) rows as JSON lines."""
    return write_table(rows.select("messages", "family"), path, "json", **options)

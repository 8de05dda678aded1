"""Readers.

Files are JSON lines by default, which Spark splits across tasks.  ``array=True``
reads whole-file JSON arrays, one file per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import presence
from ..session import broadcast_if_small, materialise
from . import schemas as S
from .leaderboard import flatten_leaderboard  # noqa: F401


def _json(spark: SparkSession, path: str | list[str], schema: str, array: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", array).json(path)


def read_tasks(spark: SparkSession, path: str | list[str], array: bool = False, strict: bool = True) -> DataFrame:
    """Tasks with trimmed ids.  Strict reading fails on an empty id when the rows
    are consumed; lenient reading keeps such rows with a NULL id."""
    rows = _json(spark, path, S.TASK, array).withColumn("task_id", presence(F.col("task_id")))
    if not strict:
        return rows
    checked = F.coalesce("task_id", F.raise_error(F.lit("task with empty task_id")).cast("string"))
    return rows.withColumn("task_id", checked)


def split_quarantine(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable tasks, and the rows without an id."""
    return tasks.where(F.col("task_id").isNotNull()), tasks.where(F.col("task_id").isNull())


def read_golden(spark: SparkSession, path: str | list[str], array: bool = False, lenient: bool = True) -> DataFrame:
    """Golden cases.  Lenient reading skips rows without an id or an expected text
    and takes ``contains_ci`` where no validator is named."""
    rows = _json(spark, path, S.GOLDEN, array)
    if not lenient:
        return rows
    rows = rows.withColumn("task_id", presence(F.col("task_id"))).withColumn(
        "validate", F.coalesce(presence(F.col("validate")), F.lit("contains_ci")))
    return rows.where(F.col("task_id").isNotNull() & presence(F.col("expected")).isNotNull())


def in_file_order(rows: DataFrame, file: str = "file", start: str = "__start", out: str = "pos") -> DataFrame:
    """Add ``out``, the place of each row in its file from 0, whatever splits the file was read in.

    ``rows`` are the unfiltered rows of a scan with the file and the start of the block they
    were read from.  Rows of a block come in order and together, so a row's place in the block
    is its distance from the block's first row; the counts of earlier blocks of the file,
    one row per block, are added.
    """
    numbered = materialise(rows.withColumn("__at", F.monotonically_increasing_id()))
    blocks = numbered.groupBy(file, start).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(file).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    offsets = broadcast_if_small(blocks.select(file, start, "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")))
    return numbered.join(offsets, [file, start]).withColumn(out, F.col("__before") + F.col("__at") - F.col("__first")).drop(
        start, "__at", "__first", "__before")


def read_archive(spark: SparkSession, path: str | list[str], array: bool = False) -> DataFrame:
    """Verdict archive rows with the file they came from and their place in it."""
    rows = _json(spark, path, S.PROBE, array)
    return in_file_order(rows.select(
        F.col("ID").alias("task_id"), F.col("Cat").alias("category"), F.col("Answer").alias("answer"),
        F.col("Via").alias("via"), F.col("Reason").alias("reason"), F.col("Pass").alias("pass"),
        F.col("GenTokens").alias("gen_tokens"), F.col("GenMS").alias("gen_ms"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start")))


def read_chat_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _json(spark, path, S.CHAT, False)


CORRUPT = "_corrupt"


def read_telemetry(spark: SparkSession, path: str | list[str], array: bool = False) -> dict[str, DataFrame]:
    """Uploads as tables: tasks, answers, calls, traces, and what could not be read, each with its upload file.

    A broken upload costs no other: it goes to ``broken`` with its text.
    """
    text = spark.read.text(path, wholetext=array).select(F.col("_metadata.file_name").alias("upload"), "value")
    if array:
        parsed = text.withColumn("all", F.from_json("value", f"ARRAY<STRUCT<{S.UPLOAD}>>"))
        rows = parsed.select("upload", F.when(F.col("all").isNull(), F.col("value")).alias(CORRUPT), F.explode_outer("all").alias("u"))
    else:
        rows = text.select("upload", F.from_json("value", f"{S.UPLOAD}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT}).alias("u")).withColumn(
            CORRUPT, F.col(f"u.{CORRUPT}"))
    return telemetry_tables(rows.select("upload", CORRUPT, "u.tasks", "u.results", "u.metrics", "u.label"))


def telemetry_tables(uploads: DataFrame) -> dict[str, DataFrame]:
    """The projections of (tasks, results, metrics, label, upload) rows.  ``call`` numbers the calls of an upload."""
    own = ["upload", "label"]
    good = uploads.where(F.col(CORRUPT).isNull()) if CORRUPT in uploads.columns else uploads
    task = good.select(*own, F.explode("tasks").alias("t")).select(*own, "t.*")
    answer = good.select(*own, F.explode("results").alias("r")).select(*own, "r.*")
    call = good.select(*own, F.posexplode("metrics.call_records").alias("call", "c")).select(*own, "call", "c.*")
    trace = call.select(*own, "call", "turn", "task_ids", F.explode("tool_traces").alias("t")).select(*own, "call", "turn", "task_ids", "t.*")
    tables = {"tasks": task, "answers": answer, "calls": call, "traces": trace}
    return tables | {"broken": uploads.where(F.col(CORRUPT).isNotNull()).select("upload", F.col(CORRUPT).alias("text"))} if CORRUPT in uploads.columns else tables


def catalog_task_sets(spark: SparkSession, path: str | list[str], array: bool = False,
                      exclude: tuple[str, ...] = ("golden.json",), file: Column | None = None) -> DataFrame:
    """Per file: task count and whether its first task states an expected answer.

    ``file`` names a set from the file's path, by default its last part; sets named in
    ``exclude`` are left out.
    """
    name = F.regexp_extract("__path", "([^/]+)$", 1) if file is None else file
    rows = _json(spark, path, S.GOLDEN, array).select("expected", F.col("_metadata.file_path").alias("__path"), F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    named = rows.withColumn("file", name).drop("__path")
    return catalog_rows(named.where(~F.col("file").isin(*exclude)))


def catalog_rows(rows: DataFrame) -> DataFrame:
    """Task sets of (file, place, expected) rows."""
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("count"), F.min_by(F.col("expected").isNotNull(), "place").alias("has_expected")
    ).withColumn("name", F.regexp_replace("file", r"\.json$", ""))

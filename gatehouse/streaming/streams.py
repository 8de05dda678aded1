"""Structured Streaming operators over call, event and answer files.

Each function takes a streaming (or batch) DataFrame and returns one, so a batch
run over the same files is the expected value of a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.gates import gate
from ..sources import schemas
from .keyed import KeyedTable, upsert_stream


def stream_events(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None,
                  time: str = "ts") -> DataFrame:
    """File stream with an explicit schema; the time column becomes a TIMESTAMP,
    because event-time operators refuse TIMESTAMP_NTZ."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withColumn(time, F.col(time).cast("timestamp"))


def event_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """Event lines parsed: run, seq, type, timestamp, data (VARIANT), and ``broken``, the text of a line that is no event.

    An event has a type.  Works on batches and streams alike.
    """
    schema = f"{schemas.EVENT}, __broken STRING"
    e = F.from_json(F.col(value), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    rows = lines.withColumn("__event", e)
    bad = F.col("__event.__broken").isNotNull() | F.col("__event.type").isNull()
    names = ["run", "seq", "type", "timestamp", "data"]
    return rows.select(*(F.when(~bad, F.col(f"__event.{n}")).alias(n) for n in names), F.when(bad, F.col(value)).alias("broken"))


def stream_event_rows(spark: SparkSession, path: str, events: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None],
                      checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
    """Event lines from files into two sinks: events with their data as JSON text, and lines that are none."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def split(batch: DataFrame, batch_id: int) -> None:
        rows = event_rows(batch)
        events(rows.where("broken IS NULL").drop("broken").withColumn("data", F.to_json("data")), batch_id)
        dead(rows.where("broken IS NOT NULL").select("broken"), batch_id)

    return (reader.load(path).writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def event_gaps(events: DataFrame) -> DataFrame:
    """(run, after, missing): places where numbers of a run's events are missing, and how many.

    The event after a gap is found by number, not by a window over the run: only numbers
    without a successor, and without a predecessor, are put side by side.
    """
    seen = events.where("run IS NOT NULL AND seq IS NOT NULL").select("run", "seq").distinct()
    last = seen.join(seen.select("run", (F.col("seq") - 1).alias("seq")), ["run", "seq"], "left_anti")
    first = seen.join(seen.select("run", (F.col("seq") + 1).alias("seq")), ["run", "seq"], "left_anti")
    # Ends and starts of stretches alternate, so the k-th end meets the start after it.
    ends = last.select("run", F.col("seq").alias("at"), F.lit(False).alias("start")).unionByName(first.select("run", F.col("seq").alias("at"), F.lit(True).alias("start")))
    order = Window.partitionBy("run").orderBy("at", F.desc("start"))
    return ends.withColumn("next", F.lead("at").over(order)).where("NOT start AND next IS NOT NULL").select(
        "run", F.col("at").alias("after"), (F.col("next") - F.col("at") - 1).alias("missing"))


def stream_gate(answers: DataFrame, accepted: Callable[[DataFrame, int], None],
                rejected: Callable[[DataFrame, int], None], checkpoint: str, families: list[str] | None = None) -> StreamingQuery:
    """Gate an answer stream and hand each micro-batch to two sinks.

    The batch is gated once and kept for both sinks, which get the batch id so
    that a repeated batch can replace its first copy.
    """
    def split(batch: DataFrame, batch_id: int) -> None:
        gated = gate(batch, families=families).persist()
        accepted(gated.where("accepted"), batch_id)
        rejected(gated.where(~F.col("accepted")), batch_id)
        gated.unpersist()

    return (answers.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def usage_windows(calls: DataFrame, delay: str = "1 hour", length: str = "1 hour", slide: str | None = None,
                  keys: Sequence[str] = ("model",)) -> DataFrame:
    """Tumbling or sliding token and error totals; late rows beyond ``delay`` are dropped."""
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    return calls.withWatermark("ts", delay).groupBy(win, *keys).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"),
        F.count_if("error").alias("errors"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
             *keys, "calls", "tokens", "errors")


stream_usage = usage_windows


def sessions(events: DataFrame, gap: str = "2 hours", delay: str = "1 hour",
             keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Runs rebuilt as sessions that end after a gap of inactivity."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("session"), *keys).agg(
        F.count(F.lit(1)).alias("events"),
    ).select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
             *keys, "events")


stream_sessions = sessions


def close_out(written: DataFrame, rows: DataFrame, windows: Callable[[DataFrame], DataFrame], end: str = "window_end",
              delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """What an append stream has written, and the windows or sessions still open when its input ended.

    ``rows`` are the stream's rows as a batch and ``windows`` is its operator with the same
    ``delay``.  Append mode writes what ends at the last watermark or before, so the tail is
    what ends later.  Late rows that the stream dropped count in the tail where it spans them.
    """
    mark = rows.agg((F.date_trunc("millisecond", F.max(time)) - F.expr(f"INTERVAL '{delay}'")).alias("__mark"))
    tail = windows(rows).crossJoin(F.broadcast(mark)).where(F.col(end) > F.col("__mark")).drop("__mark")
    return written.unionByName(tail)


def stream_dedup(events: DataFrame, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Drop records uploaded again within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def latest_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select(*keys, "r.*")


def stream_latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str,
                  time: str | None = None, ttl: str | None = None) -> tuple[StreamingQuery, KeyedTable]:
    """Latest row per key, kept in a :class:`~gatehouse.streaming.keyed.KeyedTable`.

    A micro-batch writes about as much as it brings.  Keys whose ``time`` lies more than
    ``ttl`` behind the latest one leave the table.
    """
    table = KeyedTable(path, rows.schema, keys, order, time, ttl)
    return upsert_stream(rows, table, checkpoint), table


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet until the available files are read."""
    return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Parquet sink with one folder per micro-batch; a repeated batch overwrites its own."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write

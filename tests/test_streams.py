"""Streams over several files equal the batch result, late rows included."""

import datetime as dt

from pyspark.sql import functions as F

from gatehouse.streaming import streams as S
from gatehouse.streaming.keyed import KeyedTable, upsert_stream

SCHEMA = "call_id BIGINT, ts TIMESTAMP, model STRING, tokens BIGINT, error BOOLEAN"


def write(spark, path, rows, part):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/part={part}")


def calls(n, start=0):
    t0 = dt.datetime(2024, 1, 1)
    return [(i, t0 + dt.timedelta(minutes=7 * i), "ab"[i % 2], i % 13, i % 5 == 0) for i in range(start, start + n)]


def run(spark, stream, tmp_path, name):
    q = S.run_to_table(stream, str(tmp_path / name), str(tmp_path / (name + "-state")))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_usage_equals_batch_for_closed_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = calls(300)
    shuffled = rows[:100] + rows[104:200] + rows[100:104] + rows[200:]  # four rows arrive late, within the delay
    for k in range(3):
        write(spark, src, shuffled[k * 100:(k + 1) * 100], k)
    stream = S.stream_events(spark, src + "/*", SCHEMA, files_per_trigger=1)
    got = run(spark, S.usage_windows(stream, delay="12 hours"), tmp_path, "usage")
    closed = max(r[1] for r in rows) - dt.timedelta(hours=12)
    batch = S.usage_windows(spark.createDataFrame(rows, SCHEMA), delay="12 hours").where(F.col("window_end") <= F.lit(closed))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.count() > 0


def test_close_out_leaves_no_row_behind(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = calls(300)
    for k in range(3):
        write(spark, src, rows[k * 100:(k + 1) * 100], k)
    batch = spark.createDataFrame(rows, SCHEMA)
    cases = {"usage": (S.usage_windows, "window_end", "calls", 300), "sliding": (lambda r: S.usage_windows(r, slide="15 minutes"), "window_end", "calls", 1200),
             "sessions": (lambda r: S.sessions(r, keys=["model"]), "session_end", "events", 300)}
    for name, (windows, end, count, total) in cases.items():
        stream = windows(S.stream_events(spark, src + "/*", SCHEMA, files_per_trigger=1))
        written = run(spark, stream, tmp_path, name)
        whole = S.close_out(written, batch, windows, end)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, windows(batch).collect()))
        assert whole.agg(F.sum(count)).first()[0] == total and written.count() < whole.count()


def test_latest_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = calls(90)
    for k in range(3):
        write(spark, src, rows[k * 30:(k + 1) * 30], k)
    stream = S.stream_events(spark, src + "/*", SCHEMA, files_per_trigger=1).select("model", "call_id", "ts")
    q, table = S.stream_latest(stream, ["model"], ["ts", "call_id"], str(tmp_path / "latest"), str(tmp_path / "state"))
    q.awaitTermination()
    assert {r.model: r.call_id for r in table.read(spark).collect()} == {"a": 88, "b": 89}


def test_open_windows_are_in_the_table(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = calls(300)
    for k in range(3):
        write(spark, src, rows[k * 100:(k + 1) * 100], k)
    stream = S.usage_windows(S.stream_events(spark, src + "/*", SCHEMA, files_per_trigger=1))
    table = KeyedTable(str(tmp_path / "usage"), stream.schema, ["window_start", "model"])
    upsert_stream(stream, table, str(tmp_path / "state"), "update").awaitTermination()
    assert sorted(map(tuple, table.read(spark).collect())) == sorted(map(tuple, S.usage_windows(spark.createDataFrame(rows, SCHEMA)).collect()))


def keyed_batches(spark, n):
    """Each batch brings a new key and a new row of an old one."""
    t0 = dt.datetime(2024, 1, 1)
    return [spark.createDataFrame([(k, t0 + dt.timedelta(days=k), k), (k // 2, t0 + dt.timedelta(days=k), 1000 + k)], "key INT, ts TIMESTAMP, value INT") for k in range(n)]


def size(table, level, batch):
    import pathlib
    return sum(f.stat().st_size for f in pathlib.Path(f"{table.path}/level={level}/batch={batch}").glob("*.parquet"))


def test_keyed_table_merges_removes_and_survives_restarts(spark, tmp_path):
    batches = keyed_batches(spark, 20)
    table = KeyedTable(str(tmp_path / "t"), batches[0].schema, ["key"], ["ts"])
    again = KeyedTable(str(tmp_path / "again"), batches[0].schema, ["key"], ["ts"])
    for k, b in enumerate(batches):
        table.write(b, k)
        again.write(b, k)
        if k in (7, 8, 15, 16):  # the batch runs once more, as after a failure
            again.write(b, k)
    want = {}
    for k, b in enumerate(batches):
        for r in b.collect():
            if r.key not in want or (r.ts, k) >= want[r.key][:2]:
                want[r.key] = (r.ts, k, r.value)
    for t in (table, again):
        assert {r.key: r.value for r in t.read(spark).collect()} == {key: v[2] for key, v in want.items()}
        assert t.folders(spark) == [(0, 16), (0, 17), (0, 18), (0, 19), (1, 7), (1, 15)]
    assert size(table, 0, 19) <= 1.2 * size(table, 0, 16)  # what a batch writes does not follow the table


def test_keyed_table_finishes_a_merge_it_had_begun(spark, tmp_path):
    batches = keyed_batches(spark, 9)
    table = KeyedTable(str(tmp_path / "t"), batches[0].schema, ["key"], ["ts"])
    for k, b in enumerate(batches[:8]):
        table.write(b, k)
    whole = sorted(map(tuple, table.read(spark).collect()))
    (tmp_path / "t" / "level=1" / "batch=7" / "_SUCCESS").unlink()  # as if the merge had not ended
    assert sorted(map(tuple, table.read(spark).collect())) == whole
    table.write(batches[7], 7)
    assert sorted(map(tuple, table.read(spark).collect())) == whole and (1, 7) in table.folders(spark)
    table.write(batches[8], 8)
    assert table.folders(spark) == [(0, 8), (1, 7)]


def test_keyed_table_forgets_what_is_old(spark, tmp_path):
    batches = keyed_batches(spark, 9)
    table = KeyedTable(str(tmp_path / "t"), batches[0].schema, ["key"], ["ts"], "ts", "3 days")
    for k, b in enumerate(batches):
        table.write(b, k)
    latest = {}
    for b in batches:
        for r in b.collect():
            latest[r.key] = max(latest.get(r.key, (r.ts, 0)), (r.ts, r.value))
    end = max(t for t, _ in latest.values())
    assert {r.key for r in table.read(spark).collect()} == {k for k, (t, _) in latest.items() if t >= end - dt.timedelta(days=3)}
    assert spark.read.parquet(f"{table.path}/level=1").count() < len(latest)
    assert KeyedTable(str(tmp_path / "none"), batches[0].schema, ["key"]).read(spark).count() == 0


def test_dedup_drops_reuploads(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = calls(60)
    write(spark, src, rows[:40], 0)
    write(spark, src, rows[30:], 1)
    stream = S.stream_events(spark, src + "/*", SCHEMA, files_per_trigger=1)
    got = run(spark, S.stream_dedup(stream, ["call_id"], "12 hours").select("call_id"), tmp_path, "dedup")
    assert sorted(r.call_id for r in got.collect()) == list(range(60))


def test_gate_stream_splits(spark, tmp_path):
    rows = [("maths", "p", "12"), ("maths", "p", "none"), ("logical", "p", "no")]
    src = str(tmp_path / "in")
    schema = "family STRING, prompt STRING, answer STRING"
    spark.createDataFrame(rows, schema).write.parquet(src)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    S.stream_gate(spark.readStream.schema(schema).parquet(src), S.batch_sink(good), S.batch_sink(bad),
                  str(tmp_path / "state")).awaitTermination()
    assert [r.answer for r in spark.read.parquet(good).collect()] == ["12"]
    assert sorted(r.reason for r in spark.read.parquet(bad).collect()) == ["no_number", "too_short"]

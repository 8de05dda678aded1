"""Readers: order in files, broken uploads, event gaps and leaderboards of any shape."""

import json

from pyspark.sql import functions as F

from gatehouse.sources import readers
from gatehouse.streaming import streams


def archive_rows(spark, path):
    return sorted((r.file.rsplit("/", 1)[1], r.pos, r.task_id) for r in readers.read_archive(spark, path).select("file", "pos", "task_id").collect())


def test_archive_positions_do_not_follow_splits(spark, tmp_path):
    want = []
    for f in ("a", "b"):
        lines = [json.dumps({"ID": f"{f}{i}", "Answer": "x" * (i % 40)}) for i in range(500)]
        (tmp_path / f"{f}.json").write_text("\n".join(lines))
        want += [(f"{f}.json", i, f"{f}{i}") for i in range(500)]
    (tmp_path / "c.json").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("700b", "5k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            assert archive_rows(spark, str(tmp_path / "*.json")) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_archive_of_arrays(spark, tmp_path):
    for f in ("a", "b"):
        (tmp_path / f"{f}.json").write_text(json.dumps([{"ID": f"{f}{i}"} for i in range(5)]))
    got = sorted((r.file.rsplit("/", 1)[1], r.pos, r.task_id) for r in readers.read_archive(spark, str(tmp_path), array=True).collect())
    assert got == [(f"{f}.json", i, f"{f}{i}") for f in "ab" for i in range(5)]


def test_broken_uploads_cost_no_other(spark, tmp_path):
    upload = {"label": "l", "tasks": [{"task_id": "1", "prompt": "p"}, {"task_id": "2", "prompt": "q"}],
              "metrics": {"call_records": [{"turn": 1, "tool_traces": [{"index": 0, "code": "c"}, {"index": 1, "code": "d", "error": "e"}]}, {"turn": 2, "messages": {"any": [1, "x"]}}]}}
    lines, whole = tmp_path / "lines", tmp_path / "whole"
    lines.mkdir()
    whole.mkdir()
    (lines / "a.json").write_text(json.dumps(upload) + "\n" + json.dumps(upload)[:-5] + "\n")
    (whole / "a.json").write_text(json.dumps([upload], indent=1))
    (whole / "b.json").write_text(json.dumps(upload)[:-5])
    for path, array in ((lines, False), (whole, True)):
        t = readers.read_telemetry(spark, str(path), array)
        assert sorted(r.task_id for r in t["tasks"].collect()) == ["1", "2"] and t["answers"].count() == 0
        assert [(r.call, r.turn, r["index"], r.code, r.error) for r in t["traces"].orderBy("index").collect()] == [(0, 1, 0, "c", None), (0, 1, 1, "d", "e")]
        assert len(t["calls"].columns) == 2 + 1 + 19
        assert t["calls"].where("turn = 2").select(F.to_json("messages").alias("m")).first().m == '{"any":[1,"x"]}'
        assert t["broken"].count() == 1 and t["broken"].first().text.startswith("{")


def test_event_gaps(spark):
    rows = [("a", 1), ("a", 2), ("a", 2), ("a", 5), ("a", 7), ("a", 8), ("b", 3), (None, 4), ("c", None)]
    got = {tuple(r) for r in streams.event_gaps(spark.createDataFrame(rows, "run STRING, seq BIGINT")).collect()}
    assert got == {("a", 2, 2), ("a", 5, 1)}


def test_lines_that_are_no_events(spark):
    lines = ['{"run":"r","seq":1,"type":"t","timestamp":"2024-01-01T00:00:00Z","data":{"a":[1,{"b":null}]}}', '{"run":"r"}', "no json", "", None, '{"type":"x","data":3}']
    rows = streams.event_rows(spark.createDataFrame([(x,) for x in lines], "value STRING")).withColumn("data", F.to_json("data")).collect()
    assert [(r.type, r.data) for r in rows if r.type] == [("t", '{"a":[1,{"b":null}]}'), ("x", "3")]
    assert sorted(r.broken for r in rows if r.broken is not None) == sorted(['{"run":"r"}', "no json", ""])


def flat(spark, *payloads):
    rows = spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "key INT, payload STRING")
    return readers.flatten_leaderboard(rows).orderBy("key", "source_path", "id").collect()


def test_leaderboard_shapes(spark):
    deep = {"a": {"name": "A", "rankBy": "x", "b": {"rank_by": "y", "c": {"track": 7, "Leaderboard": [{"name": "deep"}, None, 3]}}}}
    got = flat(spark, deep, [{"title": "top"}], "not json", None, {"entries": []}, {"x": {"rows": [{"id": "i"}]}, "y": [[{"z": 1}]]},
               {"results": [{"name": "kept", "submissions": [{"name": "inner"}]}], "other": [{"name": "left out"}]},
               {"list": [{"name": "T", "entries": [{"team": {"title": "TT"}, "user": {"username": "u"}, "score_label": "1,250 tokens"}, {"team": "plain", "name": "n"}]}]})
    assert [(r.key, r.source_path, r.track, r.track_name, r.rank_by, r["name"], r.id) for r in got] == [
        (0, "a.b.c.Leaderboard", "7", "A", "y", "deep", "a.b.c.Leaderboard-0"), (1, "", None, None, None, "top", "-0"), (5, "x.rows", None, None, None, "Untitled submission", "i"),
        (6, "results", None, None, None, "kept", "results-0"), (7, "list.entries", None, "T", None, "Untitled submission", "list.entries-0"),
        (7, "list.entries", None, "T", None, "n", "list.entries-1")]
    assert (got[4].team, got[4].user, got[4].tokens, got[4].score_label, got[5].team) == ("TT", "u", 1250, "1,250 tokens", "plain")

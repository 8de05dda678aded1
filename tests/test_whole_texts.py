"""Long texts are read to their end, and repeated or missing rows have one defined result."""

import time

import pytest
from pyspark.sql import functions as F

from gatehouse.functions import fixed as V
from gatehouse.functions import text as X
from gatehouse.operators import decontam, gates, routing


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_label_beyond_any_window(spark):
    far = F.lit("x " * 250 + "positive, " + "y " * 2250)
    assert value(spark, X.sentiment_label(far, lenient=True)) == "Positive"
    assert value(spark, X.sentiment_label(far, lenient=True, window=160)) is None


def test_long_list_has_to_be_echoed(spark):
    shown = "[" + ", ".join(map(str, range(200))) + "]"
    assert value(spark, gates.gate_list_echo(F.lit("none"), F.lit(shown))) == "list_not_echoed"
    assert value(spark, gates.gate_list_echo(F.lit(f"It is {shown}."), F.lit(shown))) is None


def test_whole_first_line_has_to_be_echoed(spark):
    line, cut = F.lit("the quick brown fox"), F.lit("the quick br")
    assert value(spark, gates.gate_grounded(cut, line)) == "output_not_echoed"
    assert value(spark, gates.gate_grounded(cut, line, probe_chars=12)) is None


def test_long_answers_are_not_degenerate(spark):
    assert value(spark, gates.flag_degenerate(F.lit("word " * 1000))) is False
    assert value(spark, gates.flag_degenerate(F.lit("word " * 1000), max_chars=1600)) is True


def test_value_near_name_in_long_answers(spark):
    truth = F.array(F.struct(F.lit("a.b(").alias("name"), F.lit("7\\E").alias("value")))
    start = time.time()
    assert value(spark, gates.gate_value_near_name(F.lit("a.b( " * 8000 + "7\\E"), truth)) is None
    assert value(spark, gates.gate_value_near_name(F.lit("7\\E" + "a.b( " * 8000), truth)) == "value_not_near: a.b("
    assert value(spark, gates.gate_value_near_name(F.lit("axb( 7" * 8000), truth)) == "name_absent: a.b("
    assert time.time() - start < 10


def test_echo_in_one_unit_of_many(spark):
    source = F.split(F.lit(" ".join(f"w{i}" for i in range(40))), " ")
    own, echo = F.split(F.lit("some other words that are not in the source"), " "), F.slice(source, 11, 8)
    assert value(spark, X.any_shares_run(source, F.array(own, echo), 8))
    assert not value(spark, X.any_shares_run(source, F.array(own, F.slice(source, 11, 7)), 8))


def test_several_answers_of_a_task_are_one_row(spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "task_id string")
    local = spark.createDataFrame([("a", 1, "first"), ("a", 3, " "), ("a", 2, "last")], "task_id string, pos int, answer string")
    rejects = spark.createDataFrame([("b", "r"), ("b", "s"), ("b", None)], "task_id string, answer string")
    out = routing.merge_answers(tasks, [("local", local)], rejects)
    assert sorted((r.task_id, r.answer, r.source) for r in out.collect()) == [("a", "last", "local"), ("b", "s", "rejected")]


def test_second_attempt_alone_counts(spark):
    rows = spark.createDataFrame([("a", 2, "x", "1", True), ("b", 1, "y", "1 2", False), ("b", 2, "z", "1", True)],
                                 "task_id string, attempt int, answer string, stdout string, ok boolean")
    assert sorted((r.task_id, r.attempt, r.answer, r.ok) for r in routing.accept_retry(rows).collect()) == [("a", 2, "x", True), ("b", 1, "y", False)]


def test_missing_texts_are_no_copies(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "t"), (4, "t")], "doc_id int, text string")
    assert sorted(r.doc_id for r in decontam.first_seen(rows).collect()) == [1, 2, 3]
    assert [(r.copies, r.first_id) for r in decontam.duplicate_prompts(rows).collect()] == [(2, 3)]
    assert sorted(r.doc_id for r in decontam.first_seen(rows.where("text IS NOT NULL")).collect()) == [3]


def test_first_seen_with_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (2, "A"), (1, "A"), (2, "C"), (None, "B"), (None, "D"), (None, "D"), (3, None), (3, None)],
                                 "doc_id BIGINT, text STRING").withColumn("__digest", F.lit("own"))
    got = decontam.first_seen(rows)
    assert got.columns == rows.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [
        ("1", "A"), ("2", "B"), ("2", "C"), ("3", "None"), ("3", "None"), ("None", "D")]


@pytest.mark.parametrize("few", [-1, 3, 64])
def test_searched_and_hashed_runs_agree(spark, monkeypatch, few):
    """Runs of short units are looked for in the source, many by hash; both find the same, on missing and short sides too."""
    monkeypatch.setattr(X, "FEW_RUNS", few)
    rows = [("a b c d e", [["c", "d", "e"]], True), ("a b c d e", [["x"], ["d", "e"], ["b", "c", "d", "f"]], True), ("a b c d e", [["c", "d", "ee"]], False),
            ("aa b c d", [["a", "b", "c"]], False), ("a b", [["a", "b"]], False), ("", [["a", "b", "c"]], False), (None, [["a", "b", "c"]], False),
            ("a b c", [], False), ("a b c", [[]], False), ("a b c d e f g", [list("abx"), list("xyzabcdefg")], True), ("a b c d", [list("bdcaxyz")], False)]
    table = spark.createDataFrame([(i, s if s is None else s.split(), u) for i, (s, u, _) in enumerate(rows)], "i INT, s ARRAY<STRING>, u ARRAY<ARRAY<STRING>>")
    got = [r.found for r in table.select("i", X.any_shares_run(F.col("s"), F.col("u"), 3).alias("found")).orderBy("i").collect()]
    assert got == [want for _, _, want in rows]


def test_each_pivot_marker_is_located_once(spark):
    """The place of a marker is bound; it was worked out six times for each marker."""
    gate = gates.gate_summary_pivot(F.col("p"), F.col("a")).alias("reason")
    plan = spark.createDataFrame([("p", "a")], "p STRING, a STRING").select(gate)._jdf.queryExecution().analyzed().toString()
    assert plan.count("locate(") == len(V.PIVOT_MARKERS)

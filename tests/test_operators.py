"""Operators against brute force on small fixtures, hot keys included."""

import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gatehouse import session
from gatehouse.functions import budgets, code, hashing, numbers, replies, text
from gatehouse.operators import decontam, ordering, pairs, retrieval, rewards, routing, scoring, telemetry
from gatehouse.plans import training
from gatehouse.sources import readers, sinks

c = F.col


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_running_sum_equals_plain_window_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k STRING, pos BIGINT, v BIGINT")
    got = ordering.running_sum(df, ["k"], ["pos"], F.floor(c("pos") / 97), c("v"), "s")
    want, acc = {}, defaultdict(int)
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        acc[k] += v
        want[(k, pos)] = acc[k]
    assert {(r.k, r.pos): r.s for r in got.collect()} == want


def test_first_rows_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.when(c("id") < 900, "hot").otherwise("cold"))
    top = ordering.first_rows(df, ["k"], ["id"], 3)
    assert sorted(r.id for r in top.collect()) == [0, 1, 2, 900, 901, 902]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def archive(spark, rows):
    return spark.createDataFrame(
        [(t, "factual", a, p, "f", i) for i, (t, a, p) in enumerate(rows)],
        "task_id STRING, family STRING, answer STRING, pass BOOLEAN, file STRING, pos INT")


def test_all_rounds_give_each_pair_once(spark):
    rows = [("a", f"g{i}", True) for i in range(7)] + [("a", f"b{i}", False) for i in range(4)]
    rows += [("b", "g", True), ("b", "x", False), ("b", "y", False), ("c", "lonely", True), ("a", "g0", True)]
    rows += [("d", "same", True), ("d", "same", False)]
    got = values(pairs.preference_pairs(archive(spark, rows), rounds=50), "task_id", "chosen", "rejected")
    want = {(t, a, b) for t, a, p in rows for u, b, q in rows if t == u and p and not q and a != b}
    assert Counter(got) == Counter(want)
    paged = [r for d in range(4) for r in values(
        pairs.preference_pairs(archive(spark, rows), rounds=1, first_round=d), "task_id", "chosen", "rejected")]
    assert Counter(paged) == Counter(want)


def test_one_round_uses_every_answer_of_a_hot_task(spark):
    rows = [("hot", f"g{i}", True) for i in range(400)] + [("hot", f"b{i}", False) for i in range(90)]
    got = values(pairs.preference_pairs(archive(spark, rows), rounds=1), "chosen", "rejected")
    assert pairs.preference_pairs(archive(spark, rows)).count() == 400 * 90
    assert len(got) == 400
    assert len({g for g, _ in got}) == 400 and len({b for _, b in got}) == 90


def test_ngram_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(vocab, k=60))) for i in range(40)]
    bench = [(j, " ".join(docs[j][1].split()[5:5 + 6 + j])) for j in range(8)]
    bench += [(j + 8, " ".join(rng.choices(vocab, k=20))) for j in range(4)]
    grams = lambda t: {tuple(t.split()[i:i + 4]) for i in range(len(t.split()) - 3)}
    want = {(d, b): len(grams(x) & grams(y)) for d, x in docs for b, y in bench if grams(x) & grams(y)}
    got = decontam.decontaminate_ngram(spark.createDataFrame(docs, "doc_id INT, text STRING"),
                                       spark.createDataFrame(bench, "item_id INT, text STRING"), 4)
    assert {(r.doc_id, r.item_id): r.shared_grams for r in got.collect()} == want


def test_require_clean_fails_on_a_leak(spark):
    rows = spark.createDataFrame([("t1", "p"), ("t2", "q")], "task_id STRING, prompt STRING")
    with pytest.raises(ValueError):
        decontam.require_clean(rows, spark.createDataFrame([("zz", "q")], rows.schema))
    assert decontam.require_clean(rows, spark.createDataFrame([("zz", "r")], rows.schema)).count() == 2


def test_relevance_counts_substrings(spark):
    docs = spark.createDataFrame([("a", "Concatenate-ion of tables"), ("b", "a cat sat"), ("c", "TABLE tops")], "doc_id STRING, text STRING")
    q = spark.createDataFrame([(1, "cate table cat sat tables table")], "query_id INT, query STRING")
    got = {r.doc_id: r.score for r in retrieval.relevance_join(q, docs).collect()}
    assert got == {"a": 3, "c": 1}
    assert {r.doc_id: r.score for r in retrieval.relevance_join(q, docs, count_repeats=True).collect()} == {"a": 4, "c": 2}
    boosted = {r.doc_id: r.score for r in retrieval.relevance_join(q, docs, preferred=["b"]).collect()}
    assert boosted == {"a": 3, "b": 5, "c": 1}


def test_skip_over_is_greedy(spark):
    rng = random.Random(5)
    rows = [(q, f"d{i:02d}", rng.randrange(9), rng.randrange(1, 60)) for q in range(20) for i in range(12)]
    df = spark.createDataFrame(rows, "query_id INT, doc_id STRING, score INT, n_chars INT")
    got = defaultdict(list)
    for r in retrieval.select_skip_over(df, 50, limit=3).orderBy("query_id", "turn").collect():
        got[r.query_id].append(r.doc_id)
    for q in range(20):
        room, want = 50, []
        for _, d, _s, n in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            if n <= room and len(want) < 3:
                want.append(d)
                room -= n
        assert got[q] == want


def test_plan_batches_folds_and_chunks(spark):
    cats = ["factual_knowledge"] * 5 + ["mathematical_reasoning"] * 2 + ["logical_deductive_reasoning"] * 3
    rows = [("r", i, f"t{i}", cat, "none") for i, cat in enumerate(cats)]
    df = spark.createDataFrame(rows, "run_id STRING, pos INT, task_id STRING, category STRING, effort STRING")
    got = [r.task_ids for r in routing.plan_batches(df, size=4, code_size=2, width=2).orderBy("batch_index").collect()]
    assert got == [["t0", "t1", "t2", "t3"], ["t4", "t5", "t6"], ["t7", "t8"], ["t9"]]
    unfolded = [r.task_ids for r in routing.plan_batches(df, size=40, isolation="none", fold=0).orderBy("batch_index").collect()]
    assert unfolded == [["t0", "t1", "t2", "t3", "t4"], ["t5", "t6", "t7", "t8", "t9"]]


def test_merge_order(spark):
    tasks = spark.createDataFrame([(t,) for t in "abcd"], "task_id STRING")
    make = lambda rows: spark.createDataFrame(rows, "task_id STRING, answer STRING")
    out = routing.merge_answers(tasks, [("local", make([("a", "l"), ("b", "l")])), ("remote", make([("b", "r"), ("a", "  ")]))],
                                make([("c", "j")]))
    assert {r.task_id: (r.answer, r.source) for r in out.collect()} == {
        "a": ("l", "local"), "b": ("r", "remote"), "c": ("j", "rejected"), "d": ("Unable to answer.", "apology")}


def test_golden_checks(spark):
    rows = [("It is 1,470", "1470", "numeric", False), ("It is -3.0", "-3", "numeric", True), ("none", "3", "numeric", False),
            ("Hello", "hell", "contains_ci", True), ("Hello", "hell", "contains_cs", False), ("YES", "yes", "exact", True),
            ("Ann met Bo", "Ann:PERSON, Bo:PERSON", "ner", True), ("Ann", "Ann:PERSON, Bo", "ner", False),
            ("x", "y", "llm", None), ("x", "x", "strange", False)]
    df = spark.createDataFrame(rows, "a STRING, e STRING, k STRING, want BOOLEAN")
    got = df.select(scoring.check_golden(c("a"), c("e"), c("k")).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]
    loose = df.select(scoring.check_golden(c("a"), c("e"), c("k"), commas=True).alias("g")).first()
    assert loose.g is True


def test_md5_split_equals_python(spark):
    import hashlib
    texts = [f"prompt {i} é" for i in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for m in (7, 10, 64):
        got = {r.t: r.m for r in df.select("t", hashing.md5_modulus(c("t"), m).alias("m")).collect()}
        assert got == {t: int(hashlib.md5(t.encode()).hexdigest(), 16) % m for t in texts}


def test_word_cap_repairs(spark):
    p = "Use at most six words per bullet."
    rows = [("- one two three, four five six seven", "- one two three."),
            ("- one two three four which goes on and on", "- one two three four."),
            ("- one two three four of the very end", "- one two three four."),
            ("plain line that is far too long to fit", "plain line that is far too long to fit"),
            ("* short one", "* short one")]
    df = spark.createDataFrame([(p, a, w) for a, w in rows], "p STRING, a STRING, w STRING")
    for r in df.select(text.trim_to_word_cap(c("p"), c("a")).alias("g"), "w").collect():
        assert r.g == r.w


def test_small_functions(spark):
    row = spark.range(1).select(
        numbers.numbers(F.lit("3,200 and 4.50 then 7.")).alias("n"),
        numbers.ratio_answer(F.lit("Divide £3,000 in the ratio of 1:2. What does each get?")).alias("r"),
        replies.verdict(F.lit("no marks")).alias("v"),
        text.front_matter(F.lit("---\nname: 'a'\ndescription: b: c\n---\nz"), F.lit("f")).alias("m"),
        budgets.max_tokens(F.lit(1), F.lit("none"), F.lit(1), F.lit(False)).alias("t"),
        text.ascii_fold(F.lit("a—b…“c” é\t")).alias("f"),
        text.keyword_category(F.lit("If all A are B, are all B A?")).alias("k"),
    ).first()
    assert row.n == [3200.0, 4.5, 7.0]
    assert row.r == "Splitting in the ratio 1:2, the shares are £1,000 and £2,000 respectively."
    assert row.v is None and (row.m.name, row.m.description) == ("a", "b: c")
    assert row.t == 2048 and row.f == 'a-b..."c" ? ' and row.k == "logical_deductive_reasoning"


def test_tool_arguments_and_blocks(spark):
    row = spark.range(1).select(
        code.tool_argument_code(F.lit('{"script": " print(1) "}')).alias("named"),
        code.tool_argument_code(F.lit('"x = 1"')).alias("raw"),
        code.tool_argument_code(F.lit('{"other": 1}')).alias("none"),
        code.action_blocks(F.lit("```js\n# ACT now\n```\n```sql\nx\n```\n```\ny\n```")).alias("acts"),
        replies.best_answers(F.lit("``` `x` ```"), F.array(F.lit("a"))).alias("fenced"),
        replies.best_answers(F.lit("` plain `"), F.array(F.lit("a"))).alias("plain"),
        replies.best_answers(F.lit('{"answers": [{"task_id": "z", "answer": "n"}], "a": "kept", "b": null}'),
                             F.array(F.lit("a"), F.lit("b"))).alias("keyed"),
    ).first()
    assert (row.named, row.raw, row.none) == ("print(1)", "x = 1", None)
    assert [b.code for b in row.acts] == ["# ACT now", "y"]
    assert row.fenced is None and [tuple(a) for a in row.plain] == [("a", "plain")]
    assert [tuple(a) for a in row.keyed] == [("a", "kept")]


def test_rewards(spark):
    rows = [("ner", "We saw Ada Lovelace at NASA.", "PERSON: Ada Lovelace", 0.65), ("sentiment", "p", "Positive. It is a fine shop indeed.", 0.6),
            ("code_fix", "p", "The index is off by one here.\ndef f(x):\n    return x", 0.5),
            ("code_fix", "p", "The index is off by one here.\n```python\ndef f(x):\n    return x\n```", 0.85), ("other", "p", "a", 0.0)]
    df = spark.createDataFrame(rows, "family STRING, prompt STRING, answer STRING, want DOUBLE")
    for r in rewards.reward(df).collect():
        assert r.reward == pytest.approx(r.want), r


def test_sources_read_arrays_and_fail_strictly(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"task_id": " a ", "prompt": "p"}, {"task_id": "b", "prompt": "q"}]')
    assert values(readers.read_tasks(spark, str(tmp_path / "good.json"), array=True), "task_id") == [("a",), ("b",)]
    (tmp_path / "bad.json").write_text('[{"task_id": " ", "prompt": "p"}]')
    with pytest.raises(Exception, match="empty task_id"):
        readers.read_tasks(spark, str(tmp_path / "bad.json"), array=True).collect()
    (tmp_path / "golden.json").write_text('[{"task_id": "z", "prompt": "p", "expected": "e"}]')
    sets = readers.catalog_task_sets(spark, str(tmp_path / "*.json"), array=True)
    assert sorted(values(sets, "name", "count", "has_expected")) == [("bad", 1, False), ("good", 2, False)]


def test_leaderboard_inherits_context(spark):
    payload = '{"tracks":[{"name":"T1","rank_by":"tokens","entries":[{"submission":{"name":"S"},"tokens":5,"rank":"2"}]}]}'
    row = readers.flatten_leaderboard(spark.createDataFrame([(payload,)], "payload STRING")).first()
    assert (row["name"], row.track_name, row.rank_by, row.tokens, row["rank"], row.id) == ("S", "T1", "tokens", 5, 2, "tracks.entries-0")


def test_first_rows_beyond_the_group_limit_with_a_hot_key(spark):
    df = spark.range(9000).select(F.when(c("id") < 8000, "hot").otherwise("cold").alias("k"), F.pmod(c("id") * 7919, F.lit(9001)).alias("v"))
    got = defaultdict(list)
    for k, v, at in values(ordering.first_rows(df, ["k"], [c("v").desc()], 5000, rank="at"), "k", "v", "at"):
        got[k].append((at, v))
    want = defaultdict(list)
    for k, v in values(df, "k", "v"):
        want[k].append(v)
    for k, vs in want.items():
        assert sorted(got[k]) == list(enumerate(sorted(vs, reverse=True)[:5000], 1))


def test_leaderboard_ranks_equal_scores_by_name_and_a_null_board(spark):
    rng = random.Random(3)
    rows = [(None if i % 5 == 0 else "b", f"n{i:04d}", 0.5 if i % 2 else rng.random(), 1 + i % 4 if i % 50 == 0 else None) for i in range(1500)]
    rows += [("b", "none", None, None)]
    df = spark.createDataFrame(rows, "board STRING, name STRING, score DOUBLE, rank INT").selectExpr(
        "*", "CAST(NULL AS BIGINT) AS tokens", "CAST(NULL AS DOUBLE) AS accuracy", "CAST(NULL AS STRING) AS rank_by")
    got = {(b, n): r for b, n, r in values(telemetry.leaderboard_rank(df, mode="score"), "board", "name", "computed_rank")}
    for board in (None, "b"):
        own = sorted((r for r in rows if r[0] == board), key=lambda r: (r[3] is None, r[3] or 0, r[2] is None, -(r[2] or 0) if r[3] is None else 0, r[1]))
        assert [got[(board, r[1])] for r in own] == list(range(1, len(own) + 1))


def test_preference_table_has_prompts_and_leaves_forbidden_tasks_out(spark):
    passage = "'one two three four five six seven eight nine ten'"
    prompts = {t: f"Summarize {t} in exactly three bullet points, each at most 12 words: {passage}" for t in ("a", "b", "c")}
    good, bad = "- x one\n- y two\n- z three", ["- x one", "- x one\n- y two"]
    rows = [(i, t, "summarisation", prompts[t], a) for i, t in enumerate("abc") for a in [good, *bad]]
    answers = spark.createDataFrame(rows, "doc_id BIGINT, task_id STRING, family STRING, prompt STRING, answer STRING")
    passages = spark.createDataFrame([(i, passage) for i in range(3)], "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([(1, "nothing alike")], "item_id BIGINT, text STRING")
    forbidden = spark.createDataFrame([("b", "another"), ("other", prompts["c"])], "task_id STRING, prompt STRING")
    table = training.preference_table(answers, passages, bench, ["summarisation"], forbidden)
    assert sorted(values(table, "task_id", "prompt", "chosen", "rejected")) == sorted(("a", prompts["a"], good, b) for b in bad)
    assert table.where("system IS NULL").isEmpty()


def test_tool_traces_are_a_list_on_the_latest_call(spark):
    calls = spark.createDataFrame([(1, 0, ["a", "b"]), (2, 0, ["a", "b"]), (3, 1, ["a"]), (4, 0, ["b", "a"])], "call_id INT, turn INT, task_ids ARRAY<STRING>")
    traces = spark.createDataFrame([(0, ["a", "b"], 1, "second"), (0, ["a", "b"], 0, "first"), (5, ["a"], 0, "nobody's")], "turn INT, task_ids ARRAY<STRING>, index INT, trace STRING")
    got = {r.call_id: r.traces for r in routing.attach_tool_traces(calls, traces).collect()}
    assert got == {1: None, 2: ["first", "second"], 3: None, 4: None}


def test_median_is_exact_with_a_hot_key_ties_and_nulls(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.choice([None, rng.randrange(-50, 50), rng.randrange(10**9)])) for i in range(2000)]
    rows += [(None, 5), (None, 8), ("none", None)]
    got = {r.k: (r.repeats, r.median) for r in scoring.repeat_variance(spark.createDataFrame(rows, "k STRING, v BIGINT"), ["k"], "v").collect()}
    held = defaultdict(list)
    for k, v in rows:
        held[k].append(v)
    want = {k: (len(vs), statistics.median(x) if (x := [v for v in vs if v is not None]) else None) for k, vs in held.items()}
    assert got == want


def test_a_group_beyond_its_bound_is_an_error(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "yy"), ("b", "z")], "k STRING, v STRING")
    assert session.require_bounded(rows, ["k"], c("v"), max_rows=2, max_bytes=3).count() == 3
    for bounds in ({"max_rows": 1}, {"max_bytes": 2}):
        with pytest.raises(ValueError, match="'k': 'a'"):
            session.require_bounded(rows, ["k"], c("v"), **bounds)


def test_results_of_many_runs_share_folders(spark, tmp_path):
    rows = spark.range(500).select(c("id").cast("string").alias("task_id"), F.lit("x").alias("answer"), F.concat(F.lit("r"), c("id") % 90).alias("run_id"))
    path = sinks.write_results(rows, str(tmp_path / "out"), keys=["run_id"], folders=4)
    back = spark.read.schema("task_id STRING, answer STRING, run_id STRING, part INT").json(path)
    assert sorted(values(back, "task_id", "answer", "run_id")) == sorted(values(rows, "task_id", "answer", "run_id"))
    assert back.select("part").distinct().count() <= 4
    assert back.where(c("part") != sinks.folder_of(4, "run_id")).count() == 0


def test_all_pairs_in_tiles_are_the_rounds_together(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 4)
    rows = [(t, "f", f"{t}{v}{i}", v, "x", i) for t, n_pass, n_fail in (("a", 11, 5), ("b", 3, 9), ("c", 4, 4), ("d", 2, 0)) for v, n in ((True, n_pass), (False, n_fail)) for i in range(n)]
    archive = spark.createDataFrame(rows, "task_id STRING, family STRING, answer STRING, pass BOOLEAN, file STRING, pos INT")
    got = sorted(tuple(r) for r in pairs.preference_pairs(archive).collect())
    assert got == sorted(tuple(r) for r in pairs.preference_pairs(archive, rounds=99).collect()) and len(got) == 55 + 27 + 16
    assert sorted(tuple(r) for r in pairs.preference_pairs(archive, first_round=2).collect()) == [r for r in got if r[2] >= 2]


def test_routing_reads_a_prompt_once_before_the_join(spark):
    """A filter by lane repeats no keyword search, and a caller that wants the lanes alone shuffles no prompt."""
    rows = [("a", "This code contains a bug. What does it evaluate to?", ["code_debugging"]), ("b", "Find the BUG.", ["code_debugging"]),
            ("c", "How many units remain?", ["mathematical_reasoning"]), ("d", "How many units remain?", ["factual_knowledge"]),
            ("e", "What does the code do?", ["code_debugging"]), ("f", None, None), ("g", "Write a function.", [])]
    given = spark.createDataFrame(rows, "task_id STRING, prompt STRING, labels ARRAY<STRING>")
    out = routing.route(given.select("prompt", "task_id"), given.select("task_id", "labels"))
    assert out.columns == ["task_id", "prompt", "top", "keyword", "lane"]
    want = {"a": "code_trace", "b": "assist", "c": "tool", "d": "remote", "e": "code_trace", "f": "remote", "g": "assist"}
    assert {r.task_id: r.lane for r in out.collect()} == want
    alone = given.select("task_id", routing.lane(F.col("prompt"), F.get("labels", F.lit(0))).alias("lane"))
    assert {r.task_id: r.lane for r in alone.collect()} == want
    plan = out.where("lane <> 'remote'").select("task_id", "lane")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(prompt") == 2 and plan.index("Join") < plan.index("Generate") and "prompt" not in plan[:plan.index("Generate")]


def test_pieces_of_hot_tasks_are_the_rounds_together(spark, monkeypatch, tmp_path):
    """Each piece is a file of its own, which holds an answer once and not once a pair."""
    monkeypatch.setattr(pairs, "TILE", 50)
    monkeypatch.setattr(pairs, "TILE_BYTES", 90_000)
    rng = random.Random(5)
    long = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randrange(1500, 2500))).strip()
    rows = [("hot", "f", long(), i < 90, "x", i) for i in range(160)] + [("cold", "f", f"c{i}", i < 3, "x", i) for i in range(8)]
    rows += [("hot", f, "said twice", v, "x", i) for f, v, i in ((None, True, 1), ("g", True, 2), ("g", True, 3), ("g", False, 4))]
    given = spark.createDataFrame(rows, "task_id STRING, family STRING, answer STRING, pass BOOLEAN, file STRING, pos INT")
    want = sorted(map(str, pairs.preference_pairs(given, rounds=999).collect()))
    assert sorted(map(str, pairs.preference_pairs(given).collect())) == want and len(want) == 92 * 71 - 2 + 15
    assert sorted(map(str, pairs.preference_pairs(given, first_round=7).collect())) == sorted(map(str, pairs.preference_pairs(given, rounds=999, first_round=7).collect()))
    pairs.preference_pairs(given).write.parquet(str(tmp_path / "out"))
    written = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert written < 20 * sum(len(r[2]) for r in rows)

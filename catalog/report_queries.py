"""Queries of scoring, reports, comparisons, telemetry and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatehouse.functions import text as X
from gatehouse.operators import gates as G
from gatehouse.operators import scoring as S
from gatehouse.operators import telemetry as T

from .base import duck, query
from .gate_queries import ALL_FAMILIES, FAMILIES, GOLDEN_PASS, _families

c = F.col

CATEGORY = """CASE WHEN task_id LIKE 'su%' THEN 'summarisation' WHEN task_id LIKE 'cd%' THEN 'code_debugging'
  WHEN task_id LIKE 'cg%' THEN 'code_generation' WHEN task_id LIKE 'f%' THEN 'factual' WHEN task_id LIKE 'm%' THEN 'maths'
  WHEN task_id LIKE 's%' THEN 'sentiment' WHEN task_id LIKE 'n%' THEN 'ner' WHEN task_id LIKE 'l%' THEN 'logical' END"""
SCORED_SQL = f"""SELECT task_id, CASE WHEN quality = 1 THEN {GOLDEN_PASS} ELSE false END AS pass,
  CASE WHEN quality = 1 THEN {CATEGORY} ELSE 'unknown' END AS category FROM {duck('golden')}"""


def _scored(x):
    g = x.view("golden")
    results = g.select("task_id", "answer")
    cases = g.where("quality = 1").select("task_id", "expected", "validate")
    return S.score_results(results, cases)


@query(SCORED_SQL)
def score_results(x):
    return _scored(x).select("task_id", "pass", "category")


@query(f"""SELECT task_id, {GOLDEN_PASS} AS pass, {CATEGORY} AS category, CASE WHEN validate = 'llm' THEN 'judge' ELSE 'check' END AS via
FROM (SELECT * REPLACE (CASE WHEN toxic = 0 THEN answer ELSE '' END AS answer) FROM {duck('golden')})""".replace(
    "= try_cast(expected AS DOUBLE)", "= try_cast(expected AS DOUBLE) AND answer <> ''").replace(
    "CAST(regexp_extract", "try_cast(regexp_extract"))
def score_golden(x):
    g = x.view("golden")
    results = g.where("toxic = 0").select("task_id", "answer")
    return S.score_golden(g.select("task_id", "expected", "validate"), results).select("task_id", "pass", "category", "via")


def _report_sql(source: str, extra: str = "") -> str:
    return f"""SELECT coalesce(category, '(all)') AS category, count(*) AS total, count(*) FILTER (pass) AS passed,
  count(*) FILTER (NOT pass) AS failed, count(*) FILTER (pass IS NULL) AS unjudged, avg(CAST(pass AS INTEGER)) AS pass_rate{extra}
FROM ({source}) GROUP BY ROLLUP (category)"""


@query(_report_sql(SCORED_SQL))
def score_report(x):
    return S.score_report(_scored(x))


@query(_report_sql(f"SELECT file AS category, pass, length(answer) AS gen_tokens, doc_id AS gen_ms FROM {duck('archive')}",
                   ", CAST(sum(gen_tokens) AS BIGINT) AS gen_tokens, CAST(sum(gen_ms) AS BIGINT) AS gen_ms"))
def probe_report(x):
    return S.probe_report(x.view("archive").select(c("file").alias("category"), "pass", F.length("answer").alias("gen_tokens"),
                                                   c("doc_id").alias("gen_ms")))


@query(f"SELECT task_id, doc_id FROM {duck('archive')} WHERE NOT pass")
def probe_failures(x):
    return S.probe_failures(x.view("archive")).select("task_id", "doc_id")


FLOOR_SQL = f"""SELECT family, total, passed, pass_rate, floor, coalesce(pass_rate < floor, false) AS low FROM (
  SELECT family, count(*) AS total, count(*) FILTER (reason IS NULL) AS passed, avg(CASE WHEN reason IS NULL THEN 1.0 ELSE 0.0 END) AS pass_rate,
    CAST(CASE family WHEN 'code_generation' THEN 0.7 WHEN 'sentiment' THEN 0.75 WHEN 'factual' THEN 0.9 WHEN 'code_fix' THEN 0.7 END AS DOUBLE) AS floor
  FROM ({ALL_FAMILIES}) GROUP BY family)"""


@query(FLOOR_SQL)
def floor_gate(x):
    return S.floor_gate(G.gate(_families(x), families=FAMILIES), passed="accepted")


@query(f"SELECT NOT bool_or(low) AS set_ok, count(*) FILTER (low) AS low_families FROM ({FLOOR_SQL})")
def set_passes(x):
    return S.set_passes(S.floor_gate(G.gate(_families(x), families=FAMILIES), passed="accepted"))


@query("SELECT source AS family, count(*) AS rows FROM documents GROUP BY source")
def family_counts(x):
    return S.family_counts(x.documents, "source")


@query("""SELECT coalesce(lang, '(all)') AS cache, coalesce(CAST(quality AS VARCHAR), '(all)') AS label, count(*) AS rows
FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, quality)""")
def class_balance(x):
    rows = x.documents.join(x.labels, "doc_id").select("lang", c("quality").cast("string").alias("quality"))
    return S.class_balance(rows, "lang", "quality")


RUNS_SQL = f"""SELECT run_id, min(user_id) AS user_id, count(*) FILTER (NOT error) AS calls,
  coalesce(CAST(sum(tokens) FILTER (NOT error) AS BIGINT), 0) AS total_tokens, count(*) FILTER (tool) AS tool_runs,
  count(*) FILTER (error) AS errors, min(ts) AS started_at, max(ts) AS finished_at, arg_min(model, (ts, call_id)) AS model
FROM {duck('calls')} GROUP BY run_id"""


def _stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


@query(f"""SELECT run_id, calls, total_tokens, tool_runs, errors, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, model FROM ({RUNS_SQL})""")
def calls_to_metrics(x):
    m = T.calls_to_metrics(x.view("calls"))
    return m.withColumn("started_at", _stamp("started_at")).withColumn("finished_at", _stamp("finished_at"))


@query(f"""SELECT user_id, count(*) AS runs, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(tool_runs) AS BIGINT) AS tool_runs, CAST(sum(errors) AS BIGINT) AS errors, arg_min(model, run_id) AS model
FROM ({RUNS_SQL}) GROUP BY user_id""")
def run_totals(x):
    runs = T.calls_to_metrics(x.view("calls"), ("user_id", "run_id"))
    return T.run_totals(runs, ["user_id"])


@query(f"""SELECT model, count(*) AS repeats, avg(total_tokens) AS mean, stddev_samp(total_tokens) AS stddev,
  min(total_tokens) AS lowest, max(total_tokens) AS highest, median(total_tokens) AS median FROM ({RUNS_SQL}) GROUP BY model""")
def repeat_variance(x):
    return S.repeat_variance(T.calls_to_metrics(x.view("calls")), ["model"], "total_tokens")


# --- comparisons -------------------------------------------------------------
COMPARED_SQL = f"""SELECT coalesce(b.category, n.category) AS set_name, coalesce(b.task_id, n.task_id) AS task_id,
  CASE WHEN b.task_id IS NULL THEN 'added' WHEN n.task_id IS NULL THEN 'removed' WHEN NOT b.pass AND n.good THEN 'fixed'
       WHEN b.pass AND NOT n.good THEN 'broken' WHEN b.pass AND n.good THEN 'same_pass' ELSE 'same_fail' END AS outcome
FROM (SELECT * FROM {duck('routed')} WHERE model <> '5-LOW') b FULL JOIN (
  SELECT *, tokens > 250000 AS good FROM {duck('routed')} WHERE duration_ms >= 50) n ON b.task_id = n.task_id"""


def _compared(x):
    r = x.view("routed").withColumn("set_name", c("category"))
    return S.compare_runs(r.where("model <> '5-LOW'"),
                          r.where("duration_ms >= 50").withColumn("pass", c("tokens") > 250000))


@query(COMPARED_SQL)
def compare_runs(x):
    return _compared(x).select("set_name", "task_id", "outcome")


@query(f"""SELECT *, fixed + same_pass >= CASE set_name WHEN 'BUILDING' THEN 10 ELSE broken + same_pass END AS ships FROM (
  SELECT set_name, {', '.join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in S.OUTCOMES)} FROM ({COMPARED_SQL}) GROUP BY set_name)""")
def compare_sets(x):
    return S.compare_sets(_compared(x), {"BUILDING": 10})


@query(f"""SELECT doc_id, label AS first_label, gold AS second_label, label IS NOT DISTINCT FROM gold AS agree FROM (
  SELECT doc_id, gold, nullif(regexp_extract(answer, '\\b(Positive|Negative|Neutral)\\b', 1), '') AS label FROM {duck('reviews')})""")
def label_agreement(x):
    v = x.view("reviews")
    first = v.select("doc_id", X.sentiment_label(c("answer")).alias("label"))
    return S.label_agreement(first, v.select("doc_id", c("gold").alias("label")), key="doc_id")


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN NULL ELSE 'spans_differ' END AS reason FROM orders WHERE o_orderkey % 8 NOT IN (4, 5, 6)
UNION ALL SELECT o_orderkey, 'spans_differ' FROM orders WHERE o_orderkey % 8 = 6
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 8 IN (4, 5)""")
def ner_agreement(x):
    v = x.view("entities")
    first = v.select("o_orderkey", "answer")
    gold = F.when(c("o_orderkey") % 8 == 5, F.replace("gold", F.lit("LOCATION"), F.lit("ORGANIZATION"))).otherwise(c("gold"))
    return S.ner_agreement(first, v.select("o_orderkey", gold.alias("answer")), "o_orderkey").select("o_orderkey", "reason")


@query("""WITH t AS (SELECT doc_id, 'good' AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
  p AS (SELECT doc_id, 'good' AS label FROM documents JOIN labels USING (doc_id) WHERE n_chars > 1000
        UNION ALL SELECT doc_id, 'toxic' FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(text, '[0-9]')),
  j AS (SELECT coalesce(t.label, p.label) AS label, t.label IS NOT NULL AS a, p.label IS NOT NULL AS b FROM t FULL JOIN p ON t.doc_id = p.doc_id AND t.label = p.label)
SELECT coalesce(label, '(micro)') AS label, tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (
  SELECT label, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a) AS fp, count(*) FILTER (NOT b) AS fn FROM j GROUP BY ROLLUP (label))""")
def label_quality(x):
    flags = lambda good, toxic: F.array_compact(F.array(F.when(good, "good"), F.when(toxic, "toxic")))
    truth = x.labels.select("doc_id", flags(c("quality") == 1, c("toxic") == 1).alias("labels"))
    seen = x.documents.join(x.labels.select("doc_id"), "doc_id")
    predicted = seen.select("doc_id", flags(c("n_chars") > 1000, c("text").rlike("[0-9]")).alias("labels"))
    return S.label_quality(truth, predicted, "doc_id")


# --- models and strategies ---------------------------------------------------
@query(f"""SELECT *, passed / total AS accuracy FROM (SELECT coalesce(model, '(all)') AS model, coalesce(category, '(all)') AS category, count(*) AS total,
  count(*) FILTER (pass) AS passed, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
  FROM {duck('routed')} GROUP BY CUBE (model, category))""")
def route_grid(x):
    return S.route_grid(x.view("routed"))


def _cells(x):
    return x.view("routed").groupBy("model", "category").agg(
        F.count_if("pass").alias("passed"), F.count(F.lit(1)).alias("total"), F.sum("tokens").alias("tokens"))


@query(f"""SELECT category, model, passed, total, tokens FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY passed DESC, tokens, model) AS r FROM (
  SELECT model, category, count(*) FILTER (pass) AS passed, count(*) AS total, CAST(sum(tokens) AS BIGINT) AS tokens FROM {duck('routed')} GROUP BY ALL))
WHERE r = 1""")
def category_winner(x):
    return S.category_winner(_cells(x))


@query(f"""SELECT category, arg_min(strategy, (tokens, strategy)) AS best_tokens, min(tokens) AS fewest_tokens,
  arg_min(strategy, (duration_ms, strategy)) AS best_speed, min(duration_ms) AS shortest_ms FROM (
  SELECT category, strategy, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM {duck('routed')} GROUP BY ALL)
GROUP BY category""")
def best_strategy(x):
    runs = x.view("routed").groupBy("category", "strategy").agg(
        F.sum("tokens").alias("tokens"), F.sum("duration_ms").alias("duration_ms"))
    return S.best_strategy(runs, ("category",))


@query(f"""SELECT board, name, row_number() OVER (PARTITION BY board ORDER BY rank IS NULL, rank, m IS NULL, m, name) AS computed_rank
FROM (SELECT *, CASE WHEN rank IS NULL THEN CASE WHEN rank_by = 'tokens' THEN coalesce(tokens, score) ELSE -score END END AS m FROM {duck('board')})""")
def leaderboard_rank(x):
    return T.leaderboard_rank(x.view("board")).select("board", "name", "computed_rank")


@query(f"SELECT name, score FROM {duck('board')} ORDER BY score DESC NULLS LAST, name LIMIT 20")
def leaders(x):
    return T.leaders(x.view("board"), 20, c("score").desc_nulls_last(), c("name")).select("name", "score")



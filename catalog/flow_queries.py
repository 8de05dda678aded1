"""Queries of the sources, sinks, streams, learned labels and end-to-end plans.

Readers and streams work on files that Spark writes from the driver tables into
the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatehouse.functions.fixed import FAMILY_SYSTEM_PROMPTS
from gatehouse.operators import labels as L
from gatehouse.operators import scoring as Q
from gatehouse.operators.decontam import hash_split
from gatehouse.operators.routing import top_labels
from gatehouse.plans import runs, training
from gatehouse.session import materialise, scratch
from gatehouse.sources import readers as R
from gatehouse.sources import sinks as W
from gatehouse.streaming import streams as S
from gatehouse.streaming.keyed import KeyedTable, upsert_stream

from . import duck as D
from . import views
from .base import duck, query
from .gate_queries import ECHO_SQL, RUNS, SENTIMENT_SQL, SHAPE
from .report_queries import CATEGORY, GOLDEN_PASS, _report_sql
from .table_queries import EVAL_SQL, HELD, KEYWORD, NGRAM_SQL, ROUTE_TASKS, SPLIT_SQL, _evaluation
from .text_queries import joined

c = F.col


# --- sources and sinks -------------------------------------------------------
@query("""SELECT CASE WHEN role = 'system' THEN NULL ELSE conv_id || '_' || turn END AS task_id, text AS prompt, role = 'system' AS quarantined
FROM conversations""")
def read_tasks(x):
    path = scratch(x.spark, "tasks")
    raw = F.when(c("role") == "system", "  ").otherwise(F.concat(F.lit(" "), c("conv_id"), F.lit("_"), c("turn"), F.lit("\t")))
    W.write_table(x.conversations.select(raw.alias("task_id"), c("text").alias("prompt")), path, "json")
    good, bad = R.split_quarantine(R.read_tasks(x.spark, path, strict=False))
    return good.withColumn("quarantined", F.lit(False)).unionByName(bad.withColumn("quarantined", F.lit(True)))


@query(f"""SELECT task_id, expected, CASE WHEN validate = 'llm' THEN 'contains_ci' ELSE validate END AS validate
FROM {duck('golden')} WHERE quality = 1""")
def read_golden(x):
    path = scratch(x.spark, "golden")
    W.write_table(x.view("golden").select(
        "task_id", F.when(c("quality") == 1, c("expected")).otherwise("").alias("expected"),
        F.when(c("validate") != "llm", c("validate")).alias("validate")), path, "json")
    return R.read_golden(x.spark, path).select("task_id", "expected", "validate")


@query(f"""SELECT task_id, family AS category, answer, 'local' AS via, CASE WHEN pass THEN NULL ELSE 'quality' END AS reason, pass,
  doc_id * 2 AS gen_tokens, doc_id AS gen_ms, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM {duck('archive')}""")
def read_archive(x):
    """``place`` counts over all files in the order of their names, so it holds file and position to account."""
    path = scratch(x.spark, "archive")
    digest = F.md5(c("doc_id").cast("string").cast("binary"))
    W.write_table(x.view("archive").orderBy(digest, "doc_id").select(
        c("task_id").alias("ID"), c("family").alias("Cat"), c("answer").alias("Answer"), F.lit("local").alias("Via"), F.when(~c("pass"), "quality").alias("Reason"),
        c("pass").alias("Pass"), (c("doc_id") * 2).alias("GenTokens"), c("doc_id").alias("GenMS")), path, "json")
    rows = R.read_archive(x.spark, path)
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = files.alias("a").join(files.alias("b"), c("b.file") < c("a.file"), "left").groupBy(c("a.file").alias("file")).agg(
        F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return rows.join(before, "file").select("task_id", "category", "answer", "via", "reason", "pass", "gen_tokens", "gen_ms", (c("before") + c("pos")).alias("place"))


@query(f"""SELECT 'factual' AS family, 'system|user|assistant' AS roles, prompt AS "user", answer AS assistant FROM {duck('turns')}""")
def chat_rows(x):
    from gatehouse.operators.sampling import to_chat_rows
    path = scratch(x.spark, "chat")
    W.write_chat_rows(to_chat_rows(x.view("turns").withColumn("family", F.lit("factual"))), path)
    m = c("messages")
    return R.read_chat_rows(x.spark, path).select(
        "family", joined(F.transform(m, lambda e: e["role"])).alias("roles"),
        m[1]["content"].alias("user"), m[2]["content"].alias("assistant"))


CALLS_OF_RUN = f"""SELECT run_id, model, max(day) AS day, count(*) AS n, sum(tokens) AS tokens FROM {duck('calls')} GROUP BY run_id, model"""


@query(f"""WITH u AS (SELECT *, run_id || '/' || model AS up FROM ({CALLS_OF_RUN})),
k AS (SELECT c.*, c.run_id || '/' || c.model AS up, row_number() OVER (PARTITION BY c.run_id, c.model ORDER BY call_id) - 1 AS call FROM {duck('calls')} c),
r AS (SELECT *, up NOT IN (SELECT up FROM u WHERE n % 4 = 3) AS whole FROM k)
SELECT 'calls' AS part, up AS label, CAST(call AS INTEGER) AS call, concat_ws('|', call, strftime(ts, '%Y-%m-%d %H:%M:%S'), call_id % 97, tokens, tokens + 1, 2 * tokens + 1, call_id % 5,
  call_id % 3, 2, length(model), run_id, call_id, model, 'low', 400, '[{{"content":"' || call_id || '","role":"user"}}]', 'said ' || call_id, 'thought', CASE WHEN tool THEN 1 ELSE 0 END,
  CASE WHEN error THEN 'failed' ELSE 'none' END) AS row FROM r WHERE whole
UNION ALL SELECT 'traces', up, CAST(call AS INTEGER), concat_ws('|', 0, 'print(' || call_id || ')', call_id, '{{}}', 'none') FROM r WHERE whole AND tool
UNION ALL SELECT 'tasks', up, NULL, run_id || '|' || 'Day ' || day FROM r WHERE whole
UNION ALL SELECT 'answers', up, NULL, run_id || '|' || model FROM r WHERE whole
UNION ALL SELECT 'broken', NULL, NULL, CAST(count(*) AS VARCHAR) FROM u WHERE n % 4 = 3""")
def read_telemetry(x):
    """Uploads with several calls and tasks each; every fourth kind of them is cut off and must come back as broken."""
    path = scratch(x.spark, "telemetry")
    calls, none = x.view("calls"), F.lit(None).cast("string")
    number, text = c("call_id"), c("call_id").cast("string")
    place = F.row_number().over(Window.partitionBy("run_id", "model").orderBy("call_id")) - 1
    trace = F.struct(F.lit(0).alias("index"), F.concat(F.lit("print("), text, F.lit(")")).alias("code"), text.alias("stdout"), F.lit("{}").alias("json"))
    record = F.struct(
        place.alias("turn"), c("ts").alias("timestamp"), (number % 97).alias("latency_ms"), c("tokens").alias("prompt_tokens"), (c("tokens") + 1).alias("completion_tokens"),
        (2 * c("tokens") + 1).alias("total_tokens"), (number % 5).alias("cached_tokens"), (number % 3).alias("reasoning_tokens"), F.lit(2).alias("batch_size"),
        F.length("model").alias("output_chars"), F.array("run_id", text).alias("task_ids"), "model", F.lit("low").alias("effort"), F.lit(400).alias("max_tokens"),
        F.array(F.struct(text.alias("content"), F.lit("user").alias("role"))).alias("messages"), F.concat(F.lit("said "), text).alias("assistant_message"),
        F.lit("thought").alias("reasoning_content"), F.when(c("tool"), F.array(trace)).alias("tool_traces"), F.when(c("error"), "failed").alias("error"))
    # A run is one user's day, so its lists are short.
    uploads = calls.select("run_id", "model", "day", record.alias("r")).groupBy("run_id", "model").agg(
        F.array_sort(F.collect_list("r")).alias("records"), F.max("day").alias("day"))
    lines = F.to_json(F.struct(
        F.transform("records", lambda r: F.struct(c("run_id").alias("task_id"), F.concat(F.lit("Day "), "day").alias("prompt"))).alias("tasks"),
        F.transform("records", lambda r: F.struct(c("run_id").alias("task_id"), c("model").alias("answer"))).alias("results"),
        F.struct("model", F.col("records").alias("call_records")).alias("metrics"), F.concat("run_id", F.lit("/"), "model").alias("label")),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    cut = F.when(F.size("records") % 4 == 3, F.substr(lines, F.lit(1), F.length(lines) - 9)).otherwise(lines)
    uploads.select(cut.alias("value")).write.text(path)
    t = R.read_telemetry(x.spark, path)

    def rows(part, table, call, *fields):
        return t[table].select(F.lit(part).alias("part"), "label", call.cast("int").alias("call"), F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("none")) for f in fields)).alias("row"))

    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    of_call = [c("turn"), stamp, *map(c, ("latency_ms", "prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens", "reasoning_tokens", "batch_size", "output_chars")),
               joined(c("task_ids")), *map(c, ("model", "effort", "max_tokens")), F.to_json("messages"), c("assistant_message"), c("reasoning_content"),
               F.coalesce(F.size("tool_traces"), F.lit(0)), c("error")]
    return rows("calls", "calls", c("call"), *of_call).unionByName(
        rows("traces", "traces", c("call"), *map(c, ("index", "code", "stdout", "json", "error")))).unionByName(
        rows("tasks", "tasks", none, c("task_id"), c("prompt"))).unionByName(rows("answers", "answers", none, c("task_id"), c("answer"))).unionByName(
        t["broken"].agg(F.count(F.lit(1)).cast("string").alias("row")).select(F.lit("broken").alias("part"), none.alias("label"), none.cast("int").alias("call"), "row"))


@query("""WITH k AS (SELECT *, c_custkey % 5 AS k FROM customer)
SELECT c_custkey, c_name AS name, CAST(CASE WHEN k IN (0, 3) THEN NULL ELSE c_nationkey + 1 END AS BIGINT) AS rank,
  CASE WHEN k = 3 THEN NULL ELSE c_acctbal END AS score, CAST(CASE WHEN k = 1 THEN c_custkey WHEN k = 3 THEN c_nationkey END AS BIGINT) AS tokens,
  CASE k WHEN 0 THEN 'tracks.entries' WHEN 1 THEN 'leaderboard' WHEN 2 THEN 'data.submissions' WHEN 3 THEN 'season.league.region.FAILEDENTRIES' ELSE 'board.rows' END AS source_path,
  CASE k WHEN 0 THEN c_mktsegment WHEN 3 THEN 'Region ' || c_nationkey WHEN 4 THEN 'Board' END AS track_name, CASE k WHEN 3 THEN 'tokens' END AS rank_by,
  CASE k WHEN 3 THEN 'T' || c_nationkey END AS track, CASE k WHEN 3 THEN c_mktsegment END AS "user", CASE k WHEN 3 THEN c_nationkey || ' tokens' END AS score_label,
  CASE k WHEN 3 THEN 'failed' END AS status,
  CASE k WHEN 0 THEN 'tracks.entries-0' WHEN 1 THEN 'leaderboard-0' WHEN 2 THEN 'data.submissions-0' WHEN 3 THEN 'x' || c_custkey ELSE 'board.rows-0' END AS id FROM k""")
def flatten_leaderboard(x):
    name, place = c("c_name").alias("name"), (c("c_nationkey") + 1)
    nation = c("c_nationkey").cast("string")
    one = F.struct

    def listed(*fields):
        return F.array(one(*fields))

    tracks = one(listed(c("c_mktsegment").alias("name"), listed(one(name).alias("submission"), c("c_acctbal").alias("finalScore")).alias("entries")).alias("tracks"))
    flat = one(listed(c("c_name").alias("title"), c("c_acctbal").alias("score"), place.alias("place"), c("c_custkey").alias("tokenCount")).alias("leaderboard"))
    nested = one(one(listed(c("c_name").alias("submission_name"), c("c_acctbal").alias("total_score"), place.alias("rank")).alias("submissions")).alias("data"))
    entry = listed(c("c_name").alias("projectName"), F.concat(F.lit("x"), "c_custkey").alias("_id"), one(c("c_mktsegment").alias("displayName")).alias("owner"),
                   F.concat(nation, F.lit(" tokens")).alias("scoreLabel"), F.lit("failed").alias("failure_reason"), listed(F.lit("deeper").alias("name")).alias("results"))
    deep = one(one(one(F.lit("tokens").alias("rankBy"), F.lit("outer").alias("track"), one(
        F.concat(F.lit("Region "), nation).alias("name"), F.concat(F.lit("T"), nation).alias("trackId"), entry.alias("FAILEDENTRIES"), F.array(F.lit(1)).alias("results")).alias("region"),
    ).alias("league")).alias("season"))
    other = one(one(F.lit("Board").alias("name"), listed(name, c("c_acctbal").alias("score"), place.alias("position")).alias("rows")).alias("board"), F.array(F.lit(1)).alias("results"))
    payload, k = F.to_json(other), c("c_custkey") % 5
    for i, shape in enumerate((tracks, flat, nested, deep)):
        payload = F.when(k == i, F.to_json(shape)).otherwise(payload)
    return R.flatten_leaderboard(x.customer.select("c_custkey", payload.alias("payload"))).select(
        "c_custkey", "name", "rank", "score", "tokens", "source_path", "track_name", "rank_by", "track", "user", "score_label", "status", "id")


SETS = f"""SELECT set_name, task_id, CASE WHEN quality = 1 THEN expected END AS expected FROM {duck('golden')} WHERE set_name <> 'src3'"""


@query(f"""SELECT set_name AS file, count(*) AS "count", arg_min(expected IS NOT NULL, task_id) AS has_expected, set_name AS name FROM ({SETS}) GROUP BY set_name""")
def catalog_task_sets(x):
    """Task files by set, in several parts each, one set excluded."""
    path = scratch(x.spark, "sets")
    W.write_table(x.view("golden").select("set_name", "task_id", F.when(c("quality") == 1, c("expected")).alias("expected")).repartitionByRange("set_name", "task_id")
                  .sortWithinPartitions("set_name", "task_id"), path, "json", ["set_name"])
    return R.catalog_task_sets(x.spark, path, exclude=("src3",), file=F.regexp_extract("__path", "set_name=([^/]+)/", 1))


@query(f"SELECT task_id, answer, 'c' || conv_id AS run_id FROM {duck('turns')}")
def write_results(x):
    path = scratch(x.spark, "results")
    W.write_results(x.view("turns").withColumn("run_id", F.concat(F.lit("c"), "conv_id")), path, keys=["run_id"])
    return x.spark.read.schema("task_id STRING, answer STRING, run_id STRING, part INT").json(path).drop("part")


@query(f"""SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(passed) AS BIGINT) AS passed, string_agg(category || ':' || passed || '/' || total, '|' ORDER BY category) AS by_category
FROM ({_report_sql(f'SELECT {CATEGORY} AS category, {GOLDEN_PASS} AS pass FROM {duck("golden")}')}) WHERE category <> '(all)'""")
def nested_report(x):
    g = x.view("golden")
    report = runs.evaluate(g.select("task_id", "expected", "validate"), g.select("task_id", "answer"))
    path = scratch(x.spark, "report")
    W.write_report(report.withColumn("run_id", F.lit("r1")), path)
    stored = x.spark.read.schema("run_id STRING, category STRING, total BIGINT, passed BIGINT, failed BIGINT, unjudged BIGINT, pass_rate DOUBLE").json(path)
    cells = F.transform(F.map_entries("by_category"), lambda e: F.concat(
        e["key"], F.lit(":"), e["value"]["passed"], F.lit("/"), e["value"]["total"]))
    return W.nested_report(stored).select("total", "passed", joined(cells).alias("by_category"))


# --- streams -----------------------------------------------------------------
def _events(x):
    batch = x.events
    return S.stream_events(x.spark, x.files("events"), batch.schema)


def _calls(x):
    e = _events(x)
    return e.select(c("event_id").alias("call_id"), "user_id", "ts", c("event_type").alias("model"),
                    F.round("value").cast("bigint").alias("tokens"), (c("event_type") == "error").alias("error"))


def _run(x, stream, name):
    out, state = scratch(x.spark, name), scratch(x.spark, name + "-state")
    q = S.run_to_table(stream, out, state)
    q.awaitTermination()
    return x.spark.read.schema(stream.schema).parquet(out)


def _upserted(x, stream, keys, name):
    """Every window, also those open at the end of the input: the stream hands over each change."""
    table = KeyedTable(scratch(x.spark, name), stream.schema, keys)
    upsert_stream(stream, table, scratch(x.spark, name + "-state"), "update").awaitTermination()
    return table.read(x.spark)


def _stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def stream_events(x):
    return _run(x, _events(x), "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
good AS (SELECT * FROM e WHERE event_id % 50 <> 7),
steps AS (SELECT user_id, seq, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) AS next FROM good)
SELECT 'event' AS part, CAST(user_id AS VARCHAR) AS run, seq, event_type AS type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM good
UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, count(*) FROM e WHERE event_id % 50 = 7
UNION ALL SELECT 'gap', CAST(user_id AS VARCHAR), seq, NULL, NULL, next - seq - 1 FROM steps WHERE next > seq + 1""")
def stream_event_rows(x):
    """Event lines with untyped data; one in fifty is cut off, so its number is missing in its run."""
    src, good, dead, state = (scratch(x.spark, n) for n in ("event-lines", "event-rows", "event-dead", "event-state"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    line = F.to_json(F.struct(c("user_id").cast("string").alias("run"), seq.alias("seq"), c("event_type").alias("type"), c("ts").alias("timestamp"),
                              F.parse_json("props").alias("data")))
    cut = F.when(c("event_id") % 50 == 7, F.substr(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    x.events.select(cut.alias("value")).write.text(src)
    S.stream_event_rows(x.spark, src, S.batch_sink(good), S.batch_sink(dead), state).awaitTermination()
    events = x.spark.read.schema("run STRING, seq BIGINT, type STRING, timestamp TIMESTAMP, data STRING, batch_id BIGINT").parquet(good)
    none = F.lit(None).cast("string")
    return events.select(F.lit("event").alias("part"), "run", "seq", "type", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"),
                         F.get_json_object("data", "$.k").cast("bigint").alias("k")).unionByName(
        x.spark.read.schema("broken STRING, batch_id BIGINT").parquet(dead).agg(F.count(F.lit(1)).alias("k")).select(
            F.lit("broken").alias("part"), none.alias("run"), none.cast("bigint").alias("seq"), none.alias("type"), none.alias("at"), "k")).unionByName(
        S.event_gaps(events).select(F.lit("gap").alias("part"), "run", c("after").alias("seq"), none.alias("type"), none.alias("at"), c("missing").alias("k")))


def _windows(slides: int, step: str) -> str:
    return f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens,
  count(*) FILTER (error) AS errors FROM (
  SELECT *, time_bucket(INTERVAL '{step}', ts) - k * INTERVAL '{step}' AS w FROM {duck('calls')} CROSS JOIN (SELECT unnest(range(0, {slides})) AS k))
GROUP BY w, model"""


@query(_windows(1, "1 hour"))
def stream_usage(x):
    return _upserted(x, S.usage_windows(_calls(x)), ["window_start", "model"], "usage").select(_stamp("window_start"), "model", "calls", "tokens", "errors")


@query(_windows(4, "15 minutes"))
def stream_usage_sliding(x):
    return _upserted(x, S.usage_windows(_calls(x), slide="15 minutes"), ["window_start", "model"], "sliding").select(_stamp("window_start"), "model", "calls", "tokens", "errors")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '2 hours' THEN 1 ELSE 0 END AS fresh FROM events))
GROUP BY user_id, s""")
def stream_sessions(x):
    batch = x.events.withColumn("ts", c("ts").cast("timestamp"))
    out = S.close_out(_run(x, S.sessions(_events(x)), "sessions"), batch, S.sessions, "session_end")
    return out.select("user_id", _stamp("session_start"), "events")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(x):
    twice = _events(x).select("event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("upload"))
    return _run(x, S.stream_dedup(twice, ["event_id"]).select("event_id", "user_id"), "dedup")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def stream_latest(x):
    rows = _events(x).select("user_id", "event_id", "event_type", "ts")
    path, state = scratch(x.spark, "latest"), scratch(x.spark, "latest-state")
    q, table = S.stream_latest(rows, ["user_id"], ["ts", "event_id"], path, state)
    q.awaitTermination()
    return table.read(x.spark).drop("ts")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r = 1 AND ts >= (SELECT max(ts) - INTERVAL '6 hours' FROM events)""")
def stream_latest_expiring(x):
    rows = _events(x).select("user_id", "event_id", "ts")
    path, state = scratch(x.spark, "latest"), scratch(x.spark, "latest-state")
    q, table = S.stream_latest(rows, ["user_id"], ["ts", "event_id"], path, state, "ts", "6 hours")
    q.awaitTermination()
    return table.read(x.spark).drop("ts")


@query(f"""SELECT doc_id, CASE WHEN r = '' THEN NULL ELSE r END AS reason FROM (SELECT doc_id, coalesce(reason, '') AS r FROM (
{SENTIMENT_SQL}))""")
def stream_gate(x):
    docs = x.spark.readStream.schema(x.documents.schema).parquet(x.files("documents"))
    docs.createOrReplaceTempView("gatehouse_document_stream")
    rows = x.spark.sql(views.reviews(views.SparkDialect(lambda name: "gatehouse_document_stream"))).withColumn("family", F.lit("sentiment"))
    good, bad, state = scratch(x.spark, "accepted"), scratch(x.spark, "rejected"), scratch(x.spark, "gate-state")
    S.stream_gate(rows, S.batch_sink(good), S.batch_sink(bad), state, ["sentiment"]).awaitTermination()
    schema = "doc_id BIGINT, reason STRING, batch_id BIGINT"
    return x.spark.read.schema(schema).parquet(good).unionByName(x.spark.read.schema(schema).parquet(bad)).drop("batch_id")


# --- learned labels ----------------------------------------------------------
SPLIT_OF_LABELLED = f"SELECT d.doc_id, quality, toxic, {SPLIT_SQL} AS split FROM documents d JOIN labels USING (doc_id)"


@query(f"""SELECT label, n, positives, true AS placed, true AS useful, true AS calibrated FROM (
  SELECT 'quality' AS label, count(*) AS n, count(*) FILTER (quality = 1) AS positives FROM ({SPLIT_OF_LABELLED}) WHERE split = 'heldout'
  UNION ALL SELECT 'toxic', count(*), count(*) FILTER (toxic = 1) FROM ({SPLIT_OF_LABELLED}) WHERE split = 'heldout')""")
def fit_labeller(x):
    """Rows and positives per label on held-out rows, and whether the model keeps its word there: every row has a
    score, its choices beat naming every row (F1, with room for few rows), and it states about as many positives as there are."""
    labels = ["quality", "toxic"]
    rows = hash_split(x.documents.join(x.labels, "doc_id"))
    train, held = rows.where("split = 'train'"), rows.where("split = 'heldout'")
    model = L.fit_labeller(train, labels)
    scored = materialise(model.score_labels(held).select("doc_id", *labels, "scores"))
    truth = scored.select("doc_id", F.array_compact(F.array(*(F.when(c(n) == 1, n) for n in labels))).alias("labels"))
    predicted = scored.select("doc_id", top_labels(c("scores"), model.thresholds).alias("labels"))
    quality = Q.label_quality(truth, predicted, "doc_id")
    sums = L.calibration(scored, labels).groupBy("label").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.sum("stated").alias("stated"))
    n, positives = c("n"), c("positives")
    return sums.join(quality.select("label", "f1"), "label", "left").join(held.agg(F.count(F.lit(1)).alias("rows"))).select(
        "label", "n", "positives", (n == c("rows")).alias("placed"),
        (F.coalesce("f1", F.lit(0.0)) >= 2 * positives / (n + positives) - 0.02 - 2 / F.sqrt(n)).alias("useful"),
        (F.abs(c("stated") - positives) <= 0.1 * n + 2 * F.sqrt(n)).alias("calibrated"))


# --- plans -------------------------------------------------------------------
FLAG_SQL = f"""WITH d AS (SELECT * FROM {duck('drafts')} s WHERE doc_id NOT IN (SELECT doc_id FROM ({NGRAM_SQL}))
    AND NOT EXISTS (SELECT 1 FROM ({EVAL_SQL}) e WHERE e.doc_id = s.doc_id) AND NOT EXISTS (SELECT 1 FROM ({EVAL_SQL}) e WHERE e.text = s.passage)),
  r AS (SELECT task_id, prompt, passage, unnest([a0, a1, a2, a3]) AS answer FROM d),
  a AS (SELECT DISTINCT task_id, prompt, {D.trim('answer')} AS answer, {SHAPE} IS NULL AND NOT list_has_any({D.grams('passage')}, {RUNS}) AS pass FROM r WHERE trim(answer) <> '')
SELECT p.task_id, p.prompt, '{FAMILY_SYSTEM_PROMPTS['summarisation'].replace("'", "''")}' AS system, p.answer AS chosen, f.answer AS rejected
FROM a p JOIN a f ON f.task_id = p.task_id WHERE p.pass AND NOT f.pass AND p.answer <> f.answer"""


@query(FLAG_SQL)
def flagship(x):
    drafts = x.view("drafts")
    answers = drafts.select("doc_id", "task_id", F.lit("summarisation").alias("family"), "prompt", F.explode(F.array("a0", "a1", "a2", "a3")).alias("answer"))
    forbidden = drafts.join(_evaluation(x).select("doc_id"), "doc_id").select("task_id", "prompt")
    table = training.preference_table(answers, x.documents.select("doc_id", "text"), x.benchmark, ["summarisation"], forbidden)
    return table.select("task_id", "prompt", "system", "chosen", "rejected")


@query(f"""SELECT doc_id, copy, 'system|user|assistant' AS roles FROM (
  SELECT doc_id, CAST(unnest(range(1, CASE lang WHEN 'en' THEN 4 ELSE 2 END)) AS INTEGER) AS copy FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM ({EVAL_SQL}) e WHERE e.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM ({EVAL_SQL}) e WHERE e.text = d.text)
    AND NOT ({HELD.format('text')}))""")
def chat_table(x):
    rows = x.documents.select("doc_id", "lang", F.lit("factual").alias("family"), c("text").alias("prompt"), F.lit("An answer.").alias("answer"))
    evaluation = _evaluation(x).withColumnRenamed("text", "prompt")
    out = training.chat_table({"documents": rows, "missing": None}, evaluation, F.when(c("lang") == "en", 3).otherwise(1), key="doc_id")
    return out.select("doc_id", "copy", joined(F.transform("messages", lambda m: m["role"])).alias("roles"))


@query(f"""WITH r AS (SELECT task_id, keyword, agrees, prompt, CASE WHEN NOT agrees THEN 'remote' WHEN keyword = 'code_generation' THEN 'assist'
    WHEN keyword = 'code_debugging' THEN CASE WHEN prompt LIKE '%evaluate to%' THEN 'code_trace' ELSE 'assist' END
    WHEN keyword = 'mathematical_reasoning' THEN 'tool' ELSE 'remote' END AS lane FROM ({ROUTE_TASKS})),
  a AS (SELECT task_id, answer FROM {duck('maths')})
SELECT r.task_id, lane, CASE WHEN keyword = 'sentiment_classification' THEN 'remote'
    WHEN lane = 'tool' AND regexp_matches(answer, '[0-9]') THEN 'local' WHEN lane = 'tool' THEN 'rejected' ELSE 'apology' END AS source
FROM r LEFT JOIN a ON r.task_id = a.task_id""")
def answer_run(x):
    tasks, predictions = None, None
    for view, category in KEYWORD.items():
        v = x.view(view).select("task_id", "prompt")
        top = F.when(F.length("task_id") % 2 == 0, category).otherwise("logical_deductive_reasoning")
        p = v.select("task_id", F.array(top).alias("labels"))
        tasks = v if tasks is None else tasks.unionByName(v)
        predictions = p if predictions is None else predictions.unionByName(p)
    candidates = x.view("maths").select("task_id", F.lit("maths").alias("family"), "answer")
    remote = x.view("reviews").select("task_id", "answer")
    return runs.answer_run(tasks, predictions, candidates, remote, ["maths"]).select("task_id", "lane", "source")



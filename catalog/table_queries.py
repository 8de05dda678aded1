"""Queries of pairs, decontamination, retrieval, sampling, routing and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatehouse.operators import decontam as C
from gatehouse.operators import near as N
from gatehouse.operators import pairs as P
from gatehouse.operators import retrieval as R
from gatehouse.operators import routing as T
from gatehouse.operators import sampling as S
from gatehouse.operators import search as Z

from gatehouse.session import materialise

from . import duck as D
from .base import duck, query
from .gate_queries import MEETING_SQL
from .text_queries import joined

c = F.col

# --- pairs -------------------------------------------------------------------
ANSWERS_SQL = f"""SELECT task_id, pass, answer, min((file, pos)) AS seen, count(*) AS copies FROM (
  SELECT task_id, pass, file, pos, {D.trim('answer')} AS answer FROM {duck('archive')}) WHERE answer <> '' GROUP BY task_id, pass, answer"""


@query(f"SELECT task_id, pass, answer, copies, seen[1] AS first_file, seen[2] AS first_pos FROM ({ANSWERS_SQL})")
def distinct_answers(x):
    return P.distinct_answers(x.view("archive")).drop("family")


PAIRS_SQL = f"""WITH a AS (SELECT task_id, pass, answer, row_number() OVER (PARTITION BY task_id, pass ORDER BY md5(answer)) - 1 AS i
    FROM ({ANSWERS_SQL}) WHERE length(answer) >= 1),
  n AS (SELECT task_id, count(*) FILTER (pass) AS np, count(*) FILTER (NOT pass) AS nf FROM a GROUP BY task_id)
SELECT p.task_id, CAST(d AS BIGINT) AS round, p.answer AS chosen, f.answer AS rejected
FROM n JOIN a p ON p.task_id = n.task_id AND p.pass JOIN a f ON f.task_id = n.task_id AND NOT f.pass
CROSS JOIN (SELECT unnest(range(0, {{rounds}})) AS d) r
WHERE d < least(np, nf) AND p.answer <> f.answer
  AND CASE WHEN np >= nf THEN (p.i + d) % nf = f.i ELSE (f.i + d) % np = p.i END"""


@query(PAIRS_SQL.replace("{rounds}", "(SELECT max(least(np, nf)) FROM n)"))
def preference_pairs(x):
    return P.preference_pairs(x.view("archive")).select("task_id", "round", "chosen", "rejected")


JUDGED_SQL = f"""SELECT d.*, g.label, g.authored, v, v = label AS is_right FROM (
  SELECT *, nullif(upper(substr(m, 1, 1)) || lower(substr(m, 2)), '') AS v FROM (
    SELECT *, regexp_extract(answer, '(?i)\\b(Positive|Negative|Neutral)\\b', 1) AS m FROM {duck('draws')})) d
JOIN {duck('draw_gold')} g ON d.prompt_id = g.prompt_id"""


@query(f"""WITH j AS ({JUDGED_SQL}), best AS (SELECT prompt_id, arg_min(answer, (length(answer), pos)) AS best FROM j WHERE is_right GROUP BY prompt_id),
  wrong AS (SELECT prompt_id, answer, authored, row_number() OVER (PARTITION BY prompt_id ORDER BY pos) AS r FROM (
    SELECT prompt_id, answer, min(pos) AS pos, min(authored) AS authored FROM j WHERE v IS NOT NULL AND NOT is_right GROUP BY prompt_id, answer))
SELECT w.prompt_id, coalesce(best, authored) AS chosen, answer AS rejected, CASE WHEN best IS NULL THEN 'never_right' ELSE 'split' END AS bucket
FROM wrong w LEFT JOIN best ON w.prompt_id = best.prompt_id""")
def on_policy_pairs(x):
    return P.on_policy_pairs(x.view("draws"), x.view("draw_gold"))


@query(f"""SELECT bucket, count(*) AS prompts, CAST(sum(n) AS BIGINT) AS draws FROM (
  SELECT prompt_id, count(*) AS n, CASE WHEN NOT bool_or(v IS NOT NULL AND NOT coalesce(is_right, false)) THEN 'always_right'
    WHEN bool_or(coalesce(is_right, false)) THEN 'split' ELSE 'never_right' END AS bucket FROM ({JUDGED_SQL}) GROUP BY prompt_id) GROUP BY bucket""")
def draw_outcome_buckets(x):
    return P.draw_outcome_buckets(x.view("draws"), x.view("draw_gold"))


# --- decontamination ---------------------------------------------------------
EVAL_SQL = """SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
  UNION ALL SELECT NULL, text FROM benchmark"""


def _evaluation(x):
    toxic = x.documents.join(x.labels.where("toxic = 1").select("doc_id"), "doc_id").select("doc_id", "text")
    return toxic.unionByName(x.benchmark.select(F.lit(None).cast("bigint").alias("doc_id"), "text"))


@query(f"""SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM ({EVAL_SQL}) e WHERE e.doc_id = d.doc_id)
  AND NOT EXISTS (SELECT 1 FROM ({EVAL_SQL}) e WHERE e.text = d.text)""")
def decontaminate_exact(x):
    return C.decontaminate_exact(x.documents, _evaluation(x), "doc_id", "text").select("doc_id", "lang")


@query(f"""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM ({EVAL_SQL}) WHERE doc_id IS NOT NULL) THEN 'id' ELSE 'prompt' END AS matched
FROM documents WHERE doc_id IN (SELECT doc_id FROM ({EVAL_SQL}) WHERE doc_id IS NOT NULL) OR text IN (SELECT text FROM ({EVAL_SQL}))""")
def contaminated_exact(x):
    return C.contaminated_exact(x.documents, _evaluation(x), "doc_id", "text").select("doc_id", "matched")


def _gram_rows(table: str, key: str) -> str:
    return f"SELECT {key}, unnest({D.grams('text')}) AS g FROM {table}"


NGRAM_SQL = f"""SELECT doc_id, item_id, count(*) AS shared_grams FROM ({_gram_rows('documents', 'doc_id')}) d
JOIN ({_gram_rows('benchmark', 'item_id')}) b ON d.g = b.g GROUP BY doc_id, item_id"""


@query(NGRAM_SQL)
def decontaminate_ngram(x):
    return C.decontaminate_ngram(x.documents, x.benchmark)


@query(f"SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({NGRAM_SQL}) WHERE shared_grams >= 5)")
def drop_contaminated(x):
    return C.drop_contaminated(x.documents, x.benchmark, min_shared=5).select("doc_id", "n_chars")


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_prompts(x):
    return C.duplicate_prompts(x.documents)


@query("""SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, source, lang) AS r FROM (
  SELECT doc_id, text, source, lang FROM documents UNION ALL SELECT doc_id, text, source, 'again' FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id - doc_id % 5, text, source, 'moved' FROM documents)) WHERE r = 1""")
def first_seen(x):
    """Ids repeat here, with the same text and with others."""
    d = x.documents.select("doc_id", "source", "lang", "text")
    again = d.where(c("doc_id") % 3 == 0).withColumn("lang", F.lit("again"))
    moved = d.withColumn("doc_id", c("doc_id") - c("doc_id") % 5).withColumn("lang", F.lit("moved"))
    return C.first_seen(d.unionByName(again).unionByName(moved)).select("doc_id", "source", "lang")


SPLIT_SQL = """CASE WHEN (2 * (CAST('0x' || substr(md5(text), 1, 16) AS UBIGINT)::HUGEINT % 7)
       + CAST('0x' || substr(md5(text), 17, 16) AS UBIGINT)::HUGEINT % 7) % 7 = 0 THEN 'heldout' ELSE 'train' END"""


@query(f"SELECT doc_id, {SPLIT_SQL} AS split FROM documents")
def hash_split(x):
    return C.hash_split(x.documents).select("doc_id", "split")


# Texts that are at least eight tenths alike share one of the first runs of each, in any common order.
LEAKS_SQL = f"""WITH w AS (SELECT doc_id, {SPLIT_SQL} AS split, text, {D.norm('text')} AS w FROM documents),
u AS (SELECT split, min(doc_id) AS id, any_value(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END) AS s FROM w GROUP BY split, text),
h AS (SELECT split, id, len(s) AS n, unnest(s[1:len(s) - (80 * len(s) + 99) // 100 + 1]) AS g FROM u WHERE len(s) > 0),
p AS (SELECT DISTINCT a.id AS heldout, b.id AS train FROM h a JOIN h b ON a.g = b.g AND a.split = 'heldout' AND b.split = 'train'),
k AS (SELECT heldout, train, len(list_intersect(x.s, y.s)) AS shared, len(x.s) + len(y.s) AS sum
  FROM p JOIN u x ON x.split = 'heldout' AND x.id = heldout JOIN u y ON y.split = 'train' AND y.id = train)
SELECT heldout, train, shared, sum - shared AS total FROM k WHERE 100 * shared >= 80 * (sum - shared)"""


@query(f"SELECT * FROM ({LEAKS_SQL}) UNION ALL SELECT -1, -1, count(*), (SELECT count(*) FROM documents) FROM ({LEAKS_SQL})")
def split_leaks(x):
    """Near copies that a split by text alone leaves on both sides, and a last row with their number."""
    split = C.hash_split(x.documents)
    leaks = materialise(N.split_leaks(split))
    whole = leaks.agg(F.count(F.lit(1)).alias("shared")).select(F.lit(-1).cast("bigint").alias("heldout"), F.lit(-1).cast("bigint").alias("train"), "shared")
    return leaks.unionByName(whole.join(split.agg(F.count(F.lit(1)).alias("total"))))


@query("SELECT count(*) AS documents, 0::BIGINT AS leaks, true AS balanced FROM documents")
def cluster_split(x):
    """The split by groups of near copies: its leaks, counted exactly, and whether a seventh is held out."""
    split = N.cluster_split(x.documents).select("doc_id", "text", "split")
    n, held = F.count(F.lit(1)), F.count_if(F.col("split") == "heldout")
    balanced = F.abs(held / n - 1 / 7) <= 0.01 + 3 * F.sqrt(6 / 49 / n)
    return split.agg(n.alias("documents"), balanced.alias("balanced")).join(N.split_leaks(split).agg(F.count(F.lit(1)).alias("leaks")))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def subtract(x):
    return C.subtract(x.documents, x.labels, ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def intersect(x):
    return C.intersect(x.documents, x.labels, ["doc_id"]).select("doc_id", "source")


@query("SELECT source, lang, arg_min(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY source, lang")
def distinct_by(x):
    rows = x.documents.select("doc_id", "source", "lang", "n_chars")
    return C.distinct_by(rows, ["source", "lang"], F.struct("n_chars", "doc_id")).drop("n_chars")


# --- retrieval ---------------------------------------------------------------
def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9-]{{4,}}', 0)"


def _score_sql(points: str, floor: int) -> str:
    return f"""SELECT item_id, doc_id, {points} AS score FROM (
  SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest({_tokens("text || ' src' || item_id % 20")}) AS token FROM benchmark) GROUP BY ALL) q
JOIN documents d ON contains(lower(d.source || chr(10) || d.text), token) GROUP BY item_id, doc_id HAVING {points} >= {floor}"""


SCORES = _score_sql("count(*)", 1)
BOOSTED = f"""SELECT item_id, doc_id, CAST(sum(score) AS BIGINT) AS score FROM ({SCORES} UNION ALL
  SELECT item_id, doc_id, 5 FROM benchmark CROSS JOIN (SELECT unnest([3, 7]) AS doc_id)) GROUP BY item_id, doc_id"""


def _asked(x):
    """Benchmark items as queries, each of which also names a source."""
    return x.benchmark.select("item_id", F.concat("text", F.lit(" src"), c("item_id") % 20).alias("query"))


def _scored(x, **options):
    return R.relevance_join(_asked(x), x.documents, "item_id", "doc_id", name="source", **options)


@query(BOOSTED)
def relevance_join(x):
    return _scored(x, preferred=[3, 7])


@query(_score_sql("CAST(sum(n) AS BIGINT)", 4))
def relevance_join_repeats(x):
    return _scored(x, count_repeats=True, min_score=4)


CONTEXT_SQL = f"""SELECT item_id, doc_id, rank, prior, least(n_chars, 6000 - prior) AS taken, text FROM (
  SELECT *, CAST(coalesce(sum(n_chars) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior
  FROM (SELECT s.item_id, s.doc_id, d.n_chars, d.text, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, s.doc_id) AS rank
        FROM ({SCORES}) s JOIN documents d ON s.doc_id = d.doc_id) WHERE rank <= 6) WHERE prior < 6000"""


def _context(x):
    top = Z.top_documents(_asked(x), x.documents, 6, "item_id", name="source", size="n_chars")
    return R.select_context(top, 6000, "item_id")


@query(f"""SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r
  FROM ({BOOSTED})) WHERE r <= 10""")
def top_documents(x):
    return Z.top_documents(_asked(x), x.documents, 10, "item_id", name="source", preferred=[3, 7])


@query(f"SELECT item_id, doc_id, rank, prior, taken FROM ({CONTEXT_SQL})")
def select_context(x):
    return _context(x).select("item_id", "doc_id", c("rank").cast("bigint").alias("rank"), "prior", "taken")


@query(f"""WITH s AS (SELECT s.*, n_chars, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r
    FROM ({SCORES}) s JOIN documents d USING (doc_id)),
  one AS (SELECT item_id, min(r) AS r FROM s WHERE n_chars <= 900 GROUP BY item_id),
  a AS (SELECT s.* FROM s JOIN one USING (item_id, r)),
  two AS (SELECT s.item_id, min(s.r) AS r FROM s JOIN a ON s.item_id = a.item_id AND s.r > a.r AND s.n_chars <= 900 - a.n_chars GROUP BY s.item_id)
SELECT item_id, doc_id, n_chars, CAST(1 AS INTEGER) AS turn FROM a UNION ALL SELECT item_id, doc_id, n_chars, 2 FROM s JOIN two USING (item_id, r)""")
def select_skip_over(x):
    return Z.skip_over(_asked(x), x.documents, 900, query_id="item_id", name="source").select("item_id", "doc_id", "n_chars", "turn")


@query(f"""SELECT item_id, doc_id, CASE WHEN length(text) <= room THEN text ELSE substr(text, 1, CAST(floor(room * 2 / 3) AS BIGINT)) || chr(10)
    || '[...middle omitted for context budget...]' || chr(10)
    || right(text, CAST(greatest(room - floor(room * 2 / 3) - 80, 0) AS BIGINT)) END AS content
FROM (SELECT *, 5000 - coalesce(sum(length(text)) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM ({CONTEXT_SQL})) WHERE room > 0""")
def trim_to_running_budget(x):
    selected = _context(x).join(x.documents.select("doc_id", "text"), "doc_id")
    return R.trim_to_running_budget(selected, 5000, query_id="item_id").select("item_id", "doc_id", "content")


# --- sampling ----------------------------------------------------------------
HELD = """(2 * (CAST('0x' || substr(md5({0}), 1, 16) AS UBIGINT)::HUGEINT % 7)
  + CAST('0x' || substr(md5({0}), 17, 16) AS UBIGINT)::HUGEINT % 7) % 7 = 0"""


@query(f"""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY p, o) AS r FROM (
  SELECT lang, text, min(doc_id) AS doc_id, CASE WHEN {HELD.format('text')} THEN 0 ELSE 1 END AS p, md5('5|' || text) AS o
  FROM documents GROUP BY lang, text)) WHERE r <= 25""")
def cap_per_family(x):
    from gatehouse.functions.hashing import is_held_out
    rows = x.documents.groupBy("lang", "text").agg(F.min("doc_id").alias("doc_id"))
    return S.cap_per_family(rows, 25, F.when(is_held_out(c("text")), 0).otherwise(1), 5, "lang", "text").select("lang", "doc_id")


QUOTAS = {"en": 30, "de": 20, "fr": 10}


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('3|' || doc_id)) AS r FROM documents)
WHERE r <= CASE lang WHEN 'en' THEN 30 WHEN 'de' THEN 20 WHEN 'fr' THEN 10 END""")
def quota_sample(x):
    return S.quota_sample(x.documents.select("lang", "doc_id"), "lang", QUOTAS, 3, "doc_id")


@query("""SELECT doc_id, CAST(unnest(range(1, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 3 ELSE 2 END)) AS INTEGER) AS copy FROM documents""")
def weight_rows(x):
    weight = F.when(c("lang") == "en", 3).when(c("lang") == "de", 2).otherwise(1)
    return S.weight_rows(x.documents, weight).select("doc_id", "copy")


@query("SELECT doc_id, lang FROM documents")
def seeded_shuffle(x):
    return S.seeded_shuffle(x.documents.select("doc_id", "lang"), 7, "doc_id")


@query("""SELECT 'documents' AS cache, text, source FROM documents UNION ALL SELECT 'benchmark', text, NULL FROM benchmark""")
def union_caches(x):
    return S.union_caches({"documents": x.documents.select("text", "source"), "absent": None,
                           "benchmark": x.benchmark.select("text")})


@query("""SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'heldout' ELSE 'train' END AS split
FROM customer""")
def holdout_keys(x):
    reserved = x.nation.where("n_regionkey = 1").select(c("n_nationkey").alias("c_nationkey"))
    return S.holdout_keys(x.customer, reserved, "c_nationkey").select("c_custkey", "split")


@query(f"""SELECT task_id, 'system:Answer directly and concisely; explanations max 3 short sentences.' || chr(10) || 'user:' || prompt || chr(10)
  || 'assistant:' || answer AS chat FROM {duck('turns')}""")
def to_chat_rows(x):
    rows = S.to_chat_rows(x.view("turns").withColumn("family", F.lit("factual")))
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return rows.select("task_id", joined(line, "\n").alias("chat"))


@query("""SELECT conv_id, turn, text AS prompt, next_text AS answer FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'""")
def flatten_turns(x):
    return S.flatten_turns(x.conversations).select("conv_id", "turn", "prompt", "answer")


@query("""SELECT conv_id, arg_min(text, turn) FILTER (role = 'system') AS system, arg_min(text, turn) FILTER (role = 'user') AS "user"
FROM conversations GROUP BY conv_id""")
def chat_heads(x):
    return S.chat_heads(x.conversations)


TEMPLATES = [
    ("On {day}, {person} of {org} spoke.", [("day", "DATE"), ("person", "PERSON"), ("org", "ORGANIZATION")]),
    ("{person} joined {org} in {place}, near {place2}.", [
        ("person", "PERSON"), ("org", "ORGANIZATION"), ("place", "LOCATION"), ("place2", "LOCATION")]),
]


@query("""SELECT o_orderkey, CAST(t AS INTEGER) AS template, CASE t WHEN 0 THEN 'On ' || day || ', ' || c_name || ' of ' || org || ' spoke.'
    ELSE c_name || ' joined ' || org || ' in ' || place || ', near ' || place2 || '.' END AS prompt,
  CASE t WHEN 0 THEN day || '=DATE|' || c_name || '=PERSON|' || substr(org, 5) || '=ORGANIZATION'
    ELSE c_name || '=PERSON|' || substr(org, 5) || '=ORGANIZATION|' || place || '=LOCATION|' || place2 || '=LOCATION' END AS spans
FROM (SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d') AS day, 'the ' || c_mktsegment AS org, n.n_name AS place,
        'NATION_' || (o_custkey % 25) AS place2, CAST('0x' || substr(md5('9|' || o_orderkey), 1, 8) AS BIGINT) % 2 AS t
      FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey)
WHERE t = 0 OR (length(place || '|' || place2) - length(replace(place || '|' || place2, place, ''))) / length(place) = 1
  AND (length(place || '|' || place2) - length(replace(place || '|' || place2, place2, ''))) / length(place2) = 1""")
def expand_templates(x):
    joined_rows = x.orders.join(x.customer, c("o_custkey") == c("c_custkey")).join(x.nation, c("c_nationkey") == c("n_nationkey"))
    slots = joined_rows.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), c("c_name").alias("person"),
        F.concat(F.lit("the "), "c_mktsegment").alias("org"), c("n_name").alias("place"),
        F.concat(F.lit("NATION_"), c("o_custkey") % 25).alias("place2"))
    out = S.expand_templates(slots, "o_orderkey", TEMPLATES, seed=9)
    pair = F.transform("spans", lambda s: F.concat(s["span"], F.lit("="), s["label"]))
    return out.select("o_orderkey", "template", "prompt", joined(pair).alias("spans"))


LARGE = """SELECT lang, doc_id, l FROM documents, (SELECT unnest(range(0, 40)) AS l)"""


@query(f"""SELECT lang, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(l) AS BIGINT) AS copies FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('3|' || doc_id || '-' || l)) AS r FROM ({LARGE}))
WHERE r <= CASE lang WHEN 'en' THEN 100000 WHEN 'de' THEN 3000 WHEN 'fr' THEN 1 END GROUP BY lang""")
def quota_sample_large(x):
    """Quotas far beyond what one task should rank."""
    rows = x.documents.select("lang", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("l")).withColumn("key", F.concat_ws("-", "doc_id", "l"))
    got = S.quota_sample(rows, "lang", {"en": 100000, "de": 3000, "fr": 1}, 3, "key")
    return got.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.sum("l").alias("copies"))


BANKED = ["Which {thing} did {person} ship to {place}?", "{person} in {place} asks for {thing}."]


def _bank(slot: str, table: str, column: str) -> str:
    return f"""{slot}_bank AS (SELECT v, row_number() OVER (ORDER BY md5(v)) - 1 AS pos, count(*) OVER () AS size FROM (
  SELECT DISTINCT CAST({column} AS VARCHAR) AS v FROM {table} WHERE {column} IS NOT NULL))"""


@query(f"""WITH {_bank('person', 'supplier', 's_name')}, {_bank('place', 'nation', 'n_name')}, {_bank('thing', 'part', 'p_name')},
z AS (SELECT 2::HUGEINT * (SELECT max(size) FROM person_bank) * (SELECT max(size) FROM place_bank) * (SELECT max(size) FROM thing_bank) AS total),
f AS (SELECT total, CAST(round(CAST(total AS DOUBLE) * 0.6180339887498949::DOUBLE) AS BIGINT) + 11 AS near FROM z),
g AS (SELECT total, (SELECT min(near + i) FROM range(0, 400) t(i) WHERE gcd(near + i, total::BIGINT) = 1) AS factor FROM f),
i AS (SELECT n, ((n::HUGEINT * factor + 11 * 7919) % total)::BIGINT AS pos FROM g, range(0, 5000) t(n)),
s AS (SELECT (SELECT max(size) FROM person_bank) AS sa, (SELECT max(size) FROM place_bank) AS sb),
d AS (SELECT n, pos % 2 AS t, (pos // 2) % sa AS a, ((pos // 2) // sa) % sb AS b, ((pos // 2) // sa) // sb AS e FROM i, s)
SELECT n, CAST(t AS INTEGER) AS template, replace(replace(replace(CASE t WHEN 0 THEN '{BANKED[0]}' ELSE '{BANKED[1]}' END,
  '{{person}}', p.v), '{{place}}', l.v), '{{thing}}', h.v) AS prompt
FROM d JOIN person_bank p ON p.pos = a JOIN place_bank l ON l.pos = b JOIN thing_bank h ON h.pos = e""")
def expand_banks(x):
    banks = {"person": x.supplier.select("s_name"), "place": x.nation.select("n_name"), "thing": x.part.select("p_name")}
    return S.expand_banks(5000, BANKED, banks, seed=11).select("n", "template", "prompt")


# --- routing -----------------------------------------------------------------
KEYWORD = {"maths": "mathematical_reasoning", "fix_tasks": "code_debugging", "code_tasks": "code_generation",
           "reviews": "sentiment_classification"}
ROUTE_TASKS = " UNION ALL ".join(
    f"SELECT task_id, prompt, '{k}' AS keyword, length(task_id) % 2 = 0 AS agrees FROM {duck(v)}" for v, k in KEYWORD.items())


@query(f"""SELECT task_id, keyword, CASE WHEN agrees THEN keyword ELSE 'logical_deductive_reasoning' END AS top,
  CASE WHEN NOT agrees THEN 'tool' WHEN keyword = 'code_generation' THEN 'assist'
       WHEN keyword = 'code_debugging' THEN CASE WHEN prompt LIKE '%evaluate to%' THEN 'code_trace' ELSE 'assist' END
       WHEN keyword = 'mathematical_reasoning' THEN 'tool' ELSE 'remote' END AS lane FROM ({ROUTE_TASKS})""")
def route(x):
    tasks, predictions = None, None
    for view, category in KEYWORD.items():
        v = x.view(view).select("task_id", "prompt")
        top = F.when(F.length("task_id") % 2 == 0, category).otherwise("logical_deductive_reasoning")
        p = v.select("task_id", F.array(top).alias("labels"))
        tasks = v if tasks is None else tasks.unionByName(v)
        predictions = p if predictions is None else predictions.unionByName(p)
    return T.route(tasks, predictions, remote=False).select("task_id", "keyword", "top", "lane")


@query(f"""SELECT task_id, CASE category WHEN 'logical_deductive_reasoning' THEN 'xhigh' WHEN 'code_debugging' THEN 'xhigh' ELSE 'none' END AS policy_effort,
  CASE category WHEN 'code_debugging' THEN 'coder' ELSE 'default' END AS model, category IN ('mathematical_reasoning', 'logical_deductive_reasoning') AS uses_code,
  CASE category WHEN 'factual_knowledge' THEN 'Answer directly' WHEN 'text_summarisation' THEN 'Obey the stated' WHEN 'code_debugging' THEN 'State the one-l' END AS system
FROM {duck('planned')}""")
def attach_policy(x):
    from gatehouse.functions.fixed import HIGH_EFFORT
    out = T.attach_policy(x.view("planned").drop("effort"), HIGH_EFFORT, {"code_debugging": "coder"})
    return out.select("task_id", c("effort").alias("policy_effort"), "model", "uses_code",
                      F.substr("system", F.lit(1), F.lit(15)).alias("system"))


@query("""SELECT doc_id, CASE WHEN n_chars >= 1500 AND quality = 1 THEN CASE WHEN n_chars / 10000 > 0.6 THEN 'long|good' ELSE 'good|long' END
  WHEN n_chars >= 1500 THEN 'long' WHEN quality = 1 THEN 'good' ELSE 'factual_knowledge' END AS labels FROM (
  SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id))""")
def top_labels(x):
    rows = x.documents.join(x.labels, "doc_id")
    scores = F.array(F.struct(F.lit("long").alias("label"), (c("n_chars") / 10000).alias("score")),
                     F.struct(F.lit("good").alias("label"), (c("quality") * 0.6).alias("score")))
    labels = T.top_labels(scores, {"long": 0.15, "good": 0.5}, F.lit("What is this about?"))
    return rows.select("doc_id", joined(labels).alias("labels"))


def _sources(x):
    t = x.view("turns")
    local = t.where(F.length("answer") > 600).select("task_id", "answer")
    remote = t.where(F.length("prompt") > 200).select("task_id", F.when(c("turn") > 0, F.upper("prompt")).otherwise("  ").alias("answer"))
    rejects = t.where(F.length("answer") < 300).select("task_id", F.lit("rejected text").alias("answer"))
    return t, local, remote, rejects


MERGED = f"""SELECT task_id, CASE WHEN r THEN upper(prompt) WHEN l THEN {D.trim('answer')} WHEN j THEN 'rejected text' ELSE 'Unable to answer.' END AS answer,
  CASE WHEN r THEN 'remote' WHEN l THEN 'local' WHEN j THEN 'rejected' ELSE 'apology' END AS source FROM (
  SELECT *, length(prompt) > 200 AND turn > 0 AS r, length(answer) > 600 AS l, length(answer) < 300 AS j FROM {duck('turns')})"""


@query(f"SELECT task_id, source, length(answer) AS chars, source IN ('rejected', 'apology') AS is_fallback FROM ({MERGED})".replace(
    "upper(prompt)", D.trim("prompt")))
def merge_answers(x):
    t, local, remote, rejects = _sources(x)
    out = T.merge_answers(t.select("task_id", "prompt"), [("local", local), ("remote", remote)], rejects)
    chars = F.when(c("source") == "remote", F.length(F.regexp_replace("prompt", r"^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$", ""))).otherwise(
        F.length("answer"))
    return out.select("task_id", "source", chars.cast("bigint").alias("chars"), "is_fallback")


@query(f"SELECT task_id FROM {duck('turns')} WHERE NOT (length(prompt) > 200 AND turn > 0)")
def missing_tasks(x):
    t, _, remote, _ = _sources(x)
    return T.missing_tasks(t, remote).select("task_id")


@query(f"SELECT count(*) AS missing, count(*) = 0 AS complete FROM {duck('turns')} WHERE NOT (length(prompt) > 200 AND turn > 0)")
def is_complete(x):
    t, _, remote, _ = _sources(x)
    return T.is_complete(t, remote)


@query(f"""SELECT task_id, CASE WHEN second THEN 'second try' WHEN reason IS NULL THEN answer END AS answer,
  CAST(CASE WHEN second THEN 2 WHEN reason IS NULL THEN 1 END AS INTEGER) AS attempt, CAST(CASE WHEN reason IS NULL THEN 0 ELSE 1 END AS BIGINT) AS dropped,
  NOT second AND reason IS NOT NULL AS requeue
FROM (SELECT task_id, answer, reason, reason IS NOT NULL AND o_orderkey % 6 <> 1 AS second FROM {duck('travel')} JOIN ({MEETING_SQL}) USING (o_orderkey))""")
def screen_and_requeue(x):
    v = x.view("travel")
    first = v.select("task_id", F.lit(1).alias("attempt"), "answer")
    failed = T.screen_and_requeue(v, first).where("requeue").select("task_id")
    second = v.where(c("o_orderkey") % 6 != 1).join(failed, "task_id", "left_semi").select(
        "task_id", F.lit(2).alias("attempt"), F.lit("second try").alias("answer"))
    return T.screen_and_requeue(v, first.unionByName(second))


@query(f"SELECT task_id, length(answer) < 300 AS has_reject FROM {duck('turns')}")
def sweep_order(x):
    t, _, _, rejects = _sources(x)
    return T.sweep_order(t.withColumn("pos", c("conv_id") * 1000 + c("turn")), rejects).select("task_id", "has_reject")


@query(f"""SELECT call_id, traces FROM (SELECT *, row_number() OVER (PARTITION BY run_id, error ORDER BY call_id DESC) AS r FROM {duck('calls')}) c
LEFT JOIN (SELECT run_id AS tr, error AS te, string_agg('trace of ' || call_id, '|' ORDER BY call_id) AS traces FROM {duck('calls')} WHERE tool GROUP BY ALL) t
ON c.run_id = t.tr AND c.error = t.te AND c.r = 1""")
def attach_tool_traces(x):
    calls = x.view("calls").select("call_id", c("error").cast("int").alias("turn"), F.array("run_id").alias("task_ids"), "tool")
    traces = calls.where("tool").select("turn", "task_ids", c("call_id").alias("index"), F.concat(F.lit("trace of "), "call_id").alias("trace"))
    return T.attach_tool_traces(calls.drop("tool"), traces).select("call_id", joined(c("traces")).alias("traces"))


# --- batches -----------------------------------------------------------------
PLAN_SQL = f"""WITH t AS (SELECT *, category IN ('mathematical_reasoning', 'logical_deductive_reasoning') AS code,
    CASE WHEN category = 'logical_deductive_reasoning' THEN category ELSE '' END AS focus FROM {duck('planned')}),
  g AS (SELECT run_id, effort, code, focus, min(pos) AS start, count(*) AS n FROM t GROUP BY ALL),
  d AS (SELECT *, min(start) FILTER (NOT code) OVER (PARTITION BY run_id) AS direct FROM g),
  h AS (SELECT *, code AND n <= 2 AND direct IS NOT NULL AS folded, CASE WHEN code AND n <= 2 AND direct IS NOT NULL THEN direct ELSE start END AS home FROM d),
  r AS (SELECT t.*, h.home, CASE WHEN folded THEN h.start ELSE -1 END AS rk FROM t JOIN h USING (run_id, effort, code, focus)),
  p AS (SELECT *, row_number() OVER (PARTITION BY run_id, home ORDER BY rk, pos) AS place FROM r),
  k AS (SELECT run_id, home, floor((place - 1) / 40) AS chunk, string_agg(task_id, ',' ORDER BY place) AS task_ids, count(*) AS size,
        arg_min(effort, place) AS effort, arg_min(code, place) AS uses_code FROM p GROUP BY ALL)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY home, chunk) - 1 AS batch_index, task_ids, size, effort, uses_code FROM k"""


@query(PLAN_SQL)
def plan_batches(x):
    plan = T.plan_batches(x.view("planned"))
    return plan.withColumn("task_ids", joined(c("task_ids"), ","))


@query(f"""SELECT run_id, batch_index, CAST(least(greatest(CASE WHEN uses_code THEN greatest(600 + size * 220, 3072) ELSE 600 + size * 220 END, 2048), 6000) AS BIGINT) AS max_tokens
FROM ({PLAN_SQL})""")
def batch_policy(x):
    return T.batch_policy(T.plan_batches(x.view("planned"))).select("run_id", "batch_index", "max_tokens")


@query(f"""SELECT run_id, pos, CAST(floor((sum(tokens) OVER (PARTITION BY run_id ORDER BY pos) - tokens) / 1000000) AS BIGINT) AS chunk FROM {duck('planned')}""")
def pack_by_token_budget(x):
    return T.pack_by_token_budget(x.view("planned"), 1_000_000).select("run_id", "pos", "chunk")


def _sheets(x):
    tasks = x.view("planned")
    plan = T.plan_batches(tasks).select("run_id", "batch_index", F.explode("task_ids").alias("task_id"))
    return T.to_task_sheet(tasks.join(plan, ["run_id", "task_id"]))


SHEET_ROWS = f"""SELECT b.run_id, b.batch_index, p.pos, p.task_id, p.prompt, k AS known, coalesce(k, 'TASK') AS kind FROM (
    SELECT run_id, batch_index, unnest(string_split(task_ids, ',')) AS task_id FROM ({PLAN_SQL})) b JOIN (
    SELECT *, CASE category WHEN 'factual_knowledge' THEN 'FACTUAL' WHEN 'text_summarisation' THEN 'SUMMARY' WHEN 'code_debugging' THEN 'CODE_DEBUG' END AS k
    FROM {duck('planned')}) p ON b.run_id = p.run_id AND b.task_id = p.task_id"""


@query(f"""SELECT run_id, batch_index, kind, string_agg(task_id, ',' ORDER BY pos) AS task_ids, 'TASK TYPE: ' || kind || chr(10)
  || string_agg('== ' || task_id || coalesce(' ' || known, '') || ' ==' || chr(10) || trim(prompt) || chr(10), '' ORDER BY pos) AS sheet
FROM ({SHEET_ROWS}) GROUP BY run_id, batch_index, kind""")
def to_task_sheet(x):
    return _sheets(x).withColumn("task_ids", joined(c("task_ids"), ","))


@query(f"""SELECT run_id, batch_index, 'Task types and exact ids: ' || string_agg(line, '; ' ORDER BY o) || '. Return exactly one answer for every listed id.' AS manifest
FROM (SELECT run_id, batch_index, kind || '=[' || string_agg(task_id, ',' ORDER BY pos) || ']' AS line,
      CASE kind WHEN 'FACTUAL' THEN 0 WHEN 'SUMMARY' THEN 2 WHEN 'CODE_DEBUG' THEN 4 ELSE 6 END AS o FROM ({SHEET_ROWS}) GROUP BY run_id, batch_index, kind)
GROUP BY run_id, batch_index""")
def sheet_manifest(x):
    return T.sheet_manifest(_sheets(x))

"""Queries of the gates, checks, rewards and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatehouse.functions import code as C
from gatehouse.operators import gates as G
from gatehouse.operators import rewards as W
from gatehouse.operators import routing as T
from gatehouse.operators import scoring as S

from . import duck as D
from .base import duck, query
from .text_queries import IGNORED, RATIO_SQL, SPANS_SQL, signal_sql

c = F.col

# --- sentiment ---------------------------------------------------------------
SENTIMENT_SQL = f"""SELECT doc_id, CASE WHEN label = '' THEN 'no_leading_label' WHEN length(why) < 15 THEN 'no_justification'
  WHEN regexp_matches(prompt, '{D.CONTRAST}') AND NOT regexp_matches(answer, '{D.CONTRAST}') THEN 'one_sided_reason'
  WHEN label = 'Negative' AND regexp_matches(regexp_replace(tail, '{D.UNPRAISE}', '', 'g'), '{D.PRAISE}') THEN 'praise_labelled_negative'
  END AS reason
FROM (SELECT *, regexp_extract(answer, '^(Positive|Negative|Neutral|Mixed)', 1) AS label,
        {D.trim("regexp_replace(answer, '^(?:Positive|Negative|Neutral|Mixed)[.]?', '')")} AS why,
        nullif(regexp_extract({D.quoted('prompt')}, '(?s)^.*{D.CONTRAST}(.*)$', 2), '') AS tail FROM {duck('reviews')})"""


@query(SENTIMENT_SQL)
def gate_sentiment(x):
    return x.view("reviews").select("doc_id", G.gate_sentiment(c("prompt"), c("answer")).alias("reason"))


# --- summaries ---------------------------------------------------------------
UNITS = (f"list_transform(list_filter(list_transform(string_split(answer, chr(10)), lambda e: {D.trim('e')}), "
         "lambda e: regexp_matches(e, '^[-•*]')), lambda e: regexp_replace(e, '^[-•* ]+', ''))")
SHAPE = (f"CASE WHEN len({UNITS}) <> 3 THEN 'unit_count: ' || len({UNITS}) || ' of 3' "
         f"WHEN len(list_filter({UNITS}, lambda u: len({D.fields('u')}) > 12)) > 0 THEN 'unit_over_cap' END")
RUNS = f"flatten(list_transform({UNITS}, lambda u: {D.grams('u')}))"


@query(f"SELECT doc_id, {SHAPE} AS reason FROM {duck('summaries')}")
def gate_summary_shape(x):
    return x.view("summaries").select("doc_id", G.gate_summary_shape(c("prompt"), c("answer")).alias("reason"))


ECHO_SQL = f"""SELECT s.doc_id, CASE WHEN e.doc_id IS NOT NULL THEN 'source_echo' END AS reason
FROM {duck('summaries')} s LEFT JOIN (
  SELECT DISTINCT a.doc_id FROM (SELECT doc_id, unnest({D.grams('passage')}) AS g FROM {duck('summaries')}) a
  JOIN (SELECT doc_id, unnest({RUNS}) AS g FROM {duck('summaries')}) b ON a.doc_id = b.doc_id AND a.g = b.g) e
ON s.doc_id = e.doc_id"""


@query(ECHO_SQL)
def gate_summary_echo(x):
    return x.view("summaries").select("doc_id", G.gate_summary_echo(c("prompt"), c("answer")).alias("reason"))


@query(f"""SELECT doc_id, CASE WHEN turn IS NULL THEN NULL
  WHEN NOT list_has_any(list_filter({D.norm('substr(q, 1, turn)')}, lambda w: length(w) >= 5), said) THEN 'omits_before_pivot'
  WHEN NOT list_has_any(list_filter({D.norm('substr(q, turn + 1)')}, lambda w: length(w) >= 5), said) THEN 'omits_after_pivot' END AS reason
FROM (SELECT doc_id, q, said, CASE WHEN p > floor(length(q) / 5) AND p < floor(length(q) * 4 / 5) THEN p END AS turn
  FROM (SELECT doc_id, q, position('However' IN q) - 1 AS p, list_filter({D.norm('answer')}, lambda w: length(w) >= 5) AS said
    FROM (SELECT doc_id, answer, {D.quoted('prompt')} AS q FROM {duck('pivots')})))""")
def gate_summary_pivot(x):
    return x.view("pivots").select("doc_id", G.gate_summary_pivot(c("prompt"), c("answer")).alias("reason"))


# --- facts and entities ------------------------------------------------------
FACT_SQL = f"""SELECT doc_id, CASE WHEN len(regexp_split_to_array({D.trim('answer')}, '[.!?][\\t\\n\\f\\r ]+')) > 4 THEN 'too_many_sentences'
  WHEN lower(answer) LIKE '%i don''t know%' OR lower(answer) LIKE '%i cannot%' THEN 'refusal'
  WHEN doc_id % 3 = 0 AND lower(answer) NOT LIKE '%ram%' THEN 'term_missing: RAM'
  WHEN doc_id % 3 = 0 AND lower(answer) NOT LIKE '%the rom%' THEN 'term_missing: the ROM'
  WHEN doc_id % 3 = 1 AND lower(answer) NOT LIKE '%a lease%' THEN 'term_missing: a lease'
  WHEN doc_id % 3 = 1 AND lower(answer) NOT LIKE '%a rental agreement%' THEN 'term_missing: a rental agreement' END AS reason
FROM {duck('facts')}"""


@query(FACT_SQL)
def gate_factual(x):
    return x.view("facts").select("doc_id", G.gate_factual(c("prompt"), c("answer")).alias("reason"))


def _label_sql(source: str) -> str:
    spans = SPANS_SQL.format(col="answer", src=source)
    return f"""SELECT e.o_orderkey, coalesce(f.reason, CASE WHEN note <> '' AND len(acr) > 0 THEN 'organisation_in_note: ' || acr[1] END) AS reason
  FROM (SELECT *, list_filter(regexp_extract_all(note, '\\b[A-Z]{{2,}}\\b', 0), lambda w: w NOT IN ({IGNORED})) AS acr
        FROM (SELECT o_orderkey, regexp_extract(answer, '(?s)(Outside the inventory.*)', 1) AS note FROM {source})) e
  LEFT JOIN (SELECT o_orderkey, arg_min(reason, pos) AS reason FROM (
    SELECT o_orderkey, pos, CASE WHEN label = 'LOCATION' AND (regexp_matches(span, '^[A-Z]{{2,}}\\s+[A-Z]') OR regexp_matches(span, '^[A-Z]{{2,}}$'))
        THEN 'acronym_as_location: ' || span
      WHEN (lower(span) LIKE '%program%' OR lower(span) LIKE '%mission%') AND label <> 'ORGANIZATION' THEN 'programme_mislabelled: ' || span
      WHEN label = 'DATE' AND NOT regexp_matches(span, '(?i)\\d|january|february|march|april|may|june|july|august|september|october|november|december')
        THEN 'not_a_date: ' || span END AS reason FROM ({spans})) WHERE reason IS NOT NULL GROUP BY o_orderkey) f
  ON e.o_orderkey = f.o_orderkey"""


@query(_label_sql(duck("entities")))
def gate_entity_labels(x):
    return x.view("entities").select("o_orderkey", G.gate_entity_labels(c("answer")).alias("reason"))


_sig = signal_sql("prompt")
_absent = {k: f"list_filter({v}, lambda s: NOT contains(answer, s))" for k, v in _sig.items()}


@query(f"""SELECT e.o_orderkey, coalesce('omits_year: ' || ({_absent['years']})[1],
  'omits_name: ' || (list_filter({_absent['runs']}, lambda r: NOT contains(answer, regexp_replace(r, '^[^ ]* ', ''))))[1],
  'omits_capital: ' || ({_absent['capitals']})[1], 'omits_acronym: ' || ({_absent['acronyms']})[1], l.reason) AS reason
FROM {duck('entities')} e JOIN ({_label_sql(duck('entities'))}) l ON e.o_orderkey = l.o_orderkey""")
def gate_entities(x):
    return x.view("entities").select("o_orderkey", G.gate_entities(c("prompt"), c("answer")).alias("reason"))


# --- code --------------------------------------------------------------------
CODE_SQL = f"""SELECT p_partkey, CASE
  WHEN p_partkey % 5 < 4 AND NOT contains(answer, 'def ' || name) THEN 'function_absent: ' || name
  WHEN p_partkey % 5 = 4 AND NOT contains(answer, 'def ') THEN 'no_definition'
  WHEN p_partkey % 6 = 2 THEN 'does_not_parse'
  WHEN p_partkey % 5 = 4 THEN 'no_function_named' WHEN p_partkey % 5 = 3 THEN 'no_example_call' END AS reason
FROM {duck('code_tasks')}"""
FIX_SQL = f"""SELECT p_partkey, CASE WHEN p_partkey % 9 = 8 THEN 'prompt_without_function' WHEN p_partkey % 6 = 5 THEN 'no_definition'
  WHEN p_partkey % 6 = 1 THEN 'no_cause_line' WHEN p_partkey % 6 = 3 THEN 'function_renamed: ' || name
  WHEN p_partkey % 6 = 2 THEN 'unchanged_code' WHEN p_partkey % 6 = 4 THEN 'does_not_parse' END AS reason
FROM {duck('fix_tasks')}"""


@query(CODE_SQL)
def gate_code_static(x):
    p, a = c("prompt"), c("answer")
    rows = x.view("code_tasks").withColumn("parses", C.python_parses(G.code_to_parse(p, a)))
    return rows.select("p_partkey", G.gate_code_static(p, a, c("parses")).alias("reason"))


@query(FIX_SQL)
def gate_code_fix_static(x):
    p, a = c("prompt"), c("answer")
    rows = x.view("fix_tasks").withColumn("parses", C.python_parses(G.fix_to_parse(p, a)))
    return rows.select("p_partkey", G.gate_code_fix_static(p, a, c("parses")).alias("reason"))


@query(f"""WITH s AS (SELECT p_partkey, replace(replace(answer, ' ', ''), '''', '"') AS a, total, replace(items, ' ', '') AS items FROM {duck('traces')})
SELECT p_partkey, CASE WHEN NOT contains(a, 'total') THEN 'name_absent: total'
  WHEN NOT regexp_matches(a, 'total.{{0,' || 85 || '}}' || total) THEN 'value_not_near: total'
  WHEN NOT contains(a, 'items') THEN 'name_absent: items'
  WHEN NOT contains(a, items) THEN 'value_not_near: items' END AS reason FROM s""")
def gate_value_near_name(x):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    truth = F.array(pair("total", c("total")), pair("items", c("items")))
    return x.view("traces").select("p_partkey", G.gate_value_near_name(c("answer"), truth).alias("reason"))


# --- tool answers ------------------------------------------------------------
def _places(t: str) -> str:
    return f"length(regexp_extract({t}, '\\.([0-9]*)$', 1))"


GROUND_SQL = f"""WITH t AS (SELECT o_orderkey, prompt, answer, stdout, {D.numtok('answer')} AS said, {D.numtok('stdout')} AS outs FROM {duck('maths')}),
  n AS (SELECT *, list_transform(said, lambda s: len(list_filter(outs, lambda o: abs(CAST(o AS DOUBLE) - CAST(s AS DOUBLE)) < 1e-9
      OR ({_places('o')} > 3 AND abs(round(CAST(o AS DOUBLE), CAST({_places('s')} AS INTEGER)) - CAST(s AS DOUBLE)) < 1e-9))) > 0) AS ok FROM t),
  z AS (SELECT *, list_filter(range(1, len(said) + 1), lambda i: NOT ok[i] AND length(ltrim(said[i], '0')) >= 2) AS stray FROM n)
SELECT o_orderkey, CASE WHEN len(said) = 0 THEN CASE WHEN NOT contains(lower(answer), lower(split_part(stdout, chr(10), 1)))
      THEN 'output_not_echoed' END
  WHEN len(stray) > 0 THEN 'number_not_derivable: ' || said[stray[1]]
  WHEN NOT list_bool_or(ok) AND len(outs) > 0 THEN 'output_ignored' END AS reason FROM z"""


@query(GROUND_SQL)
def gate_grounded(x):
    return x.view("maths").select("o_orderkey", G.gate_grounded(c("answer"), c("stdout")).alias("reason"))


PLAUSIBLE = f"""CASE WHEN regexp_matches(lower(prompt), 'how many|how much|remain|total cost|how far') AND regexp_matches(answer, '(?s)^[^0-9]*-[0-9]')
    THEN 'negative_amount'
  WHEN lower(prompt) LIKE '%total cost%' AND answer NOT LIKE '%$%' AND lower(answer) NOT LIKE '%cost%' THEN 'cost_missing'
  WHEN length(prompt) - length(replace(prompt, '?', '')) >= 2 AND len({D.numtok('answer')}) = 1 THEN 'one_number_for_two_questions'
  WHEN answer LIKE '%£%' AND prompt NOT LIKE '%£%' AND regexp_matches(prompt, '[$€]') THEN 'foreign_currency: £'
  WHEN answer LIKE '%€%' AND prompt NOT LIKE '%€%' AND regexp_matches(prompt, '[$£]') THEN 'foreign_currency: €'
  WHEN answer LIKE '%$%' AND prompt NOT LIKE '%$%' AND regexp_matches(prompt, '[£€]') THEN 'foreign_currency: $' END"""


@query(f"SELECT o_orderkey, {PLAUSIBLE} AS reason FROM {duck('maths')}")
def gate_plausible(x):
    return x.view("maths").select("o_orderkey", G.gate_plausible(c("prompt"), c("answer")).alias("reason"))


@query(f"""SELECT r.o_orderkey, CASE WHEN NOT exact THEN NULL
  WHEN NOT contains(replace(answer, ',', ''), CAST(unit * a AS VARCHAR)) THEN 'share_missing: ' || unit * a
  WHEN NOT contains(replace(answer, ',', ''), CAST(unit * b AS VARCHAR)) THEN 'share_missing: ' || unit * b
  WHEN NOT contains(replace(answer, ',', ''), CAST(unit * c AS VARCHAR)) THEN 'share_missing: ' || unit * c END AS reason
FROM ({RATIO_SQL}) r JOIN {duck('ratios')} v ON r.o_orderkey = v.o_orderkey""")
def gate_ratio_shares(x):
    return x.view("ratios").select("o_orderkey", G.gate_ratio_shares(c("prompt"), c("answer")).alias("reason"))


def _largest(t: str) -> str:
    return f"coalesce(list_max(list_transform({D.numtok(t)}, lambda v: CAST(v AS DOUBLE))), 0)"


MAGNITUDE = """CASE WHEN p >= 10000 AND a > 0 AND a < p / 20 THEN 'far_below_prompt_scale'
  WHEN p >= 100 AND a > p * 5 THEN 'far_above_prompt_scale' END"""


@query(f"SELECT o_orderkey, {MAGNITUDE} AS reason FROM (SELECT o_orderkey, {_largest('prompt')} AS p, {_largest('answer')} AS a FROM {duck('maths')})")
def gate_magnitude(x):
    return x.view("maths").select("o_orderkey", G.gate_magnitude(c("prompt"), c("answer")).alias("reason"))


LIST_ECHO = """CASE WHEN regexp_extract(split_part(stdout, chr(10), 1), '(\\[[^\\[\\]]+\\])', 1) <> ''
  AND NOT contains(replace(answer, ' ', ''), replace(regexp_extract(split_part(stdout, chr(10), 1), '(\\[[^\\[\\]]+\\])', 1), ' ', ''))
  THEN 'list_not_echoed' END"""


@query(f"SELECT o_orderkey, {LIST_ECHO} AS reason FROM {duck('maths')}")
def gate_list_echo(x):
    return x.view("maths").select("o_orderkey", G.gate_list_echo(c("answer"), c("stdout")).alias("reason"))


MEETING_SQL = f"""WITH f AS (SELECT t.*, 540 + o_custkey % 30 AS d1, 600 + o_custkey % 25 AS d2, 60 + o_custkey % 40 AS v1,
      51 + o_custkey % 35 AS v2, 400 + o_orderkey % 300 AS dist,
      try_cast(nullif(regexp_extract(answer, '\\b(\\d{{1,2}}):(\\d{{2}})\\b', 1), '') AS BIGINT) AS hh,
      try_cast(nullif(regexp_extract(answer, '\\b(\\d{{1,2}}):(\\d{{2}})\\b', 2), '') AS BIGINT) AS mm
      FROM {duck('travel')} t JOIN orders USING (o_orderkey)), m AS (SELECT *, hh * 60 + mm AS meet FROM f)
SELECT o_orderkey, CASE WHEN hh IS NULL THEN 'no_clock_time' WHEN hh >= 24 OR mm >= 60 THEN 'malformed_clock_time'
  WHEN meet <= greatest(d1, d2) OR meet >= least(d1 + floor(dist / v1 * 60), d2 + floor(dist / v2 * 60)) THEN 'outside_physical_bounds'
  WHEN len(list_filter({D.numtok('answer')}, lambda v: abs(CAST(v AS DOUBLE) - v1 * (meet - d1) / 60) <= dist * 0.02)) = 0
    THEN 'distance_inconsistent' END AS reason FROM m"""


@query(MEETING_SQL)
def gate_meeting_time(x):
    return x.view("travel").select("o_orderkey", G.gate_meeting_time(c("prompt"), c("answer")).alias("reason"))


@query(f"""SELECT m.o_orderkey, coalesce(g.reason, {PLAUSIBLE.replace('answer', 'm.answer').replace('(prompt', '(m.prompt')
  .replace('AND prompt', 'AND m.prompt')}, s.reason, {LIST_ECHO.replace('answer', 'm.answer').replace('(stdout', '(m.stdout')}) AS reason
FROM {duck('maths')} m JOIN ({GROUND_SQL}) g ON m.o_orderkey = g.o_orderkey
JOIN (SELECT o_orderkey, {MAGNITUDE} AS reason FROM (SELECT o_orderkey, {_largest('prompt')} AS p, {_largest('answer')} AS a FROM {duck('maths')})) s
ON m.o_orderkey = s.o_orderkey""")
def gate_tool_answer(x):
    return x.view("maths").select("o_orderkey", G.gate_tool_answer(c("prompt"), c("answer"), c("stdout")).alias("reason"))


# --- content and flags -------------------------------------------------------
@query(f"""SELECT task_id, family, CASE WHEN family = 'logical' AND len({D.fields('answer')}) < 8 THEN 'too_short'
  WHEN family = 'maths' AND NOT regexp_matches(answer, '[0-9]') THEN 'no_number' END AS reason
FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'logical' ELSE 'maths' END AS family FROM {duck('turns')})""")
def gate_min_content(x):
    fam = F.when(c("conv_id") % 2 == 0, "logical").otherwise("maths")
    return x.view("turns").select("task_id", fam.alias("family"), G.gate_min_content(fam, c("answer")).alias("reason"))


@query("""SELECT conv_id, turn, trim(t) = '' OR contains(t, repeat(chr(96), 6)) AS degenerate
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN text || repeat(chr(96), 6) ELSE text END AS t FROM conversations)""")
def flag_degenerate(x):
    t = F.when(c("turn") % 3 == 2, F.concat(c("text"), F.repeat(F.lit("`"), 6))).otherwise(c("text"))
    return x.conversations.select("conv_id", "turn", G.flag_degenerate(t).alias("degenerate"))


@query("SELECT doc_id, doc_id % 3 = 1 OR regexp_matches(lower(text), 'allergic|vegetarian|afraid of') AS outside FROM documents")
def flag_semantic_clue(x):
    t = F.when(c("doc_id") % 3 == 1, F.concat("text", F.lit(" Nina is Allergic to fur."))).otherwise(c("text"))
    return x.documents.select("doc_id", G.flag_semantic_clue(t).alias("outside"))


ALL_FAMILIES = f"""SELECT 'sentiment' AS family, CAST(doc_id AS BIGINT) AS id, reason FROM ({SENTIMENT_SQL})
  UNION ALL SELECT 'factual', doc_id, reason FROM ({FACT_SQL})
  UNION ALL SELECT 'code_generation', p_partkey, reason FROM ({CODE_SQL})
  UNION ALL SELECT 'code_fix', p_partkey, reason FROM ({FIX_SQL})
  UNION ALL SELECT 'maths', o_orderkey, CASE WHEN NOT regexp_matches(answer, '[0-9]') THEN 'no_number' END FROM {duck('maths')}"""


def _families(x):
    out = None
    for family, view, key in [("sentiment", "reviews", "doc_id"), ("factual", "facts", "doc_id"),
                              ("code_generation", "code_tasks", "p_partkey"), ("code_fix", "fix_tasks", "p_partkey"),
                              ("maths", "maths", "o_orderkey")]:
        v = x.view(view).select(F.lit(family).alias("family"), c(key).cast("bigint").alias("id"), "prompt", "answer")
        out = v if out is None else out.unionByName(v)
    return out


FAMILIES = ["sentiment", "factual", "code_generation", "code_fix", "maths"]


@query(f"SELECT family, id, reason, reason IS NULL AS accepted FROM ({ALL_FAMILIES})")
def gate(x):
    return G.gate(_families(x), families=FAMILIES).select("family", "id", "reason", "accepted")


@query(f"""SELECT family, code, CAST(n AS BIGINT) AS rows, round(n / sum(n) OVER (PARTITION BY family), 9) AS share FROM (
  SELECT family, coalesce(split_part(reason, ':', 1), 'accepted') AS code, count(*) AS n FROM ({ALL_FAMILIES}) GROUP BY ALL)""")
def reject_reasons(x):
    return S.reject_reasons(G.gate(_families(x), families=FAMILIES)).withColumn("share", F.round("share", 9))


# --- checks ------------------------------------------------------------------
GOLDEN_PASS = """CASE WHEN validate = 'llm' THEN NULL WHEN validate = 'contains_ci' THEN contains(lower(answer), lower(expected))
  WHEN validate IN ('contains_cs', 'code_check') THEN contains(answer, expected) WHEN validate = 'exact' THEN lower(answer) = lower(expected)
  WHEN validate = 'numeric' THEN CAST(regexp_extract(answer, '(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) = try_cast(expected AS DOUBLE)
  WHEN validate = 'ner' THEN len(list_filter(string_split(expected, ','), lambda p: NOT contains(lower(answer),
       lower(trim(split_part(p, ':', 1)))))) = 0 ELSE false END"""


@query(f"SELECT task_id, validate, {GOLDEN_PASS} AS pass FROM {duck('golden')}")
def check_golden(x):
    return x.view("golden").select("task_id", "validate", S.check_golden(c("answer"), c("expected"), c("validate")).alias("pass"))


@query(f"""SELECT task_id, lower({D.trim('expected')}) = lower({D.trim('answer')}) OR len(list_filter(regexp_extract_all(expected,
  '[A-Za-z]+|\\$?[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?%?', 0), lambda t: NOT contains(answer, t))) <= 1 AS pass FROM {duck('golden')}""")
def check_key_tokens(x):
    return x.view("golden").select("task_id", S.check_key_tokens(c("expected"), c("answer")).alias("pass"))


KEPT = f"list_filter(string_split(regexp_replace({D.trim('answer')}, '([.!?]){D.SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query(f"""SELECT 'ner' AS family, o_orderkey AS id, o_orderkey % 8 NOT IN (1, 2, 3) AS ok FROM orders
UNION ALL SELECT 'sentiment', doc_id, starts_with(answer, gold) FROM {duck('reviews')}
UNION ALL SELECT 'factual', doc_id, {D.trim('answer')} <> '' AND len({KEPT}) <= 4 FROM {duck('facts')}
UNION ALL SELECT 'summarisation', doc_id, len({UNITS}) = 3 FROM {duck('summaries')}
UNION ALL SELECT 'code_fix', p_partkey, reason IS NULL FROM ({FIX_SQL})""")
def check_behaviour(x):
    none = F.lit(None).cast("string")
    parts = [
        x.view("entities").select(F.lit("ner").alias("family"), c("o_orderkey").alias("id"), "prompt", "gold", "answer"),
        x.view("reviews").select(F.lit("sentiment").alias("family"), c("doc_id").alias("id"), "prompt", "gold", "answer"),
        x.view("facts").select(F.lit("factual").alias("family"), c("doc_id").alias("id"), "prompt", none.alias("gold"), "answer"),
        x.view("summaries").select(F.lit("summarisation").alias("family"), c("doc_id").alias("id"), "prompt",
                                   none.alias("gold"), "answer"),
        x.view("fix_tasks").select(F.lit("code_fix").alias("family"), c("p_partkey").alias("id"), "prompt",
                                   none.alias("gold"), "answer"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    code = F.when(c("family") == "code_fix", G.fix_to_parse(c("prompt"), c("answer")))
    rows = rows.withColumn("parses", C.python_parses(code))
    return rows.select("family", "id", S.check_behaviour(
        c("family"), c("prompt"), c("gold"), c("answer"), c("parses")).alias("ok"))


# --- retries -----------------------------------------------------------------
@query(f"""SELECT o_orderkey AS id, CASE WHEN use THEN 2 ELSE CAST(1 AS BIGINT) END AS attempt, use OR ok1 AS ok,
  CASE WHEN use THEN answer || ' again' ELSE answer END AS answer FROM (
  SELECT o_orderkey, answer, ok1, NOT ok1 AND o_orderkey % 3 <> 1 AND n2 >= n1 AS use FROM (
    SELECT o_orderkey, answer, reason IS NULL AS ok1, len({D.numtok('stdout')}) AS n1,
           len({D.numtok("CASE WHEN o_orderkey % 2 = 0 THEN stdout ELSE 'none' END")}) AS n2
    FROM {duck('maths')} m JOIN ({GROUND_SQL}) g USING (o_orderkey)))""")
def accept_retry(x):
    m = x.view("maths")
    first = m.select(c("o_orderkey").alias("task_id"), F.lit(1).alias("attempt"), "answer", "stdout",
                     G.gate_grounded(c("answer"), c("stdout")).isNull().alias("ok"))
    retry = m.select(c("o_orderkey").alias("task_id"), F.lit(2).alias("attempt"), F.concat("answer", F.lit(" again")).alias("answer"),
                     F.when(c("o_orderkey") % 2 == 0, c("stdout")).otherwise("none").alias("stdout"),
                     (c("o_orderkey") % 3 != 1).alias("ok"))
    return T.accept_retry(first.unionByName(retry)).select(c("task_id").alias("id"), "attempt", "ok", "answer")


# --- rewards -----------------------------------------------------------------
NAMES = """list_filter(list_distinct(list_concat(regexp_extract_all(prompt, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b', 0),
  regexp_extract_all(prompt, '\\b[A-Z]{2,}(?:\\s+[A-Z]{2,})?\\b', 0))), lambda n: length(n) > 2)"""


@query(f"""SELECT family, id, CAST(reward AS DOUBLE) AS reward FROM (SELECT 'sentiment' AS family, doc_id AS id, round(CASE WHEN regexp_matches(answer, '^(Positive|Negative|Neutral|Mixed)') THEN 0.4 ELSE 0 END
    + CASE WHEN answer LIKE '%.%' AND len({D.fields('answer')}) >= 6 THEN 0.2 ELSE 0 END + 0.4 * (doc_id % 2), 6) AS reward FROM {duck('reviews')}
UNION ALL SELECT 'factual', doc_id, round(CASE WHEN len({KEPT}) = 0 THEN 0 ELSE 0.3 + CASE WHEN len({KEPT}) <= 4 THEN 0.3 ELSE 0 END
    + CASE WHEN len({D.fields('answer')}) <= 120 THEN 0.1 ELSE 0 END END + 0.4 * (doc_id % 2), 6) FROM {duck('facts')}
UNION ALL SELECT 'code_generation', p_partkey, round(CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE
    CASE WHEN contains(answer, 'def ' || name) THEN 0.25 ELSE 0 END
    + CASE WHEN p_partkey % 6 IN (0, 1, 3, 5) THEN 0.25 + CASE WHEN p_partkey % 5 = 3 THEN 0.25 ELSE 0 END ELSE 0 END END
    + 0.4 * (p_partkey % 2), 6) FROM {duck('code_tasks')}
UNION ALL SELECT 'ner', o_orderkey, round(0.7 * len(list_filter({NAMES}, lambda n: contains(answer, n))) / len({NAMES})
    + CASE WHEN regexp_matches(answer, '[A-Za-z_ ]+:\\s*[^;]+') THEN 0.3 ELSE 0 END + 0.4 * (o_orderkey % 2), 6) FROM {duck('entities')}
UNION ALL SELECT 'code_fix', p_partkey, round(CASE p_partkey % 6 WHEN 1 THEN 0.85 WHEN 5 THEN 0 ELSE 0.5 END + 0.4 * (p_partkey % 2), 6)
  FROM {duck('fix_tasks')}
UNION ALL SELECT 'summarisation', doc_id, round(0.7 * CASE abs(len({UNITS}) - 3) WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0 END
    + 0.3 * CASE WHEN len(list_intersect(list_distinct({D.fields('lower(answer)')}), list_distinct({D.fields('lower(prompt)')})))
        < greatest(8, floor(len({D.fields('prompt')}) / 2)) AND len({D.fields('answer')}) >= 9 THEN 0.5 ELSE 0.2 END + 0.4 * (doc_id % 2), 6)
  FROM {duck('summaries')})""")
def reward(x):
    rows = None
    for family, view, key in [("sentiment", "reviews", "doc_id"), ("factual", "facts", "doc_id"),
                              ("code_generation", "code_tasks", "p_partkey"), ("summarisation", "summaries", "doc_id"),
                              ("ner", "entities", "o_orderkey"), ("code_fix", "fix_tasks", "p_partkey")]:
        v = x.view(view).select(F.lit(family).alias("family"), c(key).cast("bigint").alias("id"), "prompt", "answer")
        rows = v if rows is None else rows.unionByName(v)
    bonus = F.when(c("id") % 2 == 1, F.lit(0.9)).otherwise(F.lit(-0.5))
    graded = W.reward(rows, judge_bonus=bonus)
    return graded.select("family", "id", F.round("reward", 6).alias("reward"))


@query(f"""SELECT o_orderkey AS task_id, CAST(2 AS BIGINT) AS people,
  (CASE WHEN o_orderkey % 4 <> 1 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 4 IN (0, 1) THEN 1 ELSE 0 END) / 2 AS share_right FROM orders""")
def reward_assignment(x):
    status = c("o_orderstatus")
    clash = F.when(c("o_orderkey") % 4 == 1, F.concat(F.lit("\nAda: other\nAda: "), status)).otherwise(F.lit(""))
    bea = F.when(c("o_orderkey") % 4 == 2, F.lit("\nBea - wrong")).when(c("o_orderkey") % 4 == 3, F.lit("")).otherwise(
        F.lit("\nBea - Tea"))
    stdout = F.concat(F.lit("Ada: "), status, clash, bea)
    truth = F.create_map(F.lit("Ada"), F.lower(status), F.lit("Bea"), F.lit("tea"))
    rows = x.orders.select(c("o_orderkey").alias("task_id"), truth.alias("truth"), stdout.alias("stdout"))
    return W.reward_assignment(rows)


# --- row filters -------------------------------------------------------------
@query(f"""SELECT family, id FROM (
  SELECT 'sentiment' AS family, r.doc_id AS id, starts_with(answer, gold) AS ok FROM {duck('reviews')} r
  UNION ALL SELECT 'summarisation', doc_id, len({UNITS}) = 3 FROM {duck('summaries')}
  UNION ALL SELECT 'factual', doc_id, doc_id % 3 > 0 FROM {duck('facts')}) WHERE ok AND id % 4 <> 3""")
def filter_teacher_rows(x):
    judge = F.when(c("doc_id") % 4 == 3, '{"correct": false}').otherwise('{"correct": true}')
    none = F.lit(None).cast("string")
    cols = ["family", "id", "prompt", "answer", "label", "units", "unit_kind", "checker_reply", "judge_reply"]

    def rows(view, family, label=none, units=F.lit(None).cast("int"), kind=none, checker=none):
        return x.view(view).select(F.lit(family).alias("family"), c("doc_id").alias("id"), "prompt", "answer",
                                   label.alias("label"), units.alias("units"), kind.alias("unit_kind"),
                                   checker.alias("checker_reply"), judge.alias("judge_reply"))

    checker = F.when(c("doc_id") % 3 > 0, "Yes. It holds.").otherwise("NO. It does not.")
    union = rows("reviews", "sentiment", label=c("gold")).unionByName(
        rows("summaries", "summarisation", units=F.lit(3), kind=F.lit("bullets"))).unionByName(
        rows("facts", "factual", checker=checker))
    return W.filter_teacher_rows(union.select(*cols)).select("family", "id")


@query(f"""SELECT s.doc_id FROM {duck('summaries')} s JOIN ({ECHO_SQL.replace(RUNS, D.grams('answer'))}) e ON s.doc_id = e.doc_id
WHERE e.reason IS NULL AND len({UNITS}) = 3
  AND len(list_filter({UNITS}, lambda u: len(regexp_extract_all(u, '[A-Za-z0-9%]+(?:[''’][A-Za-z0-9]+)?', 0)) NOT BETWEEN 6 AND 14)) = 0
  AND contains(lower(answer), 'topic ' || s.source)""".replace(
    duck("summaries"), f"(SELECT * REPLACE (replace(answer, chr(10), ' topic ' || source || chr(10)) || ' topic ' || source AS answer) FROM {duck('summaries')})"))
def filter_summary_rows(x):
    from gatehouse.functions import text as X
    tail = F.concat(F.lit(" topic "), c("source"))
    answer = F.concat(F.replace("answer", F.lit("\n"), F.concat(tail, F.lit("\n"))), tail)
    rows = x.view("summaries").withColumn("answer", answer).withColumn("units", X.bullets(c("answer"))).withColumn(
        "count", F.lit(3)).withColumn("cap", F.lit(14)).withColumn(
        "themes", F.array(F.concat(F.lit("topic "), c("source"))))
    return W.filter_summary_rows(rows).select("doc_id")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, 'Order ' || o_orderkey || ' went to ' || o_custkey || '.' AS s,
  CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b FROM orders)
WHERE (length(s) - length(replace(s, a, ''))) / length(a) = 1 AND (length(s) - length(replace(s, b, ''))) / length(b) = 1""")
def filter_spans_unique(x):
    rows = x.orders.select("o_orderkey", F.concat(F.lit("Order "), c("o_orderkey"), F.lit(" went to "), c("o_custkey"),
                                                  F.lit(".")).alias("sentence"),
                           F.array(c("o_orderkey").cast("string"), c("o_custkey").cast("string")).alias("spans"))
    return W.filter_spans_unique(rows).select("o_orderkey")

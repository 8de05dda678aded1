"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatehouse.functions import budgets as B
from gatehouse.functions import code as C
from gatehouse.functions import entities as E
from gatehouse.functions import hashing as H
from gatehouse.functions import numbers as N
from gatehouse.functions import replies as R
from gatehouse.functions import text as X

from . import duck as D
from .base import duck, query

c = F.col


def joined(items, sep="|"):
    return F.array_join(items, sep)


def size(items):
    return F.size(items).cast("bigint")


# --- words and units ---------------------------------------------------------
@query(f"SELECT doc_id, array_to_string({D.norm('text')}, ' ') AS words FROM documents")
def norm_words(x):
    return x.documents.select("doc_id", joined(X.norm_words(c("text")), " ").alias("words"))


@query(f"""SELECT doc_id, CAST(len({D.fields('text')}) AS BIGINT) AS fields,
       CAST(len(regexp_extract_all(text, '[A-Za-z0-9%]+(?:[''’][A-Za-z0-9]+)?', 0)) AS BIGINT) AS words FROM documents""")
def word_count(x):
    return x.documents.select("doc_id", X.word_count(c("text")).cast("bigint").alias("fields"),
                              size(X.words(c("text"))).alias("words"))


@query(f"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s[1] AS first, s[len(s)] AS last,
       CAST(len(list_filter(k, lambda e: e <> '')) AS BIGINT) AS kept
FROM (SELECT doc_id, regexp_split_to_array({D.trim('text')}, '[.!?][\\t\\n\\f\\r ]+') AS s,
             string_split(regexp_replace({D.trim('text')}, '([.!?]){D.SPACE}+', '\\1' || chr(1), 'g'), chr(1)) AS k
      FROM documents)""")
def sentences(x):
    return x.documents.select("doc_id", X.sentences(c("text")).alias("s"),
                              size(X.kept_sentences(c("text"))).alias("kept")).select(
        "doc_id", size(c("s")).alias("n"), F.get("s", F.lit(0)).alias("first"),
        F.element_at("s", -1).alias("last"), "kept")


@query(f"""SELECT doc_id, array_to_string(list_transform(b, lambda e: regexp_replace(e, '^[-•* ]+', '')), '|') AS items,
       CAST(len(b) AS BIGINT) AS n
FROM (SELECT doc_id, list_filter(list_transform(string_split(answer, chr(10)), lambda e: {D.trim('e')}),
                                 lambda e: regexp_matches(e, '^[-•*]')) AS b FROM {duck('summaries')})""")
def bullets(x):
    return x.view("summaries").select("doc_id", joined(X.bullets(c("answer"))).alias("items"),
                                      size(X.bullets(c("answer"))).alias("n"))


@query(f"""SELECT doc_id, {D.quoted('prompt')} AS quoted,
       {D.trim("substr(prompt, 1, position(': ''' IN prompt) - 1)")} AS instruction,
       {D.trim(D.quoted('prompt'))} AS source FROM {duck('summaries')}""")
def quoted_source(x):
    parts = X.quoted_parts(c("prompt"), F.lit("text_summarisation"))
    return x.view("summaries").select("doc_id", X.quoted_source(c("prompt")).alias("quoted"),
                                      parts["instruction"].alias("instruction"), parts["source"].alias("source"))


@query(f"""SELECT o_orderkey, array_to_string({D.numtok('stdout')}, '|') AS tokens,
       coalesce(list_max(list_transform({D.numtok('prompt')}, lambda t: CAST(t AS DOUBLE))), 0) AS largest
FROM {duck('maths')}""")
def numbers(x):
    return x.view("maths").select("o_orderkey", joined(N.number_tokens(c("stdout"))).alias("tokens"),
                                  N.max_number(c("prompt")).alias("largest"))


@query(f"""SELECT o_orderkey, try_cast(nullif(regexp_extract(answer, '(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS first
FROM {duck('maths')}""")
def first_signed_number(x):
    return x.view("maths").select("o_orderkey", N.first_signed_number(c("answer")).alias("first"))


@query(f"""SELECT doc_id, CASE n WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 WHEN 'five' THEN 5
       ELSE try_cast(n AS INTEGER) END AS n, unit,
       CASE cap WHEN 'twelve' THEN 12 ELSE try_cast(cap AS INTEGER) END AS cap
FROM (SELECT doc_id, nullif(regexp_extract(prompt, 'exactly (two|three|four|five|[0-9]+) (sentences|bullet points)', 1), '') AS n,
             nullif(regexp_extract(prompt, 'exactly (two|three|four|five|[0-9]+) (sentences|bullet points)', 2), '') AS unit,
             nullif(regexp_extract(prompt, '{D.CAP}', 1), '') AS cap FROM {duck('summaries')})""")
def stated_shape(x):
    return x.view("summaries").select("doc_id", X.stated_shape(c("prompt")).alias("s")).select("doc_id", "s.*")


RATIO_SQL = f"""SELECT o_orderkey, a, b, c, total, total // (a + b + c) AS unit, total % (a + b + c) = 0 AS exact FROM (
  SELECT o_orderkey, CAST(regexp_extract(prompt, '£([0-9]+)', 1) AS BIGINT) AS total,
         CAST(regexp_extract(prompt, 'ratio ([0-9]+):([0-9]+):([0-9]+)', 1) AS BIGINT) AS a,
         CAST(regexp_extract(prompt, 'ratio ([0-9]+):([0-9]+):([0-9]+)', 2) AS BIGINT) AS b,
         CAST(regexp_extract(prompt, 'ratio ([0-9]+):([0-9]+):([0-9]+)', 3) AS BIGINT) AS c
  FROM {duck('ratios')})"""


@query(f"""SELECT o_orderkey, CASE WHEN exact THEN a || ':' || b || ':' || c END AS parts,
       CASE WHEN exact THEN (unit * a) || '|' || (unit * b) || '|' || (unit * c) END AS shares,
       CASE WHEN exact THEN '£' END AS symbol FROM ({RATIO_SQL})""")
def ratio_shares(x):
    s = N.ratio_shares(c("prompt"))
    text = lambda a: F.transform(a, lambda v: v.cast("string"))
    return x.view("ratios").select("o_orderkey", s.alias("s")).select(
        "o_orderkey", joined(text(c("s.parts")), ":").alias("parts"), joined(text(c("s.shares"))).alias("shares"),
        c("s.symbol").alias("symbol"))


@query(f"""SELECT o_orderkey, CASE WHEN exact THEN 'Splitting in the ratio ' || a || ':' || b || ':' || c
       || ', the shares are £' || format('{{:,}}', unit * a) || ', £' || format('{{:,}}', unit * b) || ' and £'
       || format('{{:,}}', unit * c) || ' respectively.' END AS derived FROM ({RATIO_SQL})""")
def ratio_answer(x):
    return x.view("ratios").select("o_orderkey", N.ratio_answer(c("prompt")).alias("derived"))


@query(f"""SELECT o_orderkey, CAST(v1 AS INTEGER) AS v1, CAST(v2 AS INTEGER) AS v2, CAST(d1 AS INTEGER) AS d1,
       CAST(d2 AS INTEGER) AS d2, CAST(dist AS INTEGER) AS distance
FROM (SELECT o_orderkey, 540 + o_custkey % 30 AS d1, 600 + o_custkey % 25 AS d2, 60 + o_custkey % 40 AS v1,
             51 + o_custkey % 35 AS v2, 400 + o_orderkey % 300 AS dist FROM orders)""")
def travel_facts(x):
    f = x.view("travel").select("o_orderkey", N.travel_facts(c("prompt")).alias("t"))
    at = lambda a, i: F.get(c(f"t.{a}"), F.lit(i))
    return f.select("o_orderkey", at("speeds", 0).alias("v1"), at("speeds", 1).alias("v2"),
                    at("departures", 0).alias("d1"), at("departures", 1).alias("d2"), c("t.distance").alias("distance"))


@query(f"""SELECT doc_id, regexp_matches(q, '{D.CONTRAST}') AS contrast,
       regexp_matches(regexp_replace(q, '{D.UNPRAISE}', '', 'g'), '{D.PRAISE}') AS praise,
       coalesce(regexp_matches(regexp_replace(nullif(regexp_extract(q, '(?s)^.*{D.CONTRAST}(.*)$', 2), ''),
           '{D.UNPRAISE}', '', 'g'), '{D.PRAISE}'), false) AS tail_praise
FROM (SELECT doc_id, {D.quoted('prompt')} AS q FROM {duck('reviews')})""")
def contrast_flags(x):
    flags = X.contrast_flags(X.quoted_source(c("prompt")))
    return x.view("reviews").select("doc_id", flags.alias("f")).select("doc_id", "f.*")


IGNORED = ", ".join(f"'{w}'" for w in (
    "PERSON ORGANIZATION ORG LOCATION LOC DATE TIME MISC GPE EVENT PRODUCT MONEY PERCENT NER "
    "AI ML IT LLM API GPU CPU USB CEO CTO CFO COO GDP HR PR USD GBP EUR").split())


def signal_sql(x: str) -> dict[str, str]:
    return {
        "years": f"regexp_extract_all({x}, '\\b(?:19|20)[0-9]{{2}}\\b', 0)",
        "runs": f"regexp_extract_all({x}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b', 0)",
        "capitals": f"regexp_extract_all({x}, '[^.!?:\\n]\\s([A-Z][a-z]{{2,}})\\b', 1)",
        "acronyms": f"list_filter(regexp_extract_all({x}, '\\b[A-Z]{{2,}}\\b', 0), lambda w: w NOT IN ({IGNORED}))",
    }


_sig = signal_sql("text")


@query(f"""SELECT doc_id, array_to_string({_sig['years']}, '|') AS years, array_to_string({_sig['runs']}, '|') AS runs,
       array_to_string({_sig['capitals']}, '|') AS capitals, array_to_string({_sig['acronyms']}, '|') AS acronyms,
       CAST(len(list_distinct(list_concat(list_concat({_sig['years']}, {_sig['runs']}),
            list_concat({_sig['capitals']}, {_sig['acronyms']})))) AS BIGINT) AS signals FROM documents""")
def entity_signals(x):
    t = c("text")
    return x.documents.select(
        "doc_id", joined(E.years(t)).alias("years"), joined(E.name_runs(t)).alias("runs"),
        joined(E.mid_capitals(t)).alias("capitals"), joined(E.acronyms(t)).alias("acronyms"),
        size(E.entity_signals(t)).alias("signals"))


SPANS_SQL = """SELECT o_orderkey, pos, labels[pos] AS label, trim(spans[pos]) AS span FROM (
  SELECT o_orderkey, labels, spans, unnest(range(1, len(labels) + 1)) AS pos FROM (
    SELECT o_orderkey, regexp_extract_all({col}, '(PERSON|ORGANIZATION|LOCATION|DATE)\\s*:\\s*([^;\\n]+)', 1) AS labels,
           regexp_extract_all({col}, '(PERSON|ORGANIZATION|LOCATION|DATE)\\s*:\\s*([^;\\n]+)', 2) AS spans
    FROM {src}))"""


@query(f"""SELECT o_orderkey, span, arg_max(label, pos) AS label
FROM ({SPANS_SQL.format(col='answer', src=duck('entities'))}) GROUP BY o_orderkey, span""")
def label_spans(x):
    return x.view("entities").select("o_orderkey", F.explode(E.label_spans(c("answer"))).alias("span", "label"))


@query(f"""SELECT prompt_id, pos, nullif(regexp_extract(answer, '\\b(Positive|Negative|Neutral)\\b', 1), '') AS strict,
       nullif(upper(substr(m, 1, 1)) || lower(substr(m, 2)), '') AS lenient
FROM (SELECT *, regexp_extract(answer, '(?i)\\b(Positive|Negative|Neutral)\\b', 1) AS m FROM {duck('draws')})""")
def sentiment_label(x):
    return x.view("draws").select("prompt_id", "pos", X.sentiment_label(c("answer")).alias("strict"),
                                  X.sentiment_label(c("answer"), lenient=True).alias("lenient"))


# --- replies -----------------------------------------------------------------
@query(f"""SELECT o_orderkey, CASE WHEN reply LIKE '%"correct": true%' THEN true WHEN reply LIKE '%"correct": false%' THEN false
  WHEN regexp_matches(upper(reply), '-> ?INCORRECT') THEN false WHEN regexp_matches(upper(reply), '-> ?CORRECT') THEN true
  WHEN upper(reply) LIKE '%INCORRECT%' THEN false WHEN upper(reply) LIKE '%CORRECT%' THEN true END AS verdict
FROM {duck('judgements')}""")
def verdict(x):
    return x.view("judgements").select("o_orderkey", R.verdict(c("reply")).alias("verdict"))


@query(f"""SELECT o_orderkey, nullif(regexp_extract(reply, '(?s)([\\[{{].*[\\]}}])', 1), '') AS span FROM {duck('replies')}""")
def json_span(x):
    return x.view("replies").select("o_orderkey", R.json_span(c("reply")).alias("span"))


@query("""WITH b AS (SELECT p_partkey, answer, regexp_extract_all(answer, '(?s)```([^\\n]*)\\n(.*?)```', 1) AS infos,
       regexp_extract_all(answer, '(?s)```([^\\n]*)\\n(.*?)```', 2) AS codes FROM """ + duck("code_tasks") + """)
SELECT p_partkey, CAST(len(infos) AS BIGINT) AS blocks, array_to_string(list_transform(infos, lambda i: trim(i)), '|') AS infos,
       CAST(len(list_filter(infos, lambda i: trim(i) IN ('', 'python', 'python3', 'py', 'py3'))) AS BIGINT) AS actions,
       CASE WHEN len(infos) > 0 AND infos[1] IN ('', 'python') THEN codes[1] ELSE answer END AS first FROM b""")
def code_blocks(x):
    a = c("answer")
    return x.view("code_tasks").select(
        "p_partkey", size(C.code_blocks(a)).alias("blocks"),
        joined(F.transform(C.code_blocks(a), lambda b: b["info"])).alias("infos"),
        size(C.action_blocks(a)).alias("actions"), C.first_code_block(a).alias("first"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 5)
         THEN 'def ' || name || '(x, scale=2):' || chr(10) || '    return x * scale' END AS fenced,
       'print(' || name || ')' AS called FROM {duck('code_tasks')}""")
def tool_code(x):
    call = F.concat(F.lit('<tool_call>{"name": "run_python", "arguments": {"code": "print('), c("name"),
                    F.lit(')"}}</tool_call>'))
    return x.view("code_tasks").select("p_partkey", C.tool_code(c("answer")).alias("fenced"),
                                       C.tool_code(call).alias("called"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 6 < 4 OR p_partkey % 6 = 5 THEN
         CASE WHEN p_partkey % 6 IN (0, 1, 5) THEN name WHEN p_partkey % 6 = 2 THEN name ELSE 'other' END END AS def_name,
       CASE WHEN p_partkey % 6 IN (0, 1, 5) THEN 'def ' || name || '(x, scale=2):' || chr(10) || '    return x * scale'
            WHEN p_partkey % 6 = 2 THEN 'def ' || name || '(x:' || chr(10) || '    return x * 2'
            WHEN p_partkey % 6 = 3 THEN 'def other(x):' || chr(10) || '    return x * 2' END AS def_block,
       CASE WHEN p_partkey % 6 IN (0, 1, 3, 5) THEN 'x' END AS params FROM {duck('code_tasks')}""")
def def_block(x):
    a = c("answer")
    return x.view("code_tasks").select("p_partkey", C.def_name(a).alias("def_name"), C.def_block(a).alias("def_block"),
                                       joined(C.required_params(a)).alias("params"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN name || '(2)' END AS call,
       CASE WHEN p_partkey % 5 < 3 THEN '4' END AS expected, CASE WHEN p_partkey % 5 < 4 THEN name END AS called
FROM {duck('code_tasks')}""")
def worked_example(x):
    w = C.worked_example(c("prompt"))
    return x.view("code_tasks").select("p_partkey", w["call"].alias("call"), w["expected"].alias("expected"),
                                       C.called_name(c("prompt")).alias("called"))


@query(f"""SELECT p_partkey, 'total|items' AS idents FROM {duck('traces')}""")
def backtick_idents(x):
    return x.view("traces").select("p_partkey", joined(C.backtick_idents(c("prompt"))).alias("idents"))


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(prompt, 'def \\w+\\([^)]*=\\s*(?:\\[\\]|\\{{\\}})')
  THEN 'shared mutable default argument - the same default object persists across calls' END AS hint FROM {duck('fix_tasks')}""")
def mechanism_hint(x):
    return x.view("fix_tasks").select("p_partkey", C.mechanism_hint(c("prompt")).alias("hint"))


@query(f"""SELECT o_orderkey, task_id, answer FROM (
  SELECT o_orderkey, first_id AS task_id, CASE WHEN o_orderkey % 7 IN (0, 1, 2) THEN o_orderstatus END AS answer
  FROM {duck('replies')} JOIN orders USING (o_orderkey)
  UNION ALL SELECT o_orderkey, second_id, CASE WHEN o_orderkey % 7 IN (0, 2, 3) THEN o_orderpriority END
  FROM {duck('replies')} JOIN orders USING (o_orderkey)) WHERE answer IS NOT NULL""")
def parse_answers(x):
    from gatehouse.operators.answers import parse_answers as parse
    replies = x.view("replies")
    ids = replies.select("o_orderkey", F.explode(F.array("first_id", "second_id")).alias("task_id"))
    return parse(replies, ids, "o_orderkey").select("o_orderkey", "task_id", "answer")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'thinking it over' ELSE 'State ' || o_orderstatus END AS content,
       o_custkey AS prompt_tokens, o_custkey % 7 AS completion_tokens, CAST(0 AS BIGINT) AS cached_tokens,
       CASE WHEN o_orderkey % 3 = 2 THEN CAST(4 AS BIGINT) WHEN o_orderkey % 3 = 1 THEN o_custkey % 5 ELSE CAST(0 AS BIGINT) END
         AS reasoning_tokens, o_orderkey % 3 = 2 AS reasoning_is_estimate FROM orders""")
def normalise_usage(x):
    key = c("o_orderkey") % 3
    content = F.when(key == 0, F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.concat(
        F.lit("State "), "o_orderstatus").alias("text"))))).when(
        key == 1, F.concat(F.lit('"State '), "o_orderstatus", F.lit('"'))).otherwise(F.lit('""'))
    message = F.concat(F.lit('{"choices":[{"message":{"content":'), content, F.when(
        key == 2, F.lit(',"reasoning_content":"thinking it over"')).otherwise(F.lit("")), F.lit('}}],"usage":{"prompt_tokens":'),
        c("o_custkey").cast("string"), F.lit(',"completion_tokens":'), (c("o_custkey") % 7).cast("string"), F.when(
            key == 1, F.concat(F.lit(',"completion_tokens_details":{"reasoning_tokens":'), (c("o_custkey") % 5).cast("string"),
                               F.lit("}"))).otherwise(F.lit("")), F.lit("}}"))
    return x.orders.select("o_orderkey", R.usage(message).alias("u")).select(
        "o_orderkey", "u.content", "u.prompt_tokens", "u.completion_tokens", "u.cached_tokens", "u.reasoning_tokens",
        "u.reasoning_is_estimate")


# --- categories --------------------------------------------------------------
@query(f"""SELECT task_id, CASE
  WHEN p LIKE '%sentiment%' THEN 'sentiment_classification'
  WHEN p LIKE '%summar%' OR p LIKE '%bullet point%' OR p LIKE '%in exactly%' THEN 'text_summarisation'
  WHEN p LIKE '%named entit%' OR p LIKE '%person, organization%' OR p LIKE '%label each as person%' THEN 'named_entity_recognition'
  WHEN p LIKE '%bug%' THEN 'code_debugging'
  WHEN p LIKE '%write a python function%' THEN 'code_generation'
  WHEN p LIKE '%how many%' OR p LIKE '%how much%' OR p LIKE '%\\%%' ESCAPE '\\' OR p LIKE '%km/h%' OR p LIKE '%revenue%' THEN 'mathematical_reasoning'
  ELSE 'factual_knowledge' END AS category
FROM (SELECT task_id, lower(prompt) AS p FROM (
  SELECT task_id, prompt FROM {duck('summaries')} UNION ALL SELECT task_id, prompt FROM {duck('reviews')}
  UNION ALL SELECT task_id, prompt FROM {duck('entities')} UNION ALL SELECT task_id, prompt FROM {duck('maths')}
  UNION ALL SELECT task_id, prompt FROM {duck('travel')} UNION ALL SELECT task_id, prompt FROM {duck('code_tasks')}
  UNION ALL SELECT task_id, prompt FROM {duck('fix_tasks')}))""")
def keyword_category(x):
    out = None
    for name in ["summaries", "reviews", "entities", "maths", "travel", "code_tasks", "fix_tasks"]:
        v = x.view(name).select("task_id", "prompt")
        out = v if out is None else out.unionByName(v)
    return out.select("task_id", X.keyword_category(c("prompt")).alias("category"))


@query(f"""SELECT task_id, CASE WHEN task_id LIKE 'su%' THEN 'summarisation' WHEN task_id LIKE 'cd%' THEN 'code_debugging'
  WHEN task_id LIKE 'cg%' THEN 'code_generation' WHEN task_id LIKE 'f%' THEN 'factual' WHEN task_id LIKE 'm%' THEN 'maths'
  WHEN task_id LIKE 's%' THEN 'sentiment' WHEN task_id LIKE 'n%' THEN 'ner' WHEN task_id LIKE 'l%' THEN 'logical'
  ELSE 'unknown' END AS category FROM {duck('golden')}""")
def category_from_id(x):
    return x.view("golden").select("task_id", X.category_from_id(c("task_id")).alias("category"))


# --- trimming ----------------------------------------------------------------
FUNCTION_WORDS = ", ".join(f"'{w}'" for w in (
    "a an the as to of in on for with and or but that which who by from at into their its is are was were be been "
    "being has have had").split())


@query(f"""WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM (
    SELECT doc_id, string_split(answer, chr(10)) AS ls FROM {duck('summaries')})),
  w AS (SELECT doc_id, i, ls[i] AS line, {D.fields("regexp_replace(" + D.trim('ls[i]') + ", '^[-•*] ', '')")} AS w FROM l),
  h AS (SELECT *, CASE WHEN lower(w[11]) IN ('that', 'which', 'who') THEN 10 WHEN lower(w[10]) IN ('that', 'which', 'who') THEN 9
           ELSE 12 END AS hard FROM w),
  k AS (SELECT *, coalesce(list_max(list_filter(range(6, 12), lambda j: regexp_matches(w[j], '[,;:]$'))),
           list_max(list_filter(range(1, hard + 1), lambda j: lower(trim(w[j], ',;:.')) NOT IN ({FUNCTION_WORDS}))), 1) AS cut FROM h)
SELECT doc_id, string_agg(CASE WHEN len(w) <= 12 THEN line ELSE substr({D.trim('line')}, 1, 2)
       || rtrim(array_to_string(list_slice(w, 1, cut), ' '), ',;:') || '.' END, chr(10) ORDER BY i) AS trimmed
FROM k GROUP BY doc_id""")
def trim_to_word_cap(x):
    return x.view("summaries").select("doc_id", X.trim_to_word_cap(c("prompt"), c("answer")).alias("trimmed"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 400)
       || chr(10) || '[...middle omitted for context budget...]' || chr(10) || right(text, 120) END AS middle,
       CASE WHEN length(b) <= 500 THEN b ELSE substr(b, 1, 250) || chr(10) || '...' || chr(10) || right(b, 250) END AS trace,
       CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || chr(10)
            || '[...truncated at 300 characters on 02 January 2024...]' || chr(10) END AS note
FROM (SELECT *, """ + D.trim("text") + """ AS b FROM documents)""")
def trim_middle(x):
    t = c("text")
    return x.documents.select("doc_id", X.trim_middle(t, 600).alias("middle"), X.truncate_trace(t, 500).alias("trace"),
                              X.truncate_note(t, 300, F.lit("2024-01-02").cast("date")).alias("note"))


@query(f"""SELECT doc_id, array_to_string(CASE WHEN len(w) <= 100 THEN w
       ELSE list_concat(list_slice(w, 1, 30), list_slice(w, len(w) - 69, len(w))) END, ' ') AS kept
FROM (SELECT doc_id, {D.fields('text')} AS w FROM documents)""")
def head_tail_tokens(x):
    return x.documents.select("doc_id", joined(X.head_tail_tokens(X.fields(c("text")), 100, 30), " ").alias("kept"))


@query(r"""SELECT doc_id, regexp_replace(translate(replace(text, '…', '...'), '—–−‘’“”' || chr(160) || '×÷' || chr(9),
       '---''''"" x/ '), '[^\n\r -~]', '?', 'g') AS folded FROM documents""")
def ascii_fold(x):
    return x.documents.select("doc_id", X.ascii_fold(c("text")).alias("folded"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'note-' || doc_id ELSE fallback END AS name,
       CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN lang ELSE '' END AS description
FROM {duck('notes')} JOIN documents USING (doc_id)""")
def front_matter(x):
    return x.view("notes").select("doc_id", X.front_matter(c("content"), c("fallback")).alias("f")).select("doc_id", "f.*")


@query("""SELECT source, doc_id, CAST(greatest(floor(greatest((128000 - 24000) * 4 - 1000 - 12000, 8000) / count(*) OVER (PARTITION BY source)),
       4000) AS BIGINT) AS budget FROM documents""")
def per_task_budget(x):
    docs = x.documents.select("source", "doc_id")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = B.budget_chars(F.lit(128000))
    return docs.join(sizes, "source").select(
        "source", "doc_id", B.per_task_budget(total, F.lit(1000), c("n")).cast("bigint").alias("budget"))


@query("""SELECT o_orderkey, e AS effort, CAST(least(greatest(CASE WHEN o_orderkey % 2 = 0 THEN greatest(b, 3072) ELSE b END, 2048), 6000) AS BIGINT) AS max_tokens
FROM (SELECT o_orderkey, e, greatest(600 + (1 + o_custkey % 30) * 220, CASE e WHEN 'medium' THEN 3200 WHEN 'high' THEN 4500 WHEN 'xhigh' THEN 6000 ELSE 0 END) AS b
FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'xhigh' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
  WHEN '4-NOT SPECIFIED' THEN 'low' ELSE 'low' END AS e FROM orders))""")
def effort_and_max_tokens(x):
    raw = F.when(c("o_orderpriority") == "1-URGENT", " XHIGH ").when(c("o_orderpriority") == "2-HIGH", "High").when(
        c("o_orderpriority") == "3-MEDIUM", "medium").when(c("o_orderpriority") == "4-NOT SPECIFIED", "low").otherwise("odd")
    return x.orders.select(
        "o_orderkey", B.normal_effort(raw).alias("effort"),
        B.max_tokens(1 + c("o_custkey") % 30, raw, F.lit(0), c("o_orderkey") % 2 == 0).alias("max_tokens"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 6 = 2 THEN false WHEN p_partkey % 6 IN (4, 5) THEN p_partkey % 6 = 5 ELSE true END AS parses
FROM {duck('code_tasks')}""")
def python_parses(x):
    return x.view("code_tasks").select("p_partkey", C.python_parses(C.code_body(c("answer"))).alias("parses"))


@query("""SELECT doc_id, CAST((2 * (CAST('0x' || substr(md5(text), 1, 16) AS UBIGINT)::HUGEINT % 7)
       + CAST('0x' || substr(md5(text), 17, 16) AS UBIGINT)::HUGEINT % 7) % 7 AS BIGINT) AS bucket FROM documents""")
def md5_modulus(x):
    return x.documents.select("doc_id", H.md5_modulus(c("text"), 7).alias("bucket"))

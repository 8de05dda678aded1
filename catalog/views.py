"""Derived inputs over the driver tables, written once for both SQL dialects.

Each function returns a SELECT over whole tables that turns rows into prompts,
answers, verdicts or call records.  The remainder of a key picks the *shape* of an
answer, so that every gate sees accepted and rejected rows; no row is left out.
"""

from __future__ import annotations

from collections.abc import Callable


class SparkDialect:
    def __init__(self, table: Callable[[str], str]):
        self.table = table

    def join(self, items: str, sep: str) -> str:
        return f"array_join({items}, '{sep}')"

    def span(self, items: str, start: int, end: int) -> str:
        return f"slice({items}, {start}, {end - start + 1})"

    def backwards(self, items: str) -> str:
        return f"reverse({items})"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')"

    def once(self, source: str, expr: str, name: str) -> str:
        # A generator is not inlined, so filters above it do not repeat the work.
        return f"(SELECT * FROM {source} LATERAL VIEW explode(array({expr})) g AS {name})"


class DuckDialect:
    def table(self, name: str) -> str:
        return name

    def join(self, items: str, sep: str) -> str:
        return f"array_to_string({items}, '{sep}')"

    def span(self, items: str, start: int, end: int) -> str:
        return f"list_slice({items}, {start}, {end})"

    def backwards(self, items: str) -> str:
        return f"list_reverse({items})"

    def day(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%d')"

    def once(self, source: str, expr: str, name: str) -> str:
        return f"(SELECT *, {expr} AS {name} FROM {source})"


def _whole(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


def _clock(minutes: str) -> str:
    return (f"lpad(CAST({_whole(f'({minutes}) / 60')} AS STRING), 2, '0') || ':' || "
            f"lpad(CAST(({minutes}) % 60 AS STRING), 2, '0')")


def turns(d) -> str:
    """User turns with the assistant turn that follows (the conversation view)."""
    return f"""
    SELECT 'c' || CAST(u.conv_id AS STRING) || '_' || CAST(u.turn AS STRING) AS task_id,
           u.conv_id, u.turn, u.text AS prompt, a.text AS answer
    FROM {d.table('conversations')} u
    JOIN {d.table('conversations')} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'"""


def summaries(d) -> str:
    """Summary prompts that quote a whole document, with four kinds of answer."""
    def bullet(a: int, b: int, flip: bool = False) -> str:
        words = d.span("ws", a, b)
        return f"'- ' || {d.join(d.backwards(words) if flip else words, ' ')}"

    nl = " || chr(10) || "
    return f"""
    SELECT doc_id, 'su' || CAST(doc_id AS STRING) AS task_id, lang, source, text AS passage,
           'Summarize the following passage in exactly three bullet points, each at most 12 words: '
             || chr(39) || text || chr(39) AS prompt,
           CASE doc_id % 4
             WHEN 0 THEN {nl.join([bullet(1, 10), bullet(11, 20), bullet(21, 30)])}
             WHEN 1 THEN {nl.join([bullet(1, 5), bullet(11, 15)])}
             WHEN 2 THEN {nl.join([bullet(1, 5), bullet(11, 15), bullet(21, 25)])}
             ELSE {nl.join([bullet(1, 14, True), bullet(16, 20), bullet(21, 25)])} END AS answer
    FROM {d.once(d.table('documents'), "regexp_extract_all(lower(text), '[a-z0-9]+', 0)", 'ws')} w"""


def drafts(d) -> str:
    """Summary prompts that quote a whole document, each with four candidate answers."""
    def bullet(a: int, b: int, flip: bool = False) -> str:
        words = d.span("ws", a, b)
        return f"'- ' || {d.join(d.backwards(words) if flip else words, ' ')}"

    nl = " || chr(10) || "
    return f"""
    SELECT doc_id, 'su' || CAST(doc_id AS STRING) AS task_id,
           'Summarize the following passage in exactly three bullet points, each at most 12 words: '
             || chr(39) || text || chr(39) AS prompt, text AS passage,
           {nl.join([bullet(1, 10), bullet(11, 20), bullet(21, 30)])} AS a0,
           {nl.join([bullet(1, 5), bullet(11, 15)])} AS a1,
           {nl.join([bullet(1, 5), bullet(11, 15), bullet(21, 25)])} AS a2,
           {nl.join([bullet(1, 14, True), bullet(16, 20), bullet(21, 25)])} AS a3
    FROM {d.once(d.table('documents'), "regexp_extract_all(lower(text), '[a-z0-9]+', 0)", 'ws')} w"""


def reviews(d) -> str:
    """Sentiment prompts over whole documents, some resolving into praise."""
    return f"""
    SELECT doc_id, 's' || CAST(doc_id AS STRING) AS task_id, lang, source,
           'Classify the sentiment of this review as Positive, Negative, or Neutral: ' || chr(39) || text ||
           CASE doc_id % 5
             WHEN 1 THEN ' It was late, but the support was helpful.'
             WHEN 2 THEN ' It looked fine, but nothing good came of it.'
             WHEN 3 THEN ' A great buy.'
             WHEN 4 THEN ' Although cheap, it broke.' ELSE '' END || chr(39) AS prompt,
           CASE doc_id % 7
             WHEN 0 THEN 'Positive. The writer praises the support but regrets the delay.'
             WHEN 1 THEN 'Negative. Everything about the order failed.'
             WHEN 2 THEN 'Negative. The item broke, although it was cheap.'
             WHEN 3 THEN 'Mixed. Fine.'
             WHEN 4 THEN 'The review is Positive on the whole.'
             WHEN 5 THEN 'Neutral. Both sides are stated, however briefly.'
             ELSE 'Positive. All of it is praised without doubt.' END AS answer,
           CASE doc_id % 3 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' ELSE 'Neutral' END AS gold
    FROM {d.table('documents')}"""


def pivots(d) -> str:
    """Summary prompts whose source turns on a contrast in its middle."""
    return f"""
    SELECT doc_id, 'Summarize the following passage in exactly two sentences: ' || chr(39)
             || 'Growth brought lasting prosperity to harbour towns. ' || text
             || ' However, ' || text || ' Housing shortages remain everywhere.' || chr(39) AS prompt,
           CASE doc_id % 3
             WHEN 0 THEN 'Prosperity came to harbour towns. Housing shortages followed.'
             WHEN 1 THEN 'Prosperity came to harbour towns. It stayed for good.'
             ELSE 'Nothing else happened. Shortages in housing grew.' END AS answer
    FROM {d.table('documents')}"""


def facts(d) -> str:
    """Questions with answers of one to many sentences, refusals and comparisons."""
    return f"""
    SELECT doc_id, CASE doc_id % 3
             WHEN 0 THEN 'What is the difference between RAM and the ROM in a computer?'
             WHEN 1 THEN 'What is the difference between a lease and a rental agreement? ' || text
             ELSE 'Explain the passage: ' || text END AS prompt,
           CASE doc_id % 5
             WHEN 0 THEN text
             WHEN 1 THEN 'RAM is volatile. The ROM in a machine is not.'
             WHEN 2 THEN 'I cannot say what this means.'
             WHEN 3 THEN 'A lease binds for longer. It differs from a rental agreement.'
             ELSE 'It means little. That is all.' END AS answer
    FROM {d.table('documents')}"""


def maths(d) -> str:
    """Amount questions over orders with tool output and an answer."""
    total = "CAST(floor(o_totalprice) AS BIGINT)"
    return f"""
    SELECT o_orderkey, o_custkey, 'm' || CAST(o_orderkey AS STRING) AS task_id,
           CASE o_orderkey % 3
             WHEN 0 THEN 'A depot holds ' || CAST(total AS STRING) || ' units and ships ' || CAST(part AS STRING)
                         || '. How many units remain?'
             WHEN 1 THEN 'The bill is £' || CAST(total AS STRING) || ' for ' || CAST(part AS STRING)
                         || ' items. What is the total cost? How many items were bought?'
             ELSE 'Revenue was $' || CAST(total AS STRING) || ' and fell by ' || CAST(part AS STRING)
                  || '. How much is left?' END AS prompt,
           CASE o_orderkey % 3
             WHEN 0 THEN CAST(total - part AS STRING)
             WHEN 1 THEN '[' || CAST(total AS STRING) || ', ' || CAST(part AS STRING) || ']' || chr(10) || 'done'
             ELSE CAST(total - part AS STRING) || '.1234567' END AS stdout,
           CASE o_orderkey % 7
             WHEN 0 THEN CAST(total - part AS STRING) || ' units remain.'
             WHEN 1 THEN 'The cost is £' || CAST(total AS STRING) || ' for ' || CAST(part AS STRING) || ' items.'
             WHEN 2 THEN '$' || CAST(total - part AS STRING) || '.12 is left.'
             WHEN 3 THEN 'About -' || CAST(part AS STRING) || ' units.'
             WHEN 4 THEN '[' || CAST(total AS STRING) || ',' || CAST(part AS STRING) || '] is the list.'
             WHEN 5 THEN 'It is ' || CAST(total * 9 AS STRING) || '.'
             ELSE 'No figure can be given.' END AS answer
    FROM (SELECT *, {total} AS total, 100 + o_custkey % 900 AS part FROM {d.table('orders')}) o"""


def ratios(d) -> str:
    """Split questions over orders; two in three divide exactly."""
    return f"""
    SELECT o_orderkey, 'Split £' || CAST(total AS STRING) || ' between three partners in the ratio '
             || CAST(a AS STRING) || ':' || CAST(b AS STRING) || ':' || CAST(c AS STRING)
             || '. How much does each partner get?' AS prompt,
           CASE o_orderkey % 4
             WHEN 0 THEN 'They get £' || CAST(unit * a AS STRING) || ', £' || CAST(unit * b AS STRING)
                         || ' and £' || CAST(unit * c AS STRING) || '.'
             WHEN 1 THEN 'The first gets £' || CAST(unit * a AS STRING) || '.'
             WHEN 2 THEN 'Nobody can tell.'
             ELSE CAST(unit * c AS STRING) || ', ' || CAST(unit * b AS STRING) || ', '
                  || CAST(unit * a AS STRING) END AS answer
    FROM (SELECT *, unit * (a + b + c) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS total
          FROM (SELECT o_orderkey, 1 + o_custkey % 5 AS a, 2 + o_custkey % 3 AS b, 3 + o_custkey % 4 AS c,
                       {_whole('o_totalprice / 100')} AS unit FROM {d.table('orders')}) u) t"""


def travel(d) -> str:
    """Two-vehicle questions over orders with right, early, malformed and vague answers."""
    meet = _whole("(dist * 60 + v1 * d1 + v2 * d2) / (v1 + v2)")
    leg = _whole("v1 * (meet - d1) / 60")
    return f"""
    SELECT o_orderkey, 't' || CAST(o_orderkey AS STRING) AS task_id,
           'Train A leaves at ' || {_clock('d1')} || ' doing ' || CAST(v1 AS STRING) || ' km/h and train B at '
             || {_clock('d2')} || ' doing ' || CAST(v2 AS STRING) || ' km/h, ' || CAST(dist AS STRING)
             || ' km apart. When do they meet?' AS prompt,
           CASE o_orderkey % 6
             WHEN 0 THEN 'They meet at ' || {_clock('meet')} || ', ' || CAST({leg} AS STRING) || ' km from A.'
             WHEN 1 THEN 'They meet at 03:04, 10 km from A.'
             WHEN 2 THEN 'They meet at 25:10.'
             WHEN 3 THEN 'They meet before noon.'
             WHEN 4 THEN 'They meet at ' || {_clock('meet')} || ', 1 km from A.'
             ELSE {_clock('meet')} || ' (' || CAST({leg} AS STRING) || ' km)' END AS answer
    FROM (SELECT *, {meet} AS meet
          FROM (SELECT o_orderkey, 540 + o_custkey % 30 AS d1, 600 + o_custkey % 25 AS d2, 60 + o_custkey % 40 AS v1,
                       51 + o_custkey % 35 AS v2, 400 + o_orderkey % 300 AS dist FROM {d.table('orders')}) s) m"""


def entities(d) -> str:
    """Entity prompts over orders and customers with complete and faulty extractions."""
    return f"""
    SELECT o_orderkey, 'n' || CAST(o_orderkey AS STRING) AS task_id, person, city, org, yr,
           'Label each as PERSON, ORGANIZATION, LOCATION or DATE: ' || chr(39) || 'In ' || yr || ' the group ' || org
             || ' sent ' || person || ' to see the bridge at ' || city || ', an AI project.' || chr(39) AS prompt,
           CASE o_orderkey % 8
             WHEN 0 THEN 'PERSON: ' || person || '; ORGANIZATION: ' || org || '; LOCATION: ' || city || '; DATE: ' || yr
             WHEN 1 THEN 'PERSON: ' || person || '; ORGANIZATION: ' || org || '; LOCATION: ' || city
             WHEN 2 THEN 'ORGANIZATION: ' || org || '; LOCATION: ' || city || '; DATE: ' || yr
             WHEN 3 THEN 'PERSON: ' || person || '; LOCATION: ' || city || '; DATE: ' || yr
             WHEN 4 THEN 'PERSON: ' || person || '; LOCATION: ' || org || '; LOCATION: ' || city || '; DATE: ' || yr
             WHEN 5 THEN 'PERSON: ' || person || '; ORGANIZATION: ' || org || '; DATE: ' || city || '; DATE: ' || yr
             WHEN 6 THEN 'PERSON: ' || person || '; LOCATION: ' || city || '; DATE: ' || yr
                         || chr(10) || 'Outside the inventory: ' || org
             ELSE 'PERSON: Bridge Mission ' || person || '; ORGANIZATION: ' || org || '; LOCATION: ' || city
                  || '; DATE: ' || yr END AS answer,
           'PERSON: ' || person || '; ORGANIZATION: ' || org || '; LOCATION: ' || city || '; DATE: ' || yr AS gold
    FROM (SELECT o.o_orderkey, CAST(year(o.o_orderdate) AS STRING) AS yr, c.c_mktsegment AS org,
                 CASE o.o_custkey % 4 WHEN 0 THEN 'Maria Silva' WHEN 1 THEN 'Ken Watanabe'
                      WHEN 2 THEN 'Lena Fischer' ELSE 'Omar Haddad' END AS person,
                 CASE o.o_custkey % 3 WHEN 0 THEN 'Zurich' WHEN 1 THEN 'Lagos' ELSE 'Boston' END AS city
          FROM {d.table('orders')} o JOIN {d.table('customer')} c ON o.o_custkey = c.c_custkey) e"""


def code_tasks(d) -> str:
    """Code generation prompts over parts with valid, broken and misnamed answers."""
    nl = " || chr(10) || "
    fence = "repeat(chr(96), 3)"
    body = f"'def ' || name || '(x, scale=2):'{nl}'    return x * scale'"
    return f"""
    SELECT p_partkey, 'cg' || CAST(p_partkey AS STRING) AS task_id, name,
           CASE p_partkey % 5
             WHEN 4 THEN 'Write a Python function that doubles a number.'
             WHEN 3 THEN 'Write a Python function called ' || name || ' that doubles a number.'
             ELSE 'Write a Python function called ' || name || ' that doubles a number. For example, ' || name
                  || '(2) should return 4. Keep it short.' END AS prompt,
           CASE p_partkey % 6
             WHEN 0 THEN {fence} || 'python'{nl}{body}{nl}{fence}
             WHEN 1 THEN {body}
             WHEN 2 THEN 'def ' || name || '(x:'{nl}'    return x * 2'
             WHEN 3 THEN 'def other(x):'{nl}'    return x * 2'
             WHEN 4 THEN 'The function doubles its input.'
             ELSE 'Here it is:'{nl}{fence}{nl}{body}{nl}{fence}{nl}'and data:'{nl}{fence} || 'json'
                  {nl}'[1]'{nl}{fence} END AS answer
    FROM (SELECT *, 'f_' || CAST(p_partkey AS STRING) AS name FROM {d.table('part')}) p"""


def fix_tasks(d) -> str:
    """Bug-fix prompts over parts with good, unchanged, renamed and broken answers."""
    nl = " || chr(10) || "
    buggy = f"'def ' || name || '(x, y=[]):'{nl}'    y.append(x)'{nl}'    return y'"
    fixed = f"'def ' || name || '(x, y=None):'{nl}'    y = [] if y is None else y'{nl}'    return y + [x]'"
    return f"""
    SELECT p_partkey, 'cd' || CAST(p_partkey AS STRING) AS task_id, name,
           CASE WHEN p_partkey % 9 = 8 THEN 'This code contains a bug.'
                ELSE 'This code contains a bug. What does it evaluate to?' || chr(10) || {buggy} END AS prompt,
           CASE p_partkey % 6
             WHEN 0 THEN 'The default list is shared between all calls.'{nl}{fixed}
             WHEN 1 THEN {fixed}
             WHEN 2 THEN 'The default list is shared between calls.'{nl}{buggy}
             WHEN 3 THEN 'The default list is shared.'{nl}'def other(x):'{nl}'    return [x]'
             WHEN 4 THEN 'The index is wrong here.'{nl}'def ' || name || '(x:'{nl}'    return [x]'
             ELSE 'Nothing is wrong.' END AS answer
    FROM (SELECT *, 'g_' || CAST(p_partkey AS STRING) AS name FROM {d.table('part')}) p"""


def traces(d) -> str:
    """Trace answers over parts: two named values, stated near, far or not at all."""
    return f"""
    SELECT p_partkey, 'What do ' || chr(96) || 'total' || chr(96) || ' and ' || chr(96) || 'items' || chr(96)
             || ' hold, and ' || chr(96) || 'total' || chr(96) || ' later?' AS prompt,
           CAST(p_size AS STRING) AS total, '[' || CAST(p_size AS STRING) || ', 7]' AS items,
           CASE p_partkey % 4
             WHEN 0 THEN 'total is ' || CAST(p_size AS STRING) || ' and items is [' || CAST(p_size AS STRING) || ',7].'
             WHEN 1 THEN 'total is off. ' || repeat('It is hard to say what it holds. ', 5) || 'items is ['
                         || CAST(p_size AS STRING) || ', 7].'
             WHEN 2 THEN 'total is ' || CAST(p_size AS STRING) || '.'
             ELSE 'items holds [' || CAST(p_size AS STRING) || ', 7] while total = ' || CAST(p_size AS STRING) END AS answer
    FROM {d.table('part')}"""


def replies(d) -> str:
    """Batch replies over orders: wrapped, listed, keyed, fenced, prose and broken."""
    fence = "repeat(chr(96), 3)"
    return f"""
    SELECT o_orderkey, 'a' || key AS first_id, 'b' || key AS second_id,
           CASE o_orderkey % 7
             WHEN 0 THEN '{{"answers":[{{"task_id":"a' || key || '","answer":"' || o_orderstatus
                         || '"}},{{"task_id":"b' || key || '","answer":"' || o_orderpriority || '"}}]}}'
             WHEN 1 THEN 'Sure: [{{"task_id":"a' || key || '","answer":"' || o_orderstatus || '"}}]'
             WHEN 2 THEN '{{"a' || key || '":"' || o_orderstatus || '","b' || key || '":"' || o_orderpriority || '"}}'
             WHEN 3 THEN 'Here:' || chr(10) || {fence} || 'json' || chr(10) || '{{"answers":[{{"task_id":"b' || key
                         || '","answer":"' || o_orderpriority || '"}}]}}' || chr(10) || {fence}
             WHEN 4 THEN 'The answer is ' || o_orderstatus || '.'
             WHEN 5 THEN '{{"answers":[{{"task_id":"zz","answer":"stray"}}]}}'
             ELSE '{{"answers":[{{"task_id":"a' || key || '"' END AS reply
    FROM (SELECT *, CAST(o_orderkey AS STRING) AS key FROM {d.table('orders')}) o"""


def judgements(d) -> str:
    """Judge replies over orders in every accepted form."""
    return f"""
    SELECT o_orderkey, CASE o_orderkey % 8
             WHEN 0 THEN 'The sum fits. -> CORRECT' || chr(10) || 'JSON: {{"correct": true}}'
             WHEN 1 THEN 'Off by one. -> CORRECT' || chr(10) || 'JSON: {{"correct": false}}'
             WHEN 2 THEN 'The unit is wrong -> INCORRECT'
             WHEN 3 THEN 'Matches ->CORRECT'
             WHEN 4 THEN 'This is incorrect.'
             WHEN 5 THEN 'I think that is correct'
             WHEN 6 THEN 'No idea about order ' || CAST(o_orderkey AS STRING)
             ELSE '{{"verdict": "yes"}} correct' END AS reply
    FROM {d.table('orders')}"""


def archive(d) -> str:
    """Verdict archive: one row per labelled document, whole text as the answer."""
    return f"""
    SELECT source || '/' || lang AS task_id, 'factual' AS family, d.text AS answer, l.quality = 1 AS pass,
           d.lang AS file, d.doc_id AS pos, d.doc_id
    FROM {d.table('documents')} d JOIN {d.table('labels')} l ON d.doc_id = l.doc_id"""


def golden(d) -> str:
    """Answers with every validator type over labelled documents; about half pass."""
    key = "CAST(doc_id AS STRING)"
    return f"""
    SELECT CASE doc_id % 8 WHEN 0 THEN 'f' WHEN 1 THEN 'm' WHEN 2 THEN 's' WHEN 3 THEN 'su' WHEN 4 THEN 'n'
             WHEN 5 THEN 'cd' WHEN 6 THEN 'l' ELSE 'cg' END || {key} AS task_id,
           doc_id, source AS set_name, lang, quality, toxic,
           CASE doc_id % 7 WHEN 0 THEN 'contains_ci' WHEN 1 THEN 'contains_cs' WHEN 2 THEN 'exact'
             WHEN 3 THEN 'numeric' WHEN 4 THEN 'code_check' WHEN 5 THEN 'ner' ELSE 'llm' END AS validate,
           CASE doc_id % 7
             WHEN 3 THEN 'the total is ' || {key} || ' units'
             WHEN 5 THEN 'We met Anna Bell and Raj Rao. ' || text
             ELSE text END AS answer,
           CASE doc_id % 7
             WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN lower(text) ELSE 'absent words' END
             WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN text ELSE lower(text) || '!' END
             WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN lower(text) ELSE 'other' END
             WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN {key} || '.0' ELSE '0' || {key} || '1' END
             WHEN 4 THEN CASE WHEN doc_id % 2 = 0 THEN text ELSE 'def missing' END
             WHEN 5 THEN CASE WHEN doc_id % 2 = 0 THEN 'anna bell:PERSON, Raj Rao:PERSON'
                              ELSE 'Anna Bell:PERSON,Nobody Else:PERSON' END
             ELSE 'a judge decides' END AS expected
    FROM (SELECT d.doc_id, trim(d.text) AS text, d.source, d.lang, l.quality, l.toxic
          FROM {d.table('documents')} d JOIN {d.table('labels')} l ON d.doc_id = l.doc_id) g"""


def draws(d) -> str:
    """Sampled sentiment draws: one prompt per customer, one draw per order."""
    return f"""
    SELECT o_custkey AS prompt_id, o_orderkey AS pos,
           CASE (o_orderkey + o_custkey) % 6
             WHEN 0 THEN 'Positive. Order ' || CAST(o_orderkey AS STRING) || ' pleased them.'
             WHEN 1 THEN 'positive, on balance.'
             WHEN 2 THEN 'Negative. It came late, in state ' || o_orderstatus || '.'
             WHEN 3 THEN 'Neutral. Nothing stands out.'
             WHEN 4 THEN 'No verdict.'
             ELSE 'I would say NEGATIVE.' END AS answer
    FROM {d.table('orders')}"""


def draw_gold(d) -> str:
    return f"""
    SELECT c_custkey AS prompt_id, CASE c_custkey % 3 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative'
             ELSE 'Neutral' END AS label, 'Authored answer for ' || c_name AS authored
    FROM {d.table('customer')}"""


def calls(d) -> str:
    """Events as call records: a run is a user's day."""
    return f"""
    SELECT event_id AS call_id, CAST(user_id AS STRING) || '/' || {d.day('ts')} AS run_id, user_id, ts,
           event_type AS model, CAST(round(value) AS BIGINT) AS tokens, event_type = 'error' AS error,
           event_type = 'click' AS tool, {d.day('ts')} AS day
    FROM {d.table('events')}"""


def routed(d) -> str:
    """Orders as routed runs: model × category with a verdict, tokens and time."""
    return f"""
    SELECT o.o_orderkey, o.o_orderkey AS pos, 'r' || CAST(o.o_orderkey AS STRING) AS task_id,
           o.o_orderpriority AS model, o.o_orderpriority AS strategy, c.c_mktsegment AS category,
           o.o_orderstatus = 'F' AS pass, CAST(floor(o.o_totalprice) AS BIGINT) AS tokens,
           o.o_orderkey % 1000 AS duration_ms, c.c_custkey, c.c_nationkey
    FROM {d.table('orders')} o JOIN {d.table('customer')} c ON o.o_custkey = c.c_custkey"""


def planned(d) -> str:
    """Orders as tasks to batch: a run per nation, a category per customer segment."""
    return f"""
    SELECT 'run' || CAST(c_nationkey AS STRING) AS run_id, pos, task_id, tokens,
           'Task ' || CAST(pos AS STRING) || ' of ' || category AS prompt,
           CASE WHEN category = 'BUILDING' THEN 'mathematical_reasoning'
                WHEN category = 'MACHINERY' AND o_orderkey % 50 = 0 THEN 'logical_deductive_reasoning'
                WHEN category = 'MACHINERY' THEN 'code_debugging'
                WHEN category = 'FURNITURE' THEN 'text_summarisation'
                ELSE 'factual_knowledge' END AS category,
           CASE WHEN model = '1-URGENT' THEN 'low' ELSE 'none' END AS effort
    FROM ({routed(d)}) r"""


def board(d) -> str:
    """Suppliers as leaderboard entries of their nation."""
    return f"""
    SELECT n.n_name AS board, s.s_name AS name,
           CASE WHEN s.s_suppkey % 7 = 0 THEN NULL ELSE s.s_acctbal END AS score,
           CASE WHEN s.s_suppkey % 11 = 0 THEN 1 + s.s_suppkey % 3 ELSE NULL END AS rank,
           CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE 100 + s.s_suppkey END AS tokens,
           CASE WHEN n.n_nationkey % 2 = 0 THEN 'tokens' ELSE 'score' END AS rank_by,
           s.s_acctbal / 10000 AS accuracy
    FROM {d.table('supplier')} s JOIN {d.table('nation')} n ON s.s_nationkey = n.n_nationkey"""


def notes(d) -> str:
    """Documents as notes with a front-matter block, three in four well formed."""
    nl = " || chr(10) || "
    return f"""
    SELECT doc_id, 'doc-' || CAST(doc_id AS STRING) AS fallback,
           CASE doc_id % 4
             WHEN 0 THEN '---'{nl}'name: note-' || CAST(doc_id AS STRING){nl}'description: "' || source || '"'{nl}'---'{nl}text
             WHEN 1 THEN '---'{nl}'description: ' || lang{nl}'---'{nl}text
             WHEN 2 THEN '---'{nl}'name: open-ended'{nl}text
             ELSE text END AS content
    FROM {d.table('documents')}"""

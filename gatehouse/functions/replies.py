"""Model replies: JSON spans, answers, verdicts and token usage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import bind, extract, last_of_each, presence, trim_space
from .code import code_blocks

ANSWER_ITEM = "STRUCT<task_id: STRING, answer: STRING>"
ID_MAP = "MAP<STRING, STRING>"


def json_span(text: Column) -> Column:
    """First opening bracket or brace to the last closing one."""
    return trim_space(extract(text, r"(?s)([\[{].*[\]}])"))


def verdict(reply: Column) -> Column:
    """Judge verdict: the JSON flag, then an arrow mark, then the bare word; else NULL."""
    flag = F.from_json(extract(reply, r"(?s)(\{.*\})"), "correct BOOLEAN")["correct"]
    up = F.upper(reply)
    words = (
        F.when(up.rlike("-> ?INCORRECT"), False).when(up.rlike("-> ?CORRECT"), True)
        .when(up.contains("INCORRECT"), False).when(up.contains("CORRECT"), True)
    )
    return F.coalesce(flag, words)


def answer_candidates(reply: Column) -> Column:
    """Texts that may hold the answers: the JSON span, the reply, and its fenced blocks."""
    blocks = F.filter(code_blocks(reply), lambda b: (b["info"] == "") | F.lower(b["info"]).rlike("json|py"))
    fenced = F.flatten(F.transform(blocks, lambda b: F.array(b["code"], json_span(b["code"]))))
    return F.array_distinct(F.array_compact(F.concat(F.array(json_span(reply), trim_space(reply)), fenced)))


def answers_in(candidate: Column, ids: Column) -> Column:
    """ARRAY<STRUCT<task_id, answer>> of the known ids of one candidate, NULL if none.

    Accepts ``{"answers": […]}``, a list, or an object keyed by id; the first form
    that holds a known id counts.  The last answer given to an id wins.
    """
    wrapped = F.from_json(candidate, f"answers ARRAY<{ANSWER_ITEM}>")["answers"]
    listed = F.when(candidate.startswith("["), F.from_json(candidate, f"ARRAY<{ANSWER_ITEM}>"))
    keyed = F.transform(
        F.map_entries(F.from_json(candidate, ID_MAP)),
        lambda e: F.struct(e["key"].alias("task_id"), e["value"].alias("answer")))

    def usable(items: Column) -> Column:
        kept = F.filter(items, lambda x: F.array_contains(ids, x["task_id"]) & (trim_space(x["answer"]) != ""))
        return bind(kept, lambda k: F.when(F.size(k) > 0, last_of_each(k, "task_id")))

    return F.coalesce(usable(wrapped), usable(listed), usable(keyed))


def best_answers(reply: Column, ids: Column) -> Column:
    """Answers of the candidate with most known ids, the earliest on a tie.

    Without any, a lone id takes a fence-free reply as it stands.
    """
    found = F.transform(answer_candidates(reply), lambda text, i: bind(answers_in(text, ids), lambda a: F.struct(
        F.coalesce(F.size(a), F.lit(0)).alias("n"), (-i).alias("early"), a.alias("answers"))))
    prose = presence(F.regexp_replace(reply, "^[` \n\t]+|[` \n\t]+$", ""))
    lone = F.when((F.size(ids) == 1) & ~reply.contains("```") & prose.isNotNull(), F.array(F.struct(
        F.get(ids, F.lit(0)).alias("task_id"), prose.alias("answer"))))
    return F.coalesce(F.array_max(F.filter(found, lambda f: f["n"] > 0))["answers"], lone)


def usage(response: Column) -> Column:
    """Token usage and content of a chat response (JSON text).

    The content may be text or parts; a reply with reasoning only uses it as
    content.  Missing reasoning counts stay NULL with an estimate beside them, in
    tokens, so that units never mix.
    """
    def at(path: str) -> Column:
        return F.get_json_object(response, path)

    def count(path: str) -> Column:
        return F.coalesce(at(path).try_cast("bigint"), F.lit(0).cast("bigint"))

    content = at("$.choices[0].message.content")
    parts = F.from_json(content, "ARRAY<STRUCT<type: STRING, text: STRING>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    plain = F.when(content.startswith("["), F.coalesce(joined, content)).otherwise(content)
    reasoning = at("$.choices[0].message.reasoning_content")
    tool_calls = F.get_json_object(response, "$.choices[0].message.tool_calls[0]")
    text = F.coalesce(presence(plain), presence(at("$.choices[0].text")),
                      F.when(tool_calls.isNull(), presence(reasoning)))
    reported = count("$.usage.completion_tokens_details.reasoning_tokens")
    estimated = (reported == 0) & presence(reasoning).isNotNull()
    return F.struct(
        text.alias("content"),
        count("$.usage.prompt_tokens").alias("prompt_tokens"),
        count("$.usage.completion_tokens").alias("completion_tokens"),
        count("$.usage.total_tokens").alias("total_tokens"),
        count("$.usage.prompt_tokens_details.cached_tokens").alias("cached_tokens"),
        F.when(estimated, F.ceil(F.length(reasoning) / 4)).otherwise(reported).alias("reasoning_tokens"),
        estimated.alias("reasoning_is_estimate"),
    )



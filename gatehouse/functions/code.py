"""Code in answers: fenced blocks, definitions, examples and a syntax check."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed as V
from .core import bind, contains_any, extract, extract_all, first_reason, presence, trim_space


def code_blocks(text: Column) -> Column:
    """ARRAY<STRUCT<info, code>> of the fenced blocks in order."""
    block = "(?s)```([^\n]*)\n(.*?)```"
    return F.zip_with(
        extract_all(text, block, 1), extract_all(text, block, 2),
        lambda info, code: F.struct(trim_space(info).alias("info"), trim_space(code).alias("code")))


def action_blocks(text: Column) -> Column:
    """Blocks meant to be run: bare, Python or marked with an ``# act`` comment."""
    def is_action(b: Column) -> Column:
        info = F.lower(b["info"])
        named = info.isin(*V.ACTION_INFO) | contains_any(info, V.ACTION_INFO_PARTS)
        return named | F.lower(F.regexp_extract(b["code"], "^([^\n]*)", 1)).contains(V.ACTION_COMMENT)

    return F.filter(code_blocks(text), is_action)


def first_code_block(text: Column) -> Column:
    """Code of the first Python or bare fence, else the whole text."""
    fence = r"(?s)```(?:python)?[\t\n\f\r ]*\n(.*?)```"
    return F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)


def code_body(text: Column) -> Column:
    """Fenced code without its last newline, else the whole text."""
    return F.when(text.rlike(V.FENCED_CODE), F.regexp_extract(text, V.FENCED_CODE, 1)).otherwise(text)


def tool_code(turn: Column) -> Column:
    """Code of a tool turn: a fenced block, else a ``run_python`` tool call."""
    fenced = presence(F.regexp_extract(turn, V.FENCED_CODE, 1))
    payload = extract(turn, r"(?s)<tool_call>.*?(\{.*\})")
    called = F.when(F.get_json_object(payload, "$.name") == "run_python",
                    presence(F.get_json_object(payload, "$.arguments.code")))
    return F.when(turn.rlike(V.FENCED_CODE), fenced).otherwise(called)


def tool_argument_code(arguments: Column) -> Column:
    """Code inside native tool-call arguments, under any of its four names.

    Arguments that are no JSON are taken as raw code when they print or assign.
    """
    bare = presence(arguments)
    named = F.coalesce(*[presence(F.get_json_object(bare, f"$.{k}")) for k in V.CODE_ARGUMENTS])
    raw = F.when(~bare.rlike(r"^[{\[]") & contains_any(bare, ["print", "="]),
                 F.regexp_replace(bare, '^"+|"+$', ""))
    return F.coalesce(named, raw)


def called_name(prompt: Column) -> Column:
    return extract(prompt, V.CALLED_NAME)


def def_name(text: Column) -> Column:
    return extract(text, V.DEF_NAME)


def from_first_def(text: Column) -> Column:
    return extract(text, "(?s)(def .*)")


def def_block(text: Column) -> Column:
    """First ``def`` line with every following blank or indented line."""
    def cut(ln: Column) -> Column:
        stops = F.filter(F.sequence(F.lit(1), F.size(ln)), lambda i: (i > 1) & ~(
            F.get(ln, i - 1).rlike("^[ \t]") | (trim_space(F.get(ln, i - 1)) == "")))
        last = F.coalesce(F.array_min(stops) - 1, F.size(ln))
        return F.regexp_replace(F.array_join(F.slice(ln, F.lit(1), last), "\n"), "[ \t\n]+$", "")

    body = from_first_def(text)
    return F.when(body.isNotNull(), bind(F.split(body, "\n"), cut))


def required_params(text: Column) -> Column:
    """Names of the parameters before the first default; NULL with ``*`` parameters."""
    def pick(params: Column) -> Column:
        first_default = F.array_min(F.filter(
            F.sequence(F.lit(1), F.size(params)), lambda i: F.get(params, i - 1).contains("=")))
        kept = F.slice(params, F.lit(1), F.coalesce(first_default - 1, F.size(params)))
        bad = F.exists(kept, lambda p: (p == "") | p.startswith("*"))
        return F.when(~bad, F.transform(kept, lambda p: trim_space(F.regexp_replace(p, "(?s):.*$", ""))))

    inside = F.when(text.rlike(V.DEF_PARAMS), trim_space(F.regexp_extract(text, V.DEF_PARAMS, 1)))
    listed = F.transform(F.split(inside, ","), trim_space)
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(bind(listed, pick))


def worked_example(prompt: Column) -> Column:
    """STRUCT<call, expected> of "For example, f(x) should return y."."""
    return F.when(prompt.rlike(V.EXAMPLE), F.struct(
        F.regexp_extract(prompt, V.EXAMPLE, 1).alias("call"),
        F.regexp_extract(prompt, V.EXAMPLE, 2).alias("expected")))


def backtick_idents(text: Column) -> Column:
    return F.array_distinct(extract_all(text, V.BACKTICK_IDENT, 1))


def mechanism_hint(code: Column) -> Column:
    """Name of the Python pitfall a snippet shows, NULL when none is visible."""
    return first_reason(
        (code.contains("lambda") & contains_any(code, ["for ", " in range"]), V.PITFALLS["late_binding"]),
        (code.rlike(r"def \w+\([^)]*=[\t\n\f\r ]*(?:\[\]|\{\})"), V.PITFALLS["mutable_default"]),
        (contains_any(code, ["(n for", "(x for"]) | code.rlike(r"=[\t\n\f\r ]*\(.+for .+in .+\)"),
         V.PITFALLS["spent_generator"]),
    )


def squash_space(text: Column) -> Column:
    """Collapse whitespace runs, so layout does not count as a change."""
    return trim_space(F.regexp_replace(text, V.ANY_SPACE + "+", " "))


def _parses(source: str | None) -> bool | None:
    if source is None:
        return None
    try:
        ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def python_parses(code: pd.Series) -> pd.Series:
    """Does the text parse as Python?  It is never executed.

    NULL passes through untouched, so callers hide rows they need not check
    behind NULL: a CASE around the call would not save the work.
    """
    return code.map(_parses, na_action="ignore").astype("object")



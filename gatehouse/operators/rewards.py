"""Graded rewards and row filters for generated training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import fixed as V
from ..functions import replies as R
from ..functions import text as X
from ..functions.core import bind, contains_any, extract_all, trim_space

# Caps of the composite reward, and words that name a bug's symptom.
JUDGE_CAP, TOTAL_CAP = 0.4, 1.4
SYMPTOMS = ["off-by", "index", "range", "return", "none", "empty", "zero", "==", "!="]


def _points(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def reward_code_generation(prompt: Column, answer: Column, parses: Column) -> Column:
    """Name and syntax only: generated code is never executed here.

    Prompts without a worked example keep a flat quarter, as there is nothing to run.
    """
    name = C.called_name(prompt)
    named = _points(C.code_body(answer).contains(F.concat(F.lit("def "), name)), 0.25)
    flat = _points(C.worked_example(prompt).isNull(), 0.25)
    return F.when(name.isNull(), 0.0).when(parses, named + 0.25 + flat).otherwise(named)


def reward_code_fix(prompt: Column, answer: Column, parses: Column) -> Column:
    """A cause line of four words, a definition that parses, and the symptom named."""
    rows = F.filter(F.transform(X.lines(answer), trim_space), lambda ln: ln != "")
    prose = F.filter(rows, lambda ln: ~ln.rlike("^(?:def |import |from |```|#)"))

    def grade(cause: Column) -> Column:
        has_def = C.code_body(answer).contains("def ")
        base = _points((X.word_count(cause) >= 4) & ~cause.contains("def "), 0.35) + _points(has_def, 0.15)
        whole = base + _points(has_def & parses, 0.25) + _points(contains_any(F.lower(cause), SYMPTOMS), 0.1)
        return F.when(has_def & ~parses, base).otherwise(whole)

    first = F.coalesce(F.get(prose, F.lit(0)), F.lit(""))
    return F.when(F.size(rows) == 0, 0.0).otherwise(bind(first, grade))


def reward_ner(prompt: Column, answer: Column) -> Column:
    """Recall of the prompt's names and acronyms, and a ``Label: span`` shape."""
    caps = extract_all(prompt, V.WORD_START + r"[A-Z]{2,}(?:" + V.ANY_SPACE + r"+[A-Z]{2,})?" + V.WORD_END)
    found = F.filter(F.array_distinct(F.concat(extract_all(prompt, V.NAME_RUN), caps)), lambda c: F.length(c) > 2)

    def grade(names: Column) -> Column:
        hits = F.size(F.filter(names, lambda c: answer.contains(c)))
        shape = _points(answer.rlike(r"[A-Za-z_ ]+:\s*[^;]+"), 0.3)
        return F.when(F.size(names) == 0, _points(answer.contains(":"), 0.5)).otherwise(
            F.lit(0.7) * hits / F.size(names) + shape)

    return bind(found, grade)


def reward_summarisation(prompt: Column, answer: Column) -> Column:
    """Unit count (a near miss earns less) and a light check against echoing."""
    def grade(s: Column) -> Column:
        off = F.abs(s["units"] - s["n"])
        shape = F.when(off == 0, 1.0).when(off == 1, 0.4).otherwise(0.0)
        said, asked = X.fields(F.lower(answer)), X.fields(F.lower(prompt))
        shared = F.size(F.array_intersect(said, asked))
        fresh = shared < F.greatest(F.lit(8), F.floor(F.size(asked) / 2))
        content = F.when(fresh & (F.size(said) >= s["n"] * 3), 0.5).otherwise(0.2)
        return F.lit(0.7) * shape + F.lit(0.3) * content

    shape = X.stated_shape(prompt)
    units = F.when(shape["unit"] == "bullet points", F.size(X.listed_lines(answer))).otherwise(
        F.size(X.kept_sentences(answer)))
    shapeless = _points(trim_space(answer) != "", 0.5)
    return F.when(shape["n"].isNull(), shapeless).otherwise(
        bind(F.struct(units.alias("units"), shape["n"].alias("n")), grade))


def reward_sentiment(prompt: Column, answer: Column) -> Column:
    bare = trim_space(answer)
    return _points(bare.rlike("^(?:Positive|Negative|Neutral|Mixed)"), 0.4) + _points(
        bare.contains(".") & (X.word_count(bare) >= 6), 0.2)


def reward_factual(prompt: Column, answer: Column) -> Column:
    n = F.size(X.kept_sentences(answer))
    return F.when(n == 0, 0.0).otherwise(
        F.lit(0.3) + _points(n <= V.MAX_FACT_SENTENCES, 0.3) + _points(X.word_count(answer) <= 120, 0.1))


REWARDS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "code_generation": reward_code_generation,
    "code_fix": reward_code_fix,
    "ner": lambda p, a, _: reward_ner(p, a),
    "summarisation": lambda p, a, _: reward_summarisation(p, a),
    "sentiment": lambda p, a, _: reward_sentiment(p, a),
    "factual": lambda p, a, _: reward_factual(p, a),
}
"""Base reward of each family; callers may add their own entries."""


def composite(base: Column, judge_bonus: Column | float = 0.0) -> Column:
    """Base plus a judge bonus of at most 0.4, at most 1.4 in all."""
    bonus = F.lit(judge_bonus) if isinstance(judge_bonus, (int, float)) else judge_bonus
    capped = F.greatest(F.lit(0.0), F.least(bonus, F.lit(JUDGE_CAP)))
    return F.least(base + capped, F.lit(TOTAL_CAP))


def reward(rows: DataFrame, family: str = "family", prompt: str = "prompt", answer: str = "answer",
           judge_bonus: Column | float = 0.0, families: list[str] | None = None) -> DataFrame:
    """Add ``reward`` to rows of any mix of families; unknown families start at zero."""
    p, a, f = F.col(prompt), F.col(answer), F.col(family)
    use = list(REWARDS) if families is None else families
    out, parses = rows, F.lit(None).cast("boolean")
    if {"code_generation", "code_fix"} & set(use):
        out = out.withColumn("__parses", C.python_parses(F.when(
            f.isin("code_generation", "code_fix"), C.code_body(a))))
        parses = F.col("__parses")
    base = F.lit(0.0)
    for name in use:
        base = F.when(f == name, REWARDS[name](p, a, parses)).otherwise(base)
    return out.withColumn("reward", composite(base, judge_bonus)).drop("__parses")


def reward_assignment(outputs: DataFrame, key: str = "task_id", truth: str = "truth",
                      stdout: str = "stdout") -> DataFrame:
    """Share of people whose every printed item equals the truth, per task.

    ``truth`` is MAP<person, item>; ``stdout`` is captured output, given as data.
    """
    people = outputs.select(key, F.explode(truth).alias("person", "item"), stdout)
    quoted = F.concat(F.lit(r"\Q"), F.col("person"), F.lit(r"\E\s*[:\-]\s*([A-Za-z0-9 ]+)"))
    items = F.array_distinct(F.transform(
        F.regexp_extract_all(F.col(stdout), quoted, F.lit(1)), lambda v: F.lower(trim_space(v))))
    right = (F.size(items) == 1) & (F.get(items, F.lit(0)) == F.lower(trim_space(F.col("item"))))
    return people.groupBy(key).agg(F.avg(F.when(right, 1.0).otherwise(0.0)).alias("share_right"),
                                   F.count(F.lit(1)).alias("people"))


# --- row filters -------------------------------------------------------------
def filter_teacher_rows(rows: DataFrame) -> DataFrame:
    """Teacher rows whose label, unit count, checker and judge all agree.

    ``rows`` holds (family, prompt, answer, label, units, unit_kind, checker_reply,
    judge_reply); fields that do not apply to a family are NULL.
    """
    a = F.col("answer")
    count = F.when(F.col("unit_kind") == "bullets", F.size(F.filter(
        F.transform(X.lines(a), trim_space), lambda t: t.rlike("^[-•*]")))).otherwise(F.size(X.kept_sentences(a)))
    ok = F.coalesce(R.verdict(F.col("judge_reply")), F.lit(False))
    by_family = (
        F.when(F.col("family") == "sentiment", a.startswith(F.col("label")))
        .when(F.col("family") == "summarisation", count == F.col("units"))
        .when(F.col("family") == "factual", F.upper("checker_reply").startswith("YES")))
    return rows.where(ok & F.coalesce(by_family, F.lit(False)))


def filter_summary_rows(rows: DataFrame, n: int = V.ECHO_RUN) -> DataFrame:
    """Summary rows with the stated count, six words up to the cap per unit, no
    echo of the passage and every theme keyword.

    ``rows`` holds (passage, answer, units ARRAY<STRING>, count, cap, themes
    ARRAY<STRING>).
    """
    sizes = F.transform("units", lambda u: F.size(X.words(u)))
    echo = X.shares_run(X.norm_words(F.col("passage")), X.norm_words(F.col("answer")), n)
    low = F.lower("answer")
    return rows.where(
        (F.size("units") == F.col("count")) & F.forall(sizes, lambda k: (k >= 6) & (k <= F.col("cap")))
        & ~echo & F.forall("themes", lambda t: low.contains(F.lower(t))))


def filter_spans_unique(rows: DataFrame, sentence: str = "sentence", spans: str = "spans") -> DataFrame:
    from ..functions.entities import spans_unique
    return rows.where(spans_unique(F.col(sentence), F.col(spans)))


"""Scoring against golden tables, reports and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import numbers as N
from ..functions import text as X
from ..functions.core import extract_all, lookup, trim_space
from ..session import broadcast_if_small
from .ordering import running_sum


# --- checks ------------------------------------------------------------------
def check_golden(answer: Column, expected: Column, kind: Column, tolerance: float = 0.0,
                 commas: bool = False) -> Column:
    """BOOLEAN verdict by validator type; NULL (unjudged) for ``llm``.

    An unknown type fails.  ``commas`` reads ``1,470`` as one number and
    ``tolerance`` loosens the numeric check, which is exact by default.
    """
    actual = trim_space(F.coalesce(answer, F.lit("")))
    number, wanted = N.first_signed_number(actual, commas), expected.try_cast("double")
    numeric = F.abs(number - wanted) <= tolerance if tolerance else number == wanted

    def found(pair: Column) -> Column:
        entity = trim_space(F.regexp_extract(pair, "(?s)^([^:]*):", 1))
        return pair.contains(":") & F.lower(actual).contains(F.lower(entity))

    return (
        F.when(kind == "numeric", F.coalesce(numeric, F.lit(False)))
        .when(kind == "contains_ci", F.lower(actual).contains(F.lower(expected)))
        .when(kind.isin("contains_cs", "code_check"), actual.contains(expected))
        .when(kind == "exact", F.lower(actual) == F.lower(expected))
        .when(kind == "ner", F.forall(F.split(expected, ","), found))
        .when(kind == "llm", F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def check_key_tokens(expected: Column, answer: Column) -> Column:
    """Passes when at most one key word or number of the expected text is missing."""
    tokens = extract_all(expected, r"[A-Za-z]+|\$?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?")
    same = F.lower(trim_space(expected)) == F.lower(trim_space(answer))
    return same | (F.size(F.filter(tokens, lambda t: ~answer.contains(t))) <= 1)


def check_behaviour(family: Column, prompt: Column, gold: Column, answer: Column, parses: Column) -> Column:
    """Held-out behaviour check of each family."""
    from ..functions import code as C
    from . import gates as G

    parts = F.filter(F.split(gold, ";"), lambda p: p.contains(":"))
    spans = F.transform(parts, lambda p: trim_space(F.regexp_replace(p, "(?s)^[^:]*:", "")))
    shape = X.stated_shape(prompt)
    bullet_lines = F.size(F.filter(F.transform(X.lines(answer), trim_space), lambda t: t.rlike("^[-•*]")))
    units = F.when(shape["unit"] == "bullet points", bullet_lines).otherwise(F.size(X.kept_sentences(answer)))
    present = trim_space(answer) != ""
    name = C.called_name(prompt)
    return F.coalesce(
        F.when(family == "ner", F.forall(spans, lambda s: answer.contains(s)))
        .when(family == "sentiment", trim_space(answer).startswith(trim_space(
            F.regexp_extract(gold, r"(?s)^([^.]*)", 1))))
        .when(family == "summarisation", F.when(shape["n"].isNull(), present).otherwise(units == shape["n"]))
        .when(family == "factual", present & (F.size(X.kept_sentences(answer)) <= V.MAX_FACT_SENTENCES))
        .when(family == "code_generation", answer.contains(F.concat(F.lit("def "), name)) & parses)
        .when(family == "code_fix", G.gate_code_fix_static(prompt, answer, parses).isNull()),
        F.lit(False))


# --- scored rows -------------------------------------------------------------
def score_results(results: DataFrame, golden: DataFrame, **options) -> DataFrame:
    """Judge every result; a result without a golden case fails as ``unknown``."""
    joined = results.join(golden.withColumn("__known", F.lit(True)), "task_id", "left")
    verdict = check_golden(F.col("answer"), F.col("expected"), F.col("validate"), **options)
    return joined.select(
        "task_id", "answer", "expected", "validate",
        F.when(F.col("__known"), verdict).otherwise(F.lit(False)).alias("pass"),
        F.when(F.col("__known"), X.category_from_id(F.col("task_id"))).otherwise("unknown").alias("category"),
    )


def score_golden(golden: DataFrame, results: DataFrame, **options) -> DataFrame:
    """Judge every golden case; a missing answer counts as empty."""
    answer = F.coalesce(F.col("answer"), F.lit(""))
    verdict = check_golden(answer, F.col("expected"), F.col("validate"), **options)
    return golden.join(results, "task_id", "left").select(
        "task_id", "expected", "validate", answer.alias("answer"), verdict.alias("pass"),
        X.category_from_id(F.col("task_id")).alias("category"),
        F.when(F.col("validate") == "llm", "judge").otherwise("check").alias("via"),
    )


# --- reports -----------------------------------------------------------------
def _counts(passed: str) -> list[Column]:
    p = F.col(passed)
    return [
        F.count(F.lit(1)).alias("total"), F.count_if(p).alias("passed"), F.count_if(~p).alias("failed"),
        F.count_if(p.isNull()).alias("unjudged"), F.avg(p.cast("int")).alias("pass_rate"),
    ]


def score_report(scored: DataFrame, category: str = "category", passed: str = "pass") -> DataFrame:
    """Counts and pass rate per category and overall (category ``(all)``).

    Unjudged rows are counted apart and stay out of the rate.
    """
    named = scored.withColumn("category", F.coalesce(F.col(category), F.lit("unknown")))
    return named.rollup("category").agg(F.grouping("category").alias("__all"), *_counts(passed)).select(
        F.when(F.col("__all") == 1, "(all)").otherwise(F.col("category")).alias("category"),
        "total", "passed", "failed", "unjudged", "pass_rate")


def probe_report(probe: DataFrame) -> DataFrame:
    """Pass counts, generated tokens and time per category and overall."""
    return probe.rollup("category").agg(
        F.grouping("category").alias("__all"), *_counts("pass"),
        F.sum("gen_tokens").alias("gen_tokens"), F.sum("gen_ms").alias("gen_ms"),
    ).withColumn("category", F.when(F.col("__all") == 1, "(all)").otherwise(F.col("category"))).drop("__all")


def probe_failures(probe: DataFrame) -> DataFrame:
    return probe.where(~F.col("pass"))


def floor_gate(scored: DataFrame, floors: Mapping[str, float] = V.FAMILY_FLOORS, family: str = "family",
               passed: str = "pass") -> DataFrame:
    """Rate of each family against its floor; ``low`` marks families under it."""
    floor = lookup(F.col("family"), floors)
    rates = scored.groupBy(F.col(family).alias("family")).agg(*_counts(passed))
    return rates.select("family", "total", "passed", "pass_rate", floor.alias("floor"),
                        F.coalesce(F.col("pass_rate") < floor, F.lit(False)).alias("low"))


def set_passes(floor_rows: DataFrame) -> DataFrame:
    """One row: does no family fall under its floor?"""
    return floor_rows.agg((~F.bool_or("low")).alias("set_ok"), F.count_if(F.col("low")).alias("low_families"))


def family_counts(rows: DataFrame, family: str = "family") -> DataFrame:
    return rows.groupBy(F.col(family).alias("family")).agg(F.count(F.lit(1)).alias("rows"))


def class_balance(rows: DataFrame, cache: str = "cache", label: str = "label") -> DataFrame:
    """Rows per cache and label, with totals (``(all)``) on both sides."""
    named = rows.select(F.col(cache).alias("cache"), F.col(label).alias("label"))
    counted = named.cube("cache", "label").agg(
        F.grouping("cache").alias("__c"), F.grouping("label").alias("__l"), F.count(F.lit(1)).alias("rows"))
    return counted.select(
        F.when(F.col("__c") == 1, "(all)").otherwise(F.col("cache")).alias("cache"),
        F.when(F.col("__l") == 1, "(all)").otherwise(F.col("label")).alias("label"), "rows")


def reject_reasons(gated: DataFrame, family: str = "family") -> DataFrame:
    """Reject reasons per family with their share of the family's rows."""
    from .gates import reason_code

    code = F.coalesce(reason_code(F.col("reason")), F.lit("accepted"))
    counted = gated.groupBy(F.col(family).alias("family"), code.alias("code")).agg(
        F.count(F.lit(1)).alias("rows"))
    # One row per family and code: a window over codes, never over the gated rows.
    from pyspark.sql import Window
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy("family"))
    return counted.withColumn("share", share)


def repeat_variance(runs: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Spread of a measure over repeated runs, with its exact median.

    Equal values are counted together first.  Their counts are summed along the values in
    buckets of like magnitude, so no group's values meet in one task, and the median is the
    mean of the two values in the middle.  Runs without a value count as repeats only.
    """
    m = F.col(measure)
    spread = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("repeats"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("stddev"),
        F.min(m).alias("lowest"), F.max(m).alias("highest"), F.count(m).alias("__valued"))
    counted = runs.where(m.isNotNull()).groupBy(*keys, m.alias("__m")).agg(F.count(F.lit(1)).alias("__n"))
    magnitude = F.signum("__m") * F.floor(F.log2(F.abs("__m") + 1) * 64)
    summed = running_sum(counted, keys, ["__m"], magnitude, F.col("__n"), "__upto")
    small = broadcast_if_small(spread)
    named = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    same = reduce(Column.__and__, (F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    below = F.col("__upto") - F.col("__n")
    holds = [(below < at) & (F.col("__upto") >= at) for at in (F.floor((F.col("__valued") + 1) / 2), F.floor(F.col("__valued") / 2) + 1)]
    middle = summed.select(*named, "__m", "__n", "__upto").join(small, same).where(holds[0] | holds[1]).groupBy(*keys).agg(
        ((F.min("__m") + F.max("__m")) / 2).alias("__median"))
    found = middle.select(*named, F.col("__median").alias("median"))
    return small.join(found, same, "left").drop("__valued", *(f"__k{i}" for i in range(len(keys))))


# --- comparisons -------------------------------------------------------------
def compare_runs(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str] = ("set_name", "task_id")) -> DataFrame:
    """Outcome of each task: fixed, broken, same_pass, same_fail, added or removed."""
    old, new = F.col("b_pass"), F.col("c_pass")
    left = baseline.select(*keys, F.col("pass").alias("b_pass"), F.lit(True).alias("__b"))
    right = candidate.select(*keys, F.col("pass").alias("c_pass"), F.lit(True).alias("__c"))
    outcome = (
        F.when(F.col("__b").isNull(), "added").when(F.col("__c").isNull(), "removed")
        .when(~old & new, "fixed").when(old & ~new, "broken")
        .when(old & new, "same_pass").when(~old & ~new, "same_fail").otherwise("unjudged")
    )
    return left.join(right, list(keys), "full_outer").withColumn("outcome", outcome).drop("__b", "__c")


OUTCOMES = ["fixed", "broken", "same_pass", "same_fail", "added", "removed", "unjudged"]


def compare_sets(compared: DataFrame, bars: Mapping[str, int] | None = None) -> DataFrame:
    """Outcome counts per set; a set ships when the candidate reaches its bar.

    Without a bar the candidate must pass at least as many tasks as the baseline.
    """
    counts = compared.groupBy("set_name").pivot("outcome", OUTCOMES).count().na.fill(0)
    old = F.col("broken") + F.col("same_pass")
    new = F.col("fixed") + F.col("same_pass")
    bar = F.coalesce(lookup(F.col("set_name"), bars), old) if bars else old
    return counts.withColumn("ships", new >= bar)


def label_agreement(first: DataFrame, second: DataFrame, key: str = "task_id", label: str = "label") -> DataFrame:
    """Rows both labellers saw, and whether they agree (two missing labels do)."""
    a = first.select(key, F.col(label).alias("first_label"))
    b = second.select(key, F.col(label).alias("second_label"))
    return a.join(b, key).withColumn("agree", F.col("first_label").eqNullSafe(F.col("second_label")))


def ner_agreement(first: DataFrame, second: DataFrame, key: str = "task_id") -> DataFrame:
    """Two extractions agree on the same spans with at most one label difference.

    Both frames hold (key, answer); the spans are joined, never nested per task.
    """
    from ..functions.entities import label_spans

    def spans(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(label_spans(F.col("answer"))).alias("span", name))

    joined = spans(first, "a").join(spans(second, "b"), [key, "span"], "full_outer")
    per_task = joined.groupBy(key).agg(
        F.count_if(F.col("a").isNotNull()).alias("first_spans"),
        F.count_if(F.col("b").isNotNull()).alias("second_spans"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("span_diffs"),
        F.count_if(F.col("a") != F.col("b")).alias("label_diffs"))
    seen = first.select(key).join(second.select(key), key).distinct()
    counted = seen.join(per_task, key, "left").na.fill(0)
    reason = (
        F.when(F.col("first_spans") == 0, "no_pairs").when(F.col("span_diffs") > 0, "spans_differ")
        .when(F.col("label_diffs") > 1, "labels_differ"))
    return counted.withColumn("reason", reason)


def label_quality(truth: DataFrame, predicted: DataFrame, key: str = "task_id", labels: str = "labels") -> DataFrame:
    """Precision, recall and F1 per label and over all labels (``(micro)``)."""
    t = truth.select(key, F.explode(labels).alias("label")).withColumn("t", F.lit(1)).distinct()
    p = predicted.select(key, F.explode(labels).alias("label")).withColumn("p", F.lit(1)).distinct()
    hit, both = F.col("t").isNotNull() & F.col("p").isNotNull(), t.join(p, [key, "label"], "full_outer")
    sums = both.rollup("label").agg(
        F.grouping("label").alias("__all"), F.count_if(hit).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        F.when(F.col("__all") == 1, "(micro)").otherwise(F.col("label")).alias("label"), "tp", "fp", "fn",
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


# --- models and strategies ---------------------------------------------------
def route_grid(runs: DataFrame) -> DataFrame:
    """Accuracy, tokens and time per model × category with totals on both sides."""
    grid = runs.cube("model", "category").agg(
        F.grouping("model").alias("__m"), F.grouping("category").alias("__c"),
        F.count(F.lit(1)).alias("total"), F.count_if("pass").alias("passed"),
        F.sum("tokens").alias("tokens"), F.sum("duration_ms").alias("duration_ms"))
    return grid.select(
        F.when(F.col("__m") == 1, "(all)").otherwise(F.col("model")).alias("model"),
        F.when(F.col("__c") == 1, "(all)").otherwise(F.col("category")).alias("category"),
        "total", "passed", "tokens", "duration_ms",
        (F.col("passed") / F.col("total")).alias("accuracy"))


def category_winner(cells: DataFrame) -> DataFrame:
    """Best model per category: most passes, then fewest tokens, then name."""
    best = F.min_by(F.struct("model", "passed", "total", "tokens"),
                    F.struct(-F.col("passed"), F.col("tokens"), F.col("model")))
    return cells.groupBy("category").agg(best.alias("w")).select("category", "w.*")


def best_strategy(runs: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Cheapest and fastest strategy; ties go to the smaller name."""
    return runs.groupBy(*keys).agg(
        F.min_by("strategy", F.struct("tokens", "strategy")).alias("best_tokens"),
        F.min("tokens").alias("fewest_tokens"),
        F.min_by("strategy", F.struct("duration_ms", "strategy")).alias("best_speed"),
        F.min("duration_ms").alias("shortest_ms"))

"""Quality rules whose cutoffs are certified on labelled documents.

``base_features`` counts words, symbols, repeated lines and repeated windows of a
whole text.  Each rule is a share that grows with bad quality, and a fixed ladder of
cutoffs.  On labelled good documents of a stratum, a cutoff is certified when the
exact binomial test rejects "its false rejection is above the limit".  Cutoffs are
tested from the most lenient on and testing stops at the first failure, so a ladder
needs no correction of its own; strata and rules share the error by Bonferroni.
With probability 1 - ``error`` no stratum loses more than ``limit`` of its good
documents to all rules together.  A rule without a certified cutoff rejects nothing.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.session import materialise

from .common import WORD_RE, arrow_map

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 5

RULES: dict[str, tuple[str, str]] = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "echo_share": ("n_echoes", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
}
"""Share of each rule: (counted, out of)."""

LADDER = (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
"""Cutoffs in the order of testing; chosen before any label is seen."""


def text_features(text: str) -> tuple[int, int, int, int, int, int, int]:
    """(words, their characters, symbols, lines with a word, repeated lines, repeated-window words, echoes)."""
    words = WORD_RE.findall(text)
    seen, n_lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if WORD_RE.search(line):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    repeated = 0
    distinct = set(windows)
    if len(distinct) < len(windows):
        count = dict.fromkeys(distinct, 0)
        for x in windows:
            count[x] += 1
        end = 0
        for i, x in enumerate(windows):
            if count[x] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    echoes = sum(map(str.__eq__, words, words[1:]))
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), n_lines, dup, repeated, echoes


def base_features(docs: DataFrame) -> DataFrame:
    """Counts per document; a null or empty text has none of anything.  ``lang`` becomes ``stratum``."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echoes")

    def run(batch):
        rows = [text_features(t or "") for t in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "stratum": batch.column(1)} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return arrow_map(docs.select("doc_id", lang.alias("lang"), "text"), run, "doc_id bigint, stratum string, " + ", ".join(f"{n} bigint" for n in names))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k successes of n)."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified_cutoff(rejected: list[int], n_good: int, limit: float, error: float) -> float | None:
    """Last cutoff of the ladder before the first whose false rejection is not proven within the limit."""
    best = None
    for cutoff, k in zip(LADDER, rejected):
        if n_good == 0 or k > limit * n_good or binomial_tail(k, n_good, limit) > error:
            break
        best = cutoff
    return best


def share(rule: str) -> Column:
    top, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.col(top) / F.col(whole)).otherwise(0.0)


def fit_cutoffs(features: DataFrame, labels: DataFrame, limit: float = 0.02, error: float = 0.05) -> dict[str, dict[str, float | None]]:
    """Certified cutoff of each rule by stratum.

    All labelled documents count: ``quality`` 1 is good; with several labels the
    worst holds, null labels and ids do not count.  Only counts come to the driver,
    one row per stratum.  Documents that fail the base rules are rejected anyway and
    take no part.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    counts = [F.count_if(share(r) > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(LADDER)]
    rows = features.filter(~base_failed()).join(good, "doc_id").groupBy("stratum").agg(F.count("*").alias("n"), *counts).collect()
    tests = max(1, len(rows) * len(RULES))
    return {r.stratum: {rule: certified_cutoff([r[f"{rule}_{i}"] for i in range(len(LADDER))], r.n, limit / len(RULES), error / tests)
                        for rule in RULES} for r in rows}


def judge(features: DataFrame, cutoffs: dict[str, dict[str, float | None]]) -> DataFrame:
    """Adds base_failed, failed_rule (first rule over its cutoff) and kept; a stratum without cutoffs keeps all."""
    def over(rule: str) -> Column:
        hits = [(F.col("stratum") == s) & (share(rule) > c[rule]) for s, c in cutoffs.items() if c[rule] is not None]
        return F.when(functools.reduce(Column.__or__, hits, F.lit(False)), F.lit(rule))

    return (features.withColumn("base_failed", base_failed())
            .withColumn("failed_rule", F.coalesce(*map(over, RULES)))
            .withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()))


def quality_verdicts(docs: DataFrame, labels: DataFrame, limit: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: counts, base_failed, failed_rule, kept."""
    features = materialise(base_features(docs))
    return judge(features, fit_cutoffs(features, labels, limit, error)).drop("stratum")

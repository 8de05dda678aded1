"""Entity signals, labelled spans and their surface checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .core import bind, extract_all, last_of_each, occurrences, trim_space


def years(text: Column) -> Column:
    return extract_all(text, V.YEAR)


def name_runs(text: Column) -> Column:
    return extract_all(text, V.NAME_RUN)


def mid_capitals(text: Column) -> Column:
    return extract_all(text, V.MID_CAPITAL, 1)


def acronyms(text: Column) -> Column:
    """All-caps words that are neither label names nor everyday abbreviations."""
    ignored = F.array(*[F.lit(w) for w in V.LABEL_WORDS + V.COMMON_ACRONYMS])
    return F.filter(extract_all(text, V.ACRONYM), lambda w: ~F.array_contains(ignored, w))


def entity_signals(text: Column) -> Column:
    """Distinct years, name runs, mid-sentence capitals and acronyms, in that order."""
    return F.array_distinct(F.concat(years(text), name_runs(text), mid_capitals(text), acronyms(text)))


def labelled_spans(text: Column) -> Column:
    """ARRAY<STRUCT<label, span>> of every ``LABEL: span`` in order."""
    return F.zip_with(
        extract_all(text, V.LABELLED_SPAN, 1), extract_all(text, V.LABELLED_SPAN, 2),
        lambda label, span: F.struct(label.alias("label"), trim_space(span).alias("span")))


def label_spans(text: Column) -> Column:
    """MAP<span, label>; the last label given to a span wins."""
    return bind(labelled_spans(text), lambda pairs: F.map_from_entries(F.transform(
        last_of_each(pairs, "span"), lambda p: F.struct(p["span"], p["label"]))))


def spans_unique(sentence: Column, spans: Column) -> Column:
    """Does every span occur exactly once in its sentence?"""
    return F.forall(spans, lambda s: occurrences(sentence, s) == 1)

"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_space(text: Column) -> Column:
    """Strip every kind of whitespace (``trim`` strips blanks only)."""
    return F.regexp_replace(text, f"^{V.ANY_SPACE}+|{V.ANY_SPACE}+$", "")


def presence(text: Column) -> Column:
    """Trimmed text, NULL where nothing is left."""
    return F.nullif(trim_space(text), F.lit(""))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL instead of '' when nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def non_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Value of a fixed lookup table, NULL for unknown keys."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def first_reason(*checks: tuple[Column, Column | str]) -> Column:
    """First reason whose condition is true; NULL (accepted) when none is."""
    out = None
    for condition, reason in checks:
        value = reason if isinstance(reason, Column) else F.lit(reason)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def occurrences(text: Column, needle: Column) -> Column:
    """Number of non-overlapping occurrences of ``needle``."""
    cut = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (cut / F.length(needle)).cast("int")).otherwise(F.lit(0))


def last_of_each(items: Column, field: str) -> Column:
    """Items whose ``field`` value does not come again later in the array."""
    return F.filter(items, lambda x, i: ~F.exists(
        F.slice(items, i + 2, F.size(items)), lambda y: y[field] == x[field]))

"""Numbers in text, ratio splits and travel questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .core import bind, contains_any, extract, extract_all


def number_tokens(text: Column) -> Column:
    """Unsigned number texts; thousands commas and a trailing dot removed."""
    found = extract_all(F.replace(text, F.lit(","), F.lit("")), r"[0-9]+\.?[0-9]*")
    return F.transform(found, lambda t: F.regexp_replace(t, r"\.$", ""))


def numbers(text: Column) -> Column:
    """ARRAY<DOUBLE> of the unsigned numbers of a text."""
    return F.transform(number_tokens(text), lambda t: t.try_cast("double"))


def max_number(text: Column) -> Column:
    """Largest number, zero when there is none."""
    return F.coalesce(F.array_max(numbers(text)), F.lit(0.0))


def first_signed_number(text: Column, commas: bool = False) -> Column:
    """First signed number; ``commas=True`` reads ``1,470`` as 1470."""
    source = F.regexp_replace(text, "(?<=[0-9]),(?=[0-9]{3})", "") if commas else text
    return extract(source, r"(-?[0-9]+(?:\.[0-9]+)?)").try_cast("double")


def decimals(token: Column) -> Column:
    """Digits after the decimal point of a number text."""
    return F.length(F.regexp_extract(token, r"\.([0-9]*)$", 1))


def group_thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def ratio_shares(prompt: Column) -> Column:
    """STRUCT<parts, shares, symbol> of an exact ``split X in the ratio a:b`` prompt.

    NULL unless the total is a whole number that the parts divide exactly.
    """
    raw = extract(prompt, V.RATIO_TOTAL)
    total = F.regexp_replace(raw, "[£$€, ]", "").try_cast("double")
    part_texts = F.split(extract(prompt, V.RATIO_PARTS), ":")
    parts = F.transform(part_texts, lambda p: F.trim(p).try_cast("bigint"))
    symbol = F.regexp_extract(raw, "^([£$€])", 1)

    def derive(s: Column) -> Column:
        whole = F.aggregate(s["parts"], F.lit(0).cast("bigint"), lambda a, p: a + p)
        unit = F.try_divide(s["total"], whole)
        exact = (s["total"] > 0) & F.forall(s["parts"], lambda p: p > 0) & (unit == F.floor(unit))
        return F.when(exact, F.struct(
            s["parts"].alias("parts"),
            F.transform(s["parts"], lambda p: p * unit.cast("bigint")).alias("shares"),
            s["symbol"].alias("symbol"),
        ))

    return bind(F.struct(total.alias("total"), parts.alias("parts"), symbol.alias("symbol")), derive)


def ratio_answer(prompt: Column) -> Column:
    """The answer an exact ratio question implies; NULL when it is not derivable."""
    asked = contains_any(F.lower(prompt), V.SHARE_QUESTIONS)

    def compose(s: Column) -> Column:
        amounts = F.transform(s["shares"], lambda v: F.concat(s["symbol"], group_thousands(v)))
        n = F.size(amounts)
        listed = F.when(n > 1, F.concat(
            F.array_join(F.slice(amounts, 1, n - 1), ", "), F.lit(" and "), F.element_at(amounts, -1)),
        ).otherwise(F.element_at(amounts, 1))
        ratio = F.array_join(F.transform(s["parts"], lambda p: p.cast("string")), ":")
        return F.when(s.isNotNull(), F.concat(
            F.lit("Splitting in the ratio "), ratio, F.lit(", the shares are "), listed,
            F.lit(" respectively.")))

    return F.when(asked, bind(ratio_shares(prompt), compose))


def clock_minutes(hours: Column, minutes: Column) -> Column:
    return hours.try_cast("int") * 60 + minutes.try_cast("int")


def travel_facts(prompt: Column) -> Column:
    """STRUCT<speeds, departures, distance> of a two-vehicle question.

    Departures are minutes of the day; the distance is the largest ``km`` figure
    that is not one of the two speeds.  NULL unless there are two of each.
    """
    speeds = F.transform(extract_all(prompt, V.SPEED, 1), lambda v: v.try_cast("int"))
    departures = F.zip_with(
        extract_all(prompt, V.DEPARTURE, 1), extract_all(prompt, V.DEPARTURE, 2), clock_minutes)

    def with_distance(s: Column) -> Column:
        figures = F.transform(extract_all(prompt, V.DISTANCE, 1), lambda v: v.try_cast("int"))
        distance = F.array_max(F.filter(figures, lambda v: ~F.array_contains(s["speeds"], v)))
        complete = (F.size(s["speeds"]) == 2) & (F.size(s["departures"]) == 2)
        return F.when(complete & (distance > 0), F.struct(
            s["speeds"].alias("speeds"), s["departures"].alias("departures"),
            distance.alias("distance")))

    return bind(F.struct(speeds.alias("speeds"), departures.alias("departures")), with_distance)

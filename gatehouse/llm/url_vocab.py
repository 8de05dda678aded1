"""URL verdicts from host rules and a weighted vocabulary.

Rules name a host, with its subdomains, and a path start; the longest that fits
decides.  Otherwise an Aho-Corasick automaton finds vocabulary terms in host and
path.  A term counts only between boundaries.  One strict term blocks, or several
distinct soft ones.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

STRICT = ("casino", "porn", "xxx", "viagra", "cheap-pills", "free-bets", "adult-x", "spam-farm", "escort", "warez")
SOFT = ("adult", "ads", "bet", "bets", "bonus", "cheap", "click", "deal", "download", "farm", "free", "jackpot", "loan", "lottery",
        "pills", "poker", "promo", "sex", "slots", "spam", "track", "win", "winner")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


@functools.cache
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            a.add_word(term.lower(), (kind, term.lower()))
    a.make_automaton()
    return a


def count_terms(text: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """(strict hits, distinct soft terms) of a lower-cased text; letters and digits beside a term void the hit."""
    n_strict, found = 0, set()
    if strict or soft:
        for end, (kind, term) in automaton(strict, soft).iter(text):
            start = end + 1 - len(term)
            if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            if kind == "strict":
                n_strict += 1
            else:
                found.add(term)
    return n_strict, len(found)


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT,
                 soft_limit: int = 2) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft; one row per row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, fits no rule and
    holds no term: it is allowed.
    """
    host, path = url_parts(F.col("url"))

    def run(batch):
        hits = [count_terms(f"{h}{p}".lower(), strict, soft) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return {"page_id": batch.column(0), "host": batch.column(1), "path": batch.column(2), "n_strict": [s for s, _ in hits], "n_soft": [s for _, s in hits]}

    counted = arrow_map(pages.select("page_id", host.alias("host"), path.alias("path")), run, "page_id bigint, host string, path string, n_strict int, n_soft int")
    ordered = sorted(rules, key=lambda r: len(r.text), reverse=True)
    h, p = F.col("host"), F.col("path")
    none = F.lit(None).cast("string")
    text, verdict = F.coalesce(none, *(F.when(fits(r, h, p), r.text) for r in ordered)), F.coalesce(none, *(F.when(fits(r, h, p), r.verdict) for r in ordered))
    by_terms = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    return counted.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, by_terms).alias("verdict"), "n_strict", "n_soft")

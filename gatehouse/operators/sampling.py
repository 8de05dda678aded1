"""Caps, quotas, weights, unions and chat rows for training tables."""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import hashing as H
from ..functions.core import lookup
from ..session import broadcast_if_small
from .ordering import first_by_digest, position

log = logging.getLogger(__name__)


def cap_per_family(rows: DataFrame, k: int, priority: Column, seed: int = 0, family: str = "family",
                   prompt: str = "prompt") -> DataFrame:
    """First ``k`` distinct prompts per family: lowest priority, then keyed hash.

    A report-sized pool is the feature here, as in the source of a training pool, but ``k`` may
    be of any size.  The choice is made on (family, priority, digest of the prompt) alone; the
    rows themselves are met again at the end.  ``priority`` has few values.
    """
    keyed = rows.withColumn("__prio", priority).withColumn("__order", H.seeded_md5(seed, F.col(prompt)))
    unique = keyed.groupBy(family, "__order").agg(F.min("__prio").alias("__prio"))
    chosen = broadcast_if_small(first_by_digest(unique, [family], F.lit(k), "__order", rank_first=["__prio"]).select(
        F.col(family).alias("__family"), F.col("__order").alias("__chosen"), F.col("__prio").alias("__least")))
    met = keyed.join(chosen, F.col(family).eqNullSafe(F.col("__family")) & F.col("__order").eqNullSafe(F.col("__chosen"))
                     & F.col("__prio").eqNullSafe(F.col("__least")), "left_semi")
    return met.dropDuplicates([family, "__order"]).drop("__prio", "__order")


def quota_sample(rows: DataFrame, stratum: str, quotas: Mapping[str, int], seed: int = 0,
                 key: str = "task_id") -> DataFrame:
    """Keyed sample with a fixed number of rows per stratum; other strata yield none."""
    keyed = rows.withColumn("__order", H.seeded_md5(seed, F.col(key)))
    return first_by_digest(keyed, [stratum], lookup(F.col(stratum), quotas), "__order", [key]).drop("__order")


def weight_rows(rows: DataFrame, weight: Column) -> DataFrame:
    """Repeat each row ``weight`` times; ``copy`` counts from one."""
    return rows.withColumn("copy", F.explode(
        F.when(weight >= 1, F.sequence(F.lit(1), weight.cast("int")))))


def seeded_shuffle(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Reproducible order: sort by a keyed hash, never by ``rand()``."""
    return rows.orderBy(H.seeded(seed, *[F.col(k) for k in keys]), *keys)


def union_caches(sources: Mapping[str, DataFrame | None], tag: str = "cache") -> DataFrame:
    """Union of optional sources by name; a missing source is skipped with a warning."""
    out = None
    for name, df in sources.items():
        if df is None:
            log.warning("cache %s missing, skipping", name)
            continue
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no cache available")
    return out


def holdout_keys(rows: DataFrame, reserved: DataFrame, key: str) -> DataFrame:
    """Add ``split``: rows whose key is reserved are heldout."""
    marks = reserved.select(key).distinct().withColumn("__held", F.lit(True))
    return rows.join(marks, key, "left").withColumn(
        "split", F.when(F.col("__held"), "heldout").otherwise("train")).drop("__held")


def to_chat_rows(rows: DataFrame, family: str = "family", prompt: str = "prompt",
                 answer: str = "answer") -> DataFrame:
    """(family, messages) with the family's system prompt first."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    system = lookup(F.col(family), V.FAMILY_SYSTEM_PROMPTS)
    return rows.withColumn("messages", F.array(
        message("system", system), message("user", F.col(prompt)), message("assistant", F.col(answer))))


def flatten_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """User turns with the assistant turn that follows directly.

    Turn numbers are consecutive, so the next turn is an equi-join on
    (conversation, turn + 1): no conversation has to fit one task.
    """
    users = turns.where(F.col(role) == "user").select(conv, turn, F.col(text).alias("prompt"))
    replies = turns.where(F.col(role) == "assistant").select(
        conv, (F.col(turn) - 1).alias(turn), F.col(text).alias("answer"))
    return users.join(replies, [conv, turn])


def chat_heads(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """First system and first user text of each conversation."""
    def first(which: str) -> Column:
        return F.min_by(F.when(F.col(role) == which, F.col(text)),
                        F.when(F.col(role) == which, F.col(turn)))

    return turns.groupBy(conv).agg(first("system").alias("system"), first("user").alias("user"))


def expand_templates(rows: DataFrame, key: str, templates: Sequence[tuple[str, Sequence[tuple[str, str]]]],
                     seed: int = 0) -> DataFrame:
    """Fill a hash-picked template from the slot columns of each row.

    A template is (text with ``{slot}`` marks, [(slot, label), …]).  Adds
    ``template``, ``prompt`` and ``spans`` (ARRAY<STRUCT<span, label>>) in slot
    order, and keeps rows whose spans occur exactly once each.
    """
    from ..functions.entities import spans_unique

    pick = F.conv(F.substr(H.seeded_md5(seed, F.col(key)), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    chosen = rows.withColumn("template", (pick % len(templates)).cast("int"))

    def by_template(build) -> Column:
        out = None
        for i, t in enumerate(templates):
            cond = F.col("template") == i
            out = F.when(cond, build(t)) if out is None else out.when(cond, build(t))
        return out

    def fill(t) -> Column:
        text = F.lit(t[0])
        for slot, _ in t[1]:
            text = F.replace(text, F.lit("{%s}" % slot), F.col(slot))
        return text

    def spans(t) -> Column:
        return F.array(*[F.struct(
            F.regexp_replace(F.col(slot), "^the ", "").alias("span"), F.lit(label).alias("label"))
            for slot, label in t[1]])

    filled = chosen.withColumn("prompt", by_template(fill)).withColumn("spans", by_template(spans))
    return filled.where(spans_unique(F.col("prompt"), F.transform("spans", lambda s: s["span"])))


LARGEST_BANKS = 10**18
"""Most combinations that banks may have: their numbers are then exact decimals."""


def expand_banks(prompts: int, templates: Sequence[str], banks: Mapping[str, DataFrame], seed: int = 0) -> DataFrame:
    """``prompts`` different fillings of the templates' ``{slot}`` marks from banks of slot values.

    A bank is a table whose first column holds the values; equal ones count once.  Filling
    number ``n`` is the ``n``-th combination in an order that the seed shuffles: the numbers
    0, 1, … go through a permutation of all combinations (a multiplier without a common
    factor, and an offset), and the result is read as digits, one for each bank and one for
    the template.  Each digit is an equi-join with its bank, so no combination is made that
    is not returned, and none comes twice.  Columns: n, template, one per slot, prompt.
    """
    if not templates or not banks:
        raise ValueError("templates and banks are needed")
    spark = next(iter(banks.values())).sparkSession
    numbered, sizes = {}, {"template": len(templates)}
    for slot, bank in banks.items():
        values = bank.select(F.col(bank.columns[0]).cast("string").alias(slot)).where(F.col(slot).isNotNull()).distinct()
        order = position(values.withColumn("__lead", F.substr(F.md5(slot), F.lit(1), F.lit(2))).withColumn("__md5", F.md5(slot)), [], ["__md5"], F.col("__lead"), f"__at_{slot}")
        numbered[slot] = broadcast_if_small(order.select((F.col(f"__at_{slot}") - 1).alias(f"__at_{slot}"), slot))
        sizes[slot] = numbered[slot].count()
    total = math.prod(sizes.values())
    if prompts > total or total > LARGEST_BANKS:
        raise ValueError(f"{prompts} prompts of {total} combinations")
    factor, offset = permutation(total, seed)
    wide = "decimal(38,0)"
    at = F.pmod(F.col("id").cast("decimal(19,0)") * F.lit(factor).cast("decimal(19,0)") + F.lit(offset).cast(wide), F.lit(total).cast(wide)).cast("bigint")
    out = spark.range(prompts).select(F.col("id").alias("n"), at.alias("__rest"))
    for slot, size in sizes.items():
        out = out.withColumn(f"__at_{slot}", F.col("__rest") % size).withColumn("__rest", F.call_function("div", F.col("__rest"), F.lit(size)))
    for slot in banks:
        out = out.join(numbered[slot], f"__at_{slot}")
    texts = F.array(*(F.lit(t) for t in templates))
    prompt = F.get(texts, F.col("__at_template").cast("int"))
    for slot in banks:
        prompt = F.replace(prompt, F.lit("{%s}" % slot), F.col(slot))
    return out.select("n", F.col("__at_template").cast("int").alias("template"), *banks, prompt.alias("prompt"))


def permutation(total: int, seed: int) -> tuple[int, int]:
    """Multiplier and offset that shuffle 0 … ``total - 1``: the multiplier is near the golden section and shares no factor with ``total``."""
    factor = max(1, round(total * 0.6180339887498949) + seed % max(1, total))
    while math.gcd(factor, total) != 1:
        factor += 1
    return factor % total or 1, seed * 7919 % total

"""Character and token budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .core import lookup


def budget_chars(max_tokens: Column, reserve: Column | None = None) -> Column:
    """Characters left for a prompt after the reserve, four per token."""
    reserve = F.lit(V.DEFAULT_RESERVE_TOKENS) if reserve is None else reserve
    usable = F.when(max_tokens <= reserve, max_tokens).otherwise(max_tokens - reserve)
    return usable * V.CHARS_PER_TOKEN


def per_task_budget(budget: Column, fixed_chars: Column, tasks: Column) -> Column:
    """Share of one task: what the fixed parts leave, split evenly, with floors."""
    left = F.greatest(budget - fixed_chars - V.FIXED_OVERHEAD_CHARS, F.lit(V.MIN_BATCH_CHARS))
    return F.when(tasks > 0, F.greatest(F.floor(left / tasks), F.lit(V.MIN_TASK_CHARS))).otherwise(left)


def normal_effort(effort: Column) -> Column:
    low = F.lower(F.trim(effort))
    return (
        F.when(low.isNull() | low.isin("", "off", "none", "0", "false", "disabled"), "none")
        .when(low.isin("low", "medium", "high", "xhigh"), low).otherwise("low")
    )


def max_tokens(batch_size: Column, effort: Column, turn: Column, uses_code: Column) -> Column:
    """Completion cap of a batch: per-task room, effort floor, retry and code allowances."""
    room = V.TOKENS_BASE + batch_size * V.TOKENS_PER_TASK
    floor = F.coalesce(lookup(normal_effort(effort), V.EFFORT_FLOORS), F.lit(0))
    base = F.greatest(room, floor)
    base = F.when(turn > 0, F.floor(base * 5 / 4)).otherwise(base)
    base = F.when(uses_code & (turn == 0), F.greatest(base, F.lit(V.TOKENS_CODE_MIN))).otherwise(base)
    return F.least(F.greatest(base, F.lit(V.TOKENS_MIN)), F.lit(V.TOKENS_MAX)).cast("bigint")

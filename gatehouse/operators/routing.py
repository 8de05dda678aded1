"""Routing tasks to lanes, merging answers and planning batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import budgets as B
from ..functions import fixed as V
from ..functions import numbers as N
from ..functions import text as X
from ..functions.core import bind, lookup, presence
from ..session import broadcast_if_small, require_bounded
from .gates import gate_meeting_time
from .ordering import position

TOOL_CATEGORIES = V.CODE_EXEC_CATEGORIES


def top_labels(scores: Column, thresholds: Mapping[str, float], prompt: Column | None = None) -> Column:
    """Labels of ARRAY<STRUCT<label, score>> that reach their threshold, best first.

    With ``prompt`` the keyword category stands in where no label qualifies.
    """
    kept = F.filter(scores, lambda s: s["score"] >= lookup(s["label"], thresholds))
    ranked = F.array_sort(F.transform(kept, lambda s: F.struct(
        (-s["score"]).alias("o"), s["label"].alias("label"))))
    labels = F.transform(ranked, lambda s: s["label"])
    if prompt is None:
        return labels
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(X.keyword_category(prompt)))


def lane(prompt: Column, top: Column, extended: Sequence[str] = (), remote: bool = True) -> Column:
    """Lane of a task from its keyword category and the classifier's top label.

    A local lane needs agreement.  Without a remote, disagreement on maths or
    logic follows the classifier to the tool lane.
    """
    return bind(prompt_facts(prompt), lambda facts: lane_of(facts, top, extended, remote))


def prompt_facts(prompt: Column) -> Column:
    """All that a lane needs of a prompt: its keyword category, and whether a code problem asks for a value."""
    return bind(X.keyword_category(prompt), lambda keyword: F.struct(keyword.alias("keyword"), F.when(
        keyword == "code_debugging", X.evaluates_code(prompt)).alias("evaluates")))


def lane_of(facts: Column, top: Column, extended: Sequence[str] = (), remote: bool = True) -> Column:
    """:func:`lane` from the :func:`prompt_facts` of the prompt."""
    keyword = facts["keyword"]
    agree = F.coalesce(top == keyword, F.lit(True))
    by_keyword = (
        F.when(keyword.isin("code_generation", "named_entity_recognition", *extended), "assist")
        .when((keyword == "code_debugging") & facts["evaluates"], "code_trace")
        .when(keyword == "code_debugging", "assist")
        .when(keyword.isin(*TOOL_CATEGORIES), "tool")
        .otherwise("remote"))
    apart = F.lit("remote") if remote else F.when(top.isin(*TOOL_CATEGORIES), "tool").otherwise("remote")
    return F.when(agree, by_keyword).otherwise(apart)


def route(tasks: DataFrame, predictions: DataFrame, **options) -> DataFrame:
    """Add ``top``, ``keyword`` and ``lane``; ``predictions`` holds (task_id, labels).

    A prompt is read once, before the join, so that it is shuffled only for a caller that
    asks for it.  A generator is not inlined, so filters by lane do not repeat the work.
    """
    tops = predictions.select("task_id", F.get("labels", F.lit(0)).alias("top"))
    marked = tasks.select("*", F.explode(F.array(prompt_facts(F.col("prompt")))).alias("__facts"))
    joined = marked.join(tops, "task_id", "left")
    return joined.select(*(F.col(f"`{c}`") for c in joined.columns if c != "__facts"), F.col("__facts.keyword").alias("keyword"),
                         lane_of(F.col("__facts"), F.col("top"), **options).alias("lane"))


def attach_policy(tasks: DataFrame, effort: Mapping[str, str] = V.LEAN_EFFORT,
                  models: Mapping[str, str] | None = None, default_model: str = "default") -> DataFrame:
    """Add effort, model, system prompt and code-execution flag by ``category``.

    The tables have one entry per category, so they are literals, not joins.
    """
    cat = F.col("category")
    family = lookup(lookup(cat, {v: k for k, v in V.CANONICAL_CATEGORY.items()}), V.FAMILY_OF_CATEGORY)
    model = F.coalesce(lookup(cat, models), F.lit(default_model)) if models else F.lit(default_model)
    return tasks.select(
        "*", B.normal_effort(lookup(cat, effort)).alias("effort"), model.alias("model"),
        lookup(family, V.FAMILY_SYSTEM_PROMPTS).alias("system"),
        cat.isin(*V.CODE_EXEC_CATEGORIES).alias("uses_code"))


# --- answers -----------------------------------------------------------------
def merge_answers(tasks: DataFrame, sources: Sequence[tuple[str, DataFrame]], rejects: DataFrame | None = None,
                  fallback: str = V.FALLBACK_ANSWER) -> DataFrame:
    """One answer per task: the last non-empty source wins, then a rejected answer,
    then the apology.  ``source`` names the origin, ``is_fallback`` the last two.

    Of several non-empty answers a source holds for a task the last by ``pos`` counts,
    where it has that column, and of equal ones the greatest text.
    """
    out, found = tasks, []
    for i, (name, df) in enumerate(sources):
        out = out.join(last_answers(df, **{f"__a{i}": F.lit(True)}), "task_id", "left")
        found.insert(0, (name, F.col(f"__a{i}")))
    if rejects is not None:
        out = out.join(last_answers(rejects, __rej=F.lit(True)), "task_id", "left")
        found.append(("rejected", F.col("__rej")))
    return choose_answer(out, tasks.columns, found, fallback)


def last_answers(answers: DataFrame, **kinds: Column) -> DataFrame:
    """One row per task: for each name in ``kinds`` the last non-empty answer its condition holds for."""
    text = presence(F.col("answer"))
    order = F.struct(*(c for c in ("pos",) if c in answers.columns), text.alias("answer"))
    return answers.groupBy("task_id").agg(*(
        F.max(F.when(text.isNotNull() & cond, order))["answer"].alias(name) for name, cond in kinds.items()))


def choose_answer(rows: DataFrame, keep: Sequence[str], found: Sequence[tuple[str, Column]],
                  fallback: str = V.FALLBACK_ANSWER) -> DataFrame:
    """The first answer of ``found`` that is there, with its origin, else the apology."""
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in found], F.lit("apology"))
    return rows.select(
        *keep, F.coalesce(*[c for _, c in found], F.lit(fallback)).alias("answer"),
        origin.alias("source"), origin.isin("rejected", "apology").alias("is_fallback"))


def missing_tasks(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Tasks without a non-empty answer."""
    given = answers.where(presence(F.col("answer")).isNotNull()).select("task_id").distinct()
    return tasks.join(given, "task_id", "left_anti")


def is_complete(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: the number of missing tasks and whether there are none."""
    return missing_tasks(tasks, answers).agg(F.count(F.lit(1)).alias("missing")).withColumn(
        "complete", F.col("missing") == 0)


def screen_and_requeue(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Shipped answer per task after the physics screen.

    ``attempts`` holds (task_id, attempt, answer).  A first answer that fails the
    meeting-time gate is dropped; whatever the second attempt says ships.  Tasks
    left without an answer come back with ``requeue`` set.
    """
    joined = attempts.join(tasks.select("task_id", "prompt"), "task_id")
    screened = joined.withColumn("reason", F.when(
        F.col("attempt") == 1, gate_meeting_time(F.col("prompt"), F.col("answer"))))
    kept = presence(F.col("answer")).isNotNull() & F.col("reason").isNull()
    per_task = screened.groupBy("task_id").agg(
        F.max_by(F.when(kept, F.col("answer")), F.when(kept, F.col("attempt"))).alias("answer"),
        F.max(F.when(kept, F.col("attempt"))).alias("attempt"),
        F.count_if(F.col("reason").isNotNull()).alias("dropped"))
    return tasks.select("task_id").join(per_task, "task_id", "left").select(
        "task_id", "answer", "attempt", F.coalesce("dropped", F.lit(0)).cast("bigint").alias("dropped"),
        F.col("answer").isNull().alias("requeue"))


def accept_retry(attempts: DataFrame) -> DataFrame:
    """First or second attempt per task: a retry counts only when it is accepted and
    its output holds at least as many numbers as the first one's, or is all there is.

    ``attempts`` holds (task_id, attempt, answer, stdout, ok).
    """
    size = F.size(N.number_tokens(F.coalesce("stdout", F.lit(""))))
    sized = attempts.where(F.col("attempt").isin(1, 2)).select("task_id", "attempt", F.struct("ok", size.alias("n"), "answer").alias("a"))
    both = sized.groupBy("task_id").agg(*(F.max(F.when(F.col("attempt") == n, F.col("a"))).alias(p) for n, p in ((1, "first"), (2, "retry"))))
    first, retry = F.col("first"), F.col("retry")
    use = F.coalesce(first.isNull() | (~first["ok"] & retry["ok"] & (retry["n"] >= first["n"])), F.lit(False))
    return both.select("task_id", F.when(use, 2).otherwise(1).cast("bigint").alias("attempt"), *(
        F.when(use, retry[c]).otherwise(first[c]).alias(c) for c in ("answer", "ok")))


def sweep_order(tasks: DataFrame, rejects: DataFrame) -> DataFrame:
    """Tasks without a rejected answer first, input order otherwise."""
    marks = rejects.where(presence(F.col("answer")).isNotNull()).select("task_id").distinct().withColumn(
        "__r", F.lit(True))
    marked = tasks.join(marks, "task_id", "left").withColumn("has_reject", F.col("__r").isNotNull()).drop("__r")
    return marked.orderBy("has_reject", "pos", "task_id")


def attach_tool_traces(calls: DataFrame, traces: DataFrame) -> DataFrame:
    """Traces go, as an ordered list, to the latest call of the same turn and the same ordered task ids.

    ``calls`` holds (call_id, turn, task_ids, …), ``traces`` (turn, task_ids, index, trace).
    Every call comes back once; ``traces`` is NULL where it has none.  A call runs its code
    a few times, so its list is short.
    """
    listed = traces.groupBy("turn", "task_ids").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("index", "trace"))), lambda t: t["trace"]).alias("traces"))
    latest = calls.groupBy("turn", "task_ids").agg(F.max("call_id").alias("call_id"))
    return calls.join(listed.join(latest, ["turn", "task_ids"]).select("call_id", "traces"), "call_id", "left")


# --- batches -----------------------------------------------------------------
BATCH_SIZE = 40
FOLD_LIMIT = 2


def plan_batches(tasks: DataFrame, size: int = BATCH_SIZE, code_size: int | None = None,
                 isolation: str = "focus", fold: int = FOLD_LIMIT, run: str = "run_id",
                 width: int = 1_000_000) -> DataFrame:
    """Batches per run: (run, batch_index, task_ids, size, effort, category_kind).

    ``tasks`` holds (run, pos, task_id, category, effort).  Tasks are grouped by
    effort, code use and isolated category; code groups of at most ``fold`` tasks
    join the first direct group; groups are cut into chunks in task order.
    """
    code_size = code_size or size
    code = F.col("category").isin(*V.CODE_EXEC_CATEGORIES)
    focus = {
        "focus": F.when(F.col("category") == "logical_deductive_reasoning", F.col("category")),
        "math": F.when(F.col("category") == "mathematical_reasoning", F.col("category")),
        "none": F.lit(None).cast("string"),
    }[isolation]
    grouped = tasks.withColumn("__code", code).withColumn("__focus", F.coalesce(focus, F.lit("")))
    by_group = [run, "effort", "__code", "__focus"]
    # One row per group; a run has a handful of groups whatever its size.
    groups = grouped.groupBy(*by_group).agg(F.min("pos").alias("__start"), F.count(F.lit(1)).alias("__n"))
    runs = Window.partitionBy(run)
    direct_start = F.min(F.when(~F.col("__code"), F.col("__start"))).over(runs)
    folds = F.col("__code") & (F.col("__n") <= fold) & direct_start.isNotNull()
    homes = groups.withColumn("__home", F.when(folds, direct_start).otherwise(F.col("__start"))).withColumn(
        "__own", ~folds)
    head = Window.partitionBy(run, "__home")
    homes = homes.withColumn("__home_effort", F.min(F.when(F.col("__own"), F.col("effort"))).over(head)).withColumn(
        "__home_code", F.min(F.when(F.col("__own"), F.col("__code"))).over(head)).withColumn(
        "__total", F.sum("__n").over(head))
    chunk = F.when(F.col("__home_code"), code_size).otherwise(size)
    # Batches of the groups that start earlier come first.
    sizes = homes.where("__own").select(run, "__home", F.ceil(F.col("__total") / chunk).alias("__batches"))
    earlier = Window.partitionBy(run).orderBy("__home").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(run, "__home", F.coalesce(F.sum("__batches").over(earlier), F.lit(0)).alias("__first"))
    # Own tasks in order, then each folded group in order of its start.
    fold_rank = F.when(F.col("__own"), F.lit(-1)).otherwise(F.col("__start"))
    # Computed once; where it is small the tasks keep their place and no run is shuffled whole.
    plan = broadcast_if_small(homes.withColumn("__rank", fold_rank).join(offsets, [run, "__home"]).select(
        *by_group, "__home", "__home_effort", "__home_code", "__rank", "__first"))
    placed = grouped.join(plan, by_group)
    numbered = position(
        placed, [run, "__home"], ["__rank", "pos"],
        F.struct("__rank", F.floor(F.col("pos") / width)), "__place")
    batch = F.col("__first") + F.floor((F.col("__place") - 1) / chunk)
    # A batch holds at most ``size`` tasks, so its list is bounded.
    return numbered.withColumn("batch_index", batch.cast("bigint")).groupBy(run, "batch_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__place", "task_id"))),
                    lambda t: t["task_id"]).alias("task_ids"),
        F.count(F.lit(1)).alias("size"), F.first("__home_effort").alias("effort"),
        F.first("__home_code").alias("uses_code"))


def batch_policy(batches: DataFrame, turn: int = 0) -> DataFrame:
    """Add the completion cap of each planned batch."""
    return batches.withColumn("max_tokens", B.max_tokens(
        F.col("size"), F.col("effort"), F.lit(turn), F.col("uses_code")))


def pack_by_token_budget(tasks: DataFrame, budget: int, run: str = "run_id", tokens: str = "tokens",
                         order: str = "pos", width: int = 1_000_000) -> DataFrame:
    """Chunk number by cumulative token estimate, per run and in task order."""
    from .ordering import running_sum
    summed = running_sum(tasks, [run], [order], F.floor(F.col(order) / width), F.col(tokens), "__used",
                         inclusive=False)
    return summed.withColumn("chunk", F.floor(F.col("__used") / budget).cast("bigint")).drop("__used")


def to_task_sheet(tasks: DataFrame, batch: Sequence[str] = ("run_id", "batch_index")) -> DataFrame:
    """One text sheet per batch and task kind, with the ids it lists.

    ``tasks`` holds (batch keys, pos, task_id, prompt, category) of planned
    batches.  A sheet is one text, so rows and bytes of a batch are counted first.
    """
    require_bounded(tasks, batch, F.concat_ws("", "task_id", "prompt"))
    kind = F.coalesce(lookup(F.col("category"), V.SHEET_KINDS), F.lit("TASK"))
    known = lookup(F.col("category"), V.SHEET_KINDS)
    head = F.concat(F.lit("== "), F.col("task_id"), F.coalesce(F.concat(F.lit(" "), known), F.lit("")), F.lit(" ==\n"))
    block = F.concat(head, F.trim(F.col("prompt")), F.lit("\n"))
    grouped = tasks.select(*batch, kind.alias("kind"), "pos", "task_id", block.alias("block")).groupBy(
        *batch, "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "task_id", "block"))).alias("b"))
    return grouped.select(
        *batch, "kind", F.transform("b", lambda x: x["task_id"]).alias("task_ids"),
        F.concat(F.lit("TASK TYPE: "), F.col("kind"), F.lit("\n"),
                 F.array_join(F.transform("b", lambda x: x["block"]), "")).alias("sheet"))


SHEET_ORDER = ["FACTUAL", "SENTIMENT", "SUMMARY", "NER", "CODE_DEBUG", "CODE_GENERATION", "TASK"]


def sheet_manifest(sheets: DataFrame, batch: Sequence[str] = ("run_id", "batch_index")) -> DataFrame:
    """One line per batch that names every kind and its ids, in the fixed kind order."""
    place = lookup(F.col("kind"), {k: i for i, k in enumerate(SHEET_ORDER)})
    line = F.concat(F.col("kind"), F.lit("=["), F.array_join("task_ids", ","), F.lit("]"))
    parts = F.array_sort(F.collect_list(F.struct(place.alias("o"), line.alias("line"))))
    return sheets.groupBy(*batch).agg(F.concat(
        F.lit("Task types and exact ids: "), F.array_join(F.transform(parts, lambda p: p["line"]), "; "),
        F.lit(". Return exactly one answer for every listed id.")).alias("manifest"))

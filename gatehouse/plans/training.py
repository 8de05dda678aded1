"""Training tables: preference pairs and chat rows, decontaminated and split."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import decontam as D
from ..operators import pairs as P
from ..operators import sampling as S
from ..operators.gates import gate
from ..session import materialise


def preference_table(answers: DataFrame, passages: DataFrame, benchmark: DataFrame, families: list[str] | None = None,
                     forbidden: DataFrame | None = None, min_shared: int = 1, rounds: int | None = None) -> DataFrame:
    """Gate answers, drop those about contaminated passages, and pair them per task.

    ``answers`` holds (doc_id, task_id, family, prompt, answer), ``passages`` (doc_id, text).
    Passages are read once, however many answers they have, and never enter the pair
    joins.  ``forbidden`` holds evaluation tasks (task_id, prompt): tasks with such an id
    or prompt are left out, and what is left is checked for both, one row per task,
    before any pair is made.  All pairs of a task come back, with its prompt (the first,
    if it has several); ``rounds`` pages through a hot task's.
    """
    clean = answers.join(D.contaminated_ids(passages, benchmark, min_shared=min_shared), "doc_id", "left_anti")
    if forbidden is not None:
        clean = D.decontaminate_exact(clean, forbidden)
    gated = gate(clean, families=families)
    archive = gated.select("task_id", "family", "answer", F.col("accepted").alias("pass"),
                           F.lit("gated").alias("file"), F.col("doc_id").alias("pos"))
    prompts = materialise(clean.groupBy("task_id").agg(F.min("prompt").alias("prompt")))
    if forbidden is not None:
        D.require_clean(prompts, forbidden)
    return P.with_system_prompt(P.preference_pairs(archive, rounds=rounds)).join(prompts, "task_id")


def chat_table(caches: Mapping[str, DataFrame | None], evaluation: DataFrame, weight: Column | None = None,
               split: str = "train", key: str = "task_id") -> DataFrame:
    """Union of caches → decontaminated → hash split → weighted → chat rows.

    ``evaluation`` holds (key, prompt).  ``split`` is train, heldout or all.
    """
    rows = D.hash_split(D.decontaminate_exact(S.union_caches(caches), evaluation, key, "prompt"), "prompt")
    if split != "all":
        rows = rows.where(F.col("split") == split)
    if weight is not None:
        rows = S.weight_rows(rows, weight)
    return S.to_chat_rows(rows)

"""Answers out of batch replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import trim_space
from ..functions.replies import best_answers
from ..session import materialise, require_bounded


def parse_answers(replies: DataFrame, tasks: DataFrame, key: str = "batch_id", reply: str = "reply") -> DataFrame:
    """(key, task_id, answer) of the ids a batch asked for.

    ``tasks`` holds (key, task_id).  A batch is one prompt with one reply in one
    row; its distinct ids join it once as a list, and are counted before they become one.
    """
    asked = require_bounded(materialise(tasks.select(key, "task_id").distinct()), [key], F.col("task_id"))
    ids = asked.groupBy(key).agg(F.collect_set("task_id").alias("__ids"))
    found = replies.join(ids, key).select(key, F.explode(best_answers(F.col(reply), F.col("__ids"))).alias("a"))
    return found.select(key, "a.task_id", trim_space(F.col("a.answer")).alias("answer"))

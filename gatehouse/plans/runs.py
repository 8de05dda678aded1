"""Answer runs and evaluations, end to end over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import routing as R
from ..operators import scoring as S
from ..operators.gates import gate


def answer_run(tasks: DataFrame, predictions: DataFrame, candidates: DataFrame, remote: DataFrame,
               families: list[str] | None = None) -> DataFrame:
    """Route tasks, gate local candidates, and merge them with remote answers: one row per task.

    ``candidates`` holds (task_id, family, answer).  Candidates count only for
    tasks in a local lane.  Columns: task_id, lane, answer, source, is_fallback.
    """
    routed = R.route(tasks, predictions, remote=True)
    local = routed.where(F.col("lane") != "remote").select("task_id", "prompt").join(candidates, "task_id")
    judged = R.last_answers(gate(local, families=families), __local=F.col("accepted"), __rejected=~F.col("accepted"))
    found = (routed.select("task_id", "lane").join(judged, "task_id", "left")
             .join(R.last_answers(remote, __remote=F.lit(True)), "task_id", "left"))
    return R.choose_answer(found, ["task_id", "lane"], [(n, F.col(f"__{n}")) for n in ("remote", "local", "rejected")])


def evaluate(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Score results against golden cases and report by category."""
    return S.score_report(S.score_golden(golden, results))

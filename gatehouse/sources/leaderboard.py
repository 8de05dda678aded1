"""Leaderboard payloads of any shape as flat entry rows.

A payload is walked level by level as VARIANT: every step opens the objects of one level,
in parallel over all payloads, and hands their track, name and ranking rule down.  The
number of steps is the depth of the deepest payload.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import presence
from ..session import materialise

ENTRY_LISTS = ["entries", "failedEntries", "submissions", "results", "leaderboard"]
"""Fixed values: a list whose path ends in one of these, in any case, holds entries."""

# Accepted field names, first non-empty one wins.
TRACK = ["track", "trackId", "track_id"]
TRACK_NAME = ["name", "trackName", "track_name"]
RANK_BY = ["rankBy", "rank_by"]
SUBMISSION = ["submission", "project", "entry", "teamSubmission"]
USER = ["user", "owner"]
NAME = ["name", "title", "submissionName", "submission_name", "projectName", "project_name"]
PERSON = ["name", "username", "displayName", "display_name"]
SCORE = ["score", "finalScore", "final_score", "totalScore", "total_score", "tokens", "totalTokens", "total_tokens"]
SUBMISSION_SCORE = ["score", "finalScore", "final_score", "totalTokens", "total_tokens"]
SCORE_LABEL = ["scoreLabel", "score_label"]
TOKENS = ["tokens", "totalTokens", "total_tokens", "token_count", "tokenCount"]
SUBMISSION_TOKENS = ["tokens", "totalTokens", "total_tokens"]
ACCURACY = ["accuracy", "accuracyScore", "accuracy_score"]
RANK = ["rank", "position", "place"]
STATUS = ["status", "resultStatus", "result_status", "failureReason", "failure_reason"]
CREATED = ["createdAt", "created_at", "submittedAt", "submitted_at", "updatedAt", "updated_at"]
ENTRY_ID = ["id", "_id", "submissionId", "submission_id"]
UNTITLED = "Untitled submission"


def _pick(node: Column, names: Sequence[str]) -> Column:
    """First of the fields of a JSON text that is there and not empty."""
    return F.coalesce(*(presence(F.get_json_object(node, f"$.{n}")) for n in names))


def _number(value: Column, kind: str = "double") -> Column:
    return value.try_cast("double").cast(kind)


def _variant(node: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*(presence(F.try_variant_get(node, f"$.{n}", "string")) for n in names))


def _opened(level: DataFrame) -> DataFrame:
    """One row per member of each object (or element of a list), with the path to it and its kind."""
    members = level.sparkSession.sql("SELECT l.*, e.key AS member, e.value AS value FROM {level} AS l, LATERAL variant_explode(l.node) AS e", level=level)
    text = F.to_json("value")
    return members.withColumn("path", F.concat_ws(".", F.nullif("path", F.lit("")), "member")).withColumn(
        "kind", F.when(text.startswith("{"), "object").when(text.startswith("["), "list")).where("kind IS NOT NULL").drop("node", "member").withColumnRenamed("value", "node")


def _inherited(objects: DataFrame) -> DataFrame:
    """Objects with their own context where they state one, else what they inherit."""
    for column, names in (("track", TRACK), ("track_name", TRACK_NAME), ("rank_by", RANK_BY)):
        objects = objects.withColumn(column, F.coalesce(_variant(F.col("node"), names), F.col(column)))
    return objects


def lists(payloads: DataFrame, payload: str) -> DataFrame:
    """Every list in the payloads: row, path, context, node, and ``named`` and ``inner`` (inside of another list)."""
    text, nothing = F.to_json("node"), F.lit(None).cast("string")
    roots = payloads.select("__row", F.try_parse_json(F.col(payload)).alias("node")).where("node IS NOT NULL").select(
        "__row", F.lit("").alias("path"), nothing.alias("track"), nothing.alias("track_name"), nothing.alias("rank_by"), F.lit(False).alias("inner"),
        "node", F.when(text.startswith("{"), "object").when(text.startswith("["), "list").alias("kind"))
    level, found = materialise(roots.where("kind IS NOT NULL")), None
    named = F.lower("path").rlike("(" + "|".join(n.lower() for n in ENTRY_LISTS) + ")$")
    while not level.isEmpty():
        here = level.where("kind = 'list'").withColumn("named", named).drop("kind")
        found = here if found is None else found.unionByName(here)
        # A list of entries is not searched for others; the objects of any other list are.
        below = _opened(_inherited(level.where("kind = 'object'")).drop("kind")).unionByName(
            _opened(level.where((F.col("kind") == "list") & ~named).drop("kind")).where("kind = 'object'").withColumn("inner", F.lit(True)))
        level = materialise(below)
    return found if found is not None else level.withColumn("named", named).drop("kind")


def flatten_leaderboard(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Entries of JSON payloads, flattened by alias, with the context they inherit.

    Entry lists are found at any depth by the end of their path.  A payload without one
    yields the objects of all its lists instead, those inside of lists left out.  A payload
    that is no JSON yields nothing.
    """
    keep = [c for c in payloads.columns if c != payload]
    rows = materialise(payloads.withColumn("__row", F.monotonically_increasing_id()))
    objects = F.filter(F.col("node").cast("array<variant>"), lambda v: F.to_json(v).startswith("{"))
    every = materialise(lists(rows, payload).withColumn("items", F.transform(objects, lambda v: F.to_json(v))).drop("node").where(F.size("items") > 0))
    chosen = every.where("named").unionByName(every.where("NOT named AND NOT inner").join(every.where("named").select("__row").distinct(), "__row", "left_anti"))
    entries = chosen.select("__row", F.col("path").alias("source_path"), "track", "track_name", "rank_by", F.posexplode("items").alias("index", "entry"))

    item = F.col("entry")
    submission = F.coalesce(*(F.get_json_object(item, f"$.{n}") for n in SUBMISSION), item)
    entries = entries.withColumn("submission", submission)
    submission = F.col("submission")
    team = F.coalesce(F.get_json_object(item, "$.team"), F.get_json_object(submission, "$.team"))
    user = F.coalesce(*(F.get_json_object(item, f"$.{n}") for n in USER), F.get_json_object(submission, "$.user"))
    label = F.coalesce(_pick(item, SCORE_LABEL), _pick(submission, SCORE_LABEL))
    labelled = F.when(label.rlike("(?i)token"), _number(F.regexp_replace(label, r"[^0-9.]", "")))
    fields = {
        "id": F.coalesce(_pick(item, ENTRY_ID), _pick(submission, ["id", "_id"]), F.concat("source_path", F.lit("-"), "index")),
        "rank": _number(_pick(item, RANK), "bigint"),
        "name": F.coalesce(_pick(submission, NAME), _pick(item, NAME), F.lit(UNTITLED)),
        "team": F.coalesce(_pick(team, ["name", "title"]), _pick(item, ["teamName", "team_name", "team"]), _pick(submission, ["teamName", "team_name"])),
        "user": F.coalesce(_pick(user, PERSON), _pick(item, ["username", "userName", "user_name"])),
        "score": F.coalesce(_number(_pick(item, SCORE)), _number(_pick(submission, SUBMISSION_SCORE))),
        "score_label": label,
        "tokens": F.coalesce(_number(_pick(item, TOKENS)), labelled, _number(_pick(submission, SUBMISSION_TOKENS))).cast("bigint"),
        "accuracy": F.coalesce(_number(_pick(item, ACCURACY)), _number(_pick(submission, ACCURACY))),
        "status": F.coalesce(_pick(item, STATUS), _pick(submission, ["status"])),
        "created_at": F.coalesce(_pick(item, CREATED), _pick(submission, CREATED)),
    }
    flat = entries.select("__row", "source_path", "track", "track_name", "rank_by", *(v.alias(n) for n, v in fields.items()))
    return rows.drop(payload).join(flat, "__row").select(*keep, *(c for c in flat.columns if c != "__row"))

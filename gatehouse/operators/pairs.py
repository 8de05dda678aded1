"""Preference pairs from verdict archives and sampled draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.core import lookup, presence, trim_space
from ..functions.text import sentiment_label
from ..session import broadcast_if_small, materialise
from .ordering import first_rows, md5_bucket, position, running_sum


def distinct_answers(archive: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Distinct answers per task and verdict, with the place each was first seen.

    ``archive`` holds (task_id, family, answer, pass, file, pos).
    """
    clean = archive.withColumn("answer", presence(F.col("answer"))).where(F.col("answer").isNotNull())
    if max_chars is not None:
        clean = clean.where(F.length("answer") <= max_chars)
    return clean.groupBy("task_id", "pass", "answer").agg(
        F.min(F.struct("file", "pos")).alias("seen"), F.min("family").alias("family"),
        F.count(F.lit(1)).alias("copies"),
    ).select("task_id", "pass", "answer", "family", "copies",
             F.col("seen.file").alias("first_file"), F.col("seen.pos").alias("first_pos"))


TILE = 1024
"""Answers of either side that meet in one piece of a task's product."""

TILE_BYTES = 15 << 16
"""Bytes of either side's answers in a piece of a hot task: fewer than a column's dictionary holds in a Parquet file."""

HOT = 4096
"""A task with so many pairs is hot: each of its answers is in dozens of rows."""

PIECES = 1 << 16
"""Most partitions that pieces are dealt to."""


def _sized(answers: DataFrame) -> DataFrame:
    """(task_id, n_pass, n_fail) of the tasks with answers on both sides."""
    counts = answers.groupBy("task_id").agg(F.count_if(F.col("pass")).alias("n_pass"), F.count_if(~F.col("pass")).alias("n_fail"))
    return counts.where((F.col("n_pass") > 0) & (F.col("n_fail") > 0))


def _in_pieces(clean: DataFrame, answers: DataFrame, sizes: DataFrame, first_round: int) -> DataFrame:
    """(task_id, family, round, lead, lead_passes, other): all pairs of the tasks in ``sizes``, each piece of a product in a partition of its own.

    A piece has at most ``TILE`` and about ``TILE_BYTES`` of either side, so that what is written
    of it holds each answer once, as an entry of a dictionary, however many pairs it is in.
    Places are found without texts; an answer travels twice for each piece that it is in.
    """
    bucket, keys = md5_bucket(F.col("digest")), ["task_id", "pass"]
    mine = answers.join(sizes, "task_id")
    placed = running_sum(position(mine, keys, ["digest", "family"], bucket), keys, ["digest", "family"], bucket, F.col("bytes"), "before", inclusive=False)
    # Neither part falls along the order, so their sum tells any two of them apart.
    tile = F.floor((F.col("pos") - 1) / TILE) + F.floor(F.col("before") / TILE_BYTES)
    placed = broadcast_if_small(placed.select(
        "task_id", "pass", "family", "digest", (F.col("pass") == (F.col("n_pass") >= F.col("n_fail"))).alias("leads"), tile.alias("tile"),
        (F.col("pos") - 1).alias("i"), F.least("n_pass", "n_fail").alias("m")))
    tiles = placed.select("task_id", "leads", "tile").distinct()
    pieces = tiles.where("leads").select("task_id", F.col("tile").alias("lead_tile")).join(tiles.where("NOT leads").select("task_id", F.col("tile").alias("other_tile")), "task_id")
    named = pieces.withColumn("name", F.md5(F.encode(F.concat_ws("|", "lead_tile", "other_tile", "task_id"), "UTF-8")))
    numbered = materialise(position(named, [], ["name"], md5_bucket(F.col("name")), "piece"))
    n_pieces = numbered.count()
    ends = broadcast_if_small(numbered.select("task_id", F.lit(True).alias("leads"), F.col("lead_tile").alias("tile"), "piece").unionByName(
        numbered.select("task_id", F.lit(False).alias("leads"), F.col("other_tile").alias("tile"), "piece")))
    place = placed.select("task_id", "pass", "digest", F.col("family").alias("placed_family"), "leads", "tile", "i", "m")
    given = clean.join(place, ["task_id", "pass", "digest"]).where(F.col("family").eqNullSafe(F.col("placed_family"))).join(ends, ["task_id", "leads", "tile"])
    # Equal rows are one in a set; a row of the other side is NULL, which a set leaves out.
    answer = F.struct("i", "family", "pass", "answer")
    sides = given.groupBy("piece", "task_id", "m").agg(F.collect_set(F.when(F.col("leads"), answer)).alias("a"), F.collect_set(F.when(~F.col("leads"), answer)).alias("b"))
    laid = sides.repartitionById(max(min(n_pieces, PIECES), 1), F.pmod(F.col("piece"), F.lit(max(min(n_pieces, PIECES), 1))).cast("int"))
    return laid.select("task_id", "m", "b", F.explode("a").alias("a")).select("task_id", "m", "a", F.explode("b").alias("b")).select(
        "task_id", F.col("a.family").alias("family"), F.pmod(F.col("b.i") - F.col("a.i"), F.col("m")).alias("round"), F.col("a.answer").alias("lead"),
        F.col("a.pass").alias("lead_passes"), F.col("b.answer").alias("other")).where(F.col("round") >= first_round)


def preference_pairs(archive: DataFrame, max_chars: int | None = None, rounds: int | None = None,
                     first_round: int = 0) -> DataFrame:
    """Chosen/rejected pairs of one task: all, or ``rounds`` diagonals at a time.

    All pairs of a task are its passing answers times its failing ones, which a
    hot task makes unpayable.  The product is cut into diagonals: in round ``d``
    row ``i`` of the longer side meets row ``(i + d) mod m`` of the shorter side
    of size ``m``.  One round uses every answer and is linear in the input; the
    rounds 0 … m-1 together give each pair exactly once, so further pages lose
    nothing.  The join key (task, position) is unique, hence never skewed.
    Without ``rounds`` the product is made in tiles of ``TILE`` answers of each side,
    so that an answer travels once for each tile that it meets and not once for each
    answer; the round of a pair follows from its positions.  The tiles of hot tasks
    are bounded in bytes too and are laid out one by one (:func:`_in_pieces`).
    ``max_chars`` leaves longer answers out; by default none are.  An answer under
    two families counts for each.
    """
    text = trim_space(F.col("answer"))
    clean = archive.select("task_id", "pass", text.alias("answer"), "family").where(
        (F.length("answer") >= 1) & (F.lit(True) if max_chars is None else F.length("answer") <= max_chars)).withColumn("digest", F.md5(F.encode("answer", "UTF-8")))
    laid, counts = None, None
    if rounds is None:
        known = materialise(clean.select("task_id", "pass", "family", "digest", F.octet_length("answer").cast("bigint").alias("bytes")).distinct())
        counts = broadcast_if_small(_sized(known))
        hot = F.col("n_pass") * F.col("n_fail") >= HOT
        if not counts.where(hot).isEmpty():
            laid = _in_pieces(clean, known, counts.where(hot), first_round)
            counts = broadcast_if_small(counts.where(~hot))
            if counts.isEmpty():
                return _chosen(laid)
            clean = clean.join(counts.select("task_id"), "task_id", "left_semi")
    answers = materialise(clean.distinct())
    placed = position(answers, ["task_id", "pass"], ["digest", "family"], md5_bucket(F.col("digest")))
    # One row per task: broadcast while small, so that a hot task's answers stay where they are.
    sized = placed.join(broadcast_if_small(_sized(answers)) if counts is None else counts, "task_id")
    shorter = F.least("n_pass", "n_fail")
    longer_side = F.col("pass") == (F.col("n_pass") >= F.col("n_fail"))
    leads = sized.where(longer_side).select(
        "task_id", "family", F.col("answer").alias("lead"), F.col("pass").alias("lead_passes"), (F.col("pos") - 1).alias("i"), shorter.alias("m"), F.greatest("n_pass", "n_fail").alias("n"))
    partners = sized.where(~longer_side).select(
        "task_id", F.col("answer").alias("other"), (F.col("pos") - 1).alias("partner"), F.greatest("n_pass", "n_fail").alias("n"))
    if rounds is None:
        across = leads.withColumn("lead_tile", F.floor(F.col("i") / TILE)).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / TILE)))).drop("n")
        down = partners.withColumn("tile", F.floor(F.col("partner") / TILE)).withColumn("lead_tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / TILE)))).drop("n")
        met = across.join(down, ["task_id", "lead_tile", "tile"]).withColumn("round", F.pmod(F.col("partner") - F.col("i"), F.col("m"))).where(F.col("round") >= first_round)
    else:
        last = F.least(F.lit(first_round + rounds), F.col("m")) - 1
        turns = F.when(last >= first_round, F.sequence(F.lit(first_round).cast("bigint"), last))
        turned = leads.drop("n").withColumn("round", F.explode(turns)).withColumn("partner", F.pmod(F.col("i") + F.col("round"), F.col("m")))
        met = turned.join(partners.drop("n"), ["task_id", "partner"])
    met = met.select("task_id", "family", "round", "lead", "lead_passes", "other")
    return _chosen(met if laid is None else met.unionByName(laid))


def _chosen(met: DataFrame) -> DataFrame:
    return met.where(F.col("lead") != F.col("other")).select(
        "task_id", "family", "round",
        F.when(F.col("lead_passes"), F.col("lead")).otherwise(F.col("other")).alias("chosen"),
        F.when(F.col("lead_passes"), F.col("other")).otherwise(F.col("lead")).alias("rejected"))


def with_system_prompt(pairs: DataFrame, family: str = "family") -> DataFrame:
    return pairs.withColumn("system", lookup(F.col(family), V.FAMILY_SYSTEM_PROMPTS))


def _judged(draws: DataFrame, gold: DataFrame) -> DataFrame:
    verdict = sentiment_label(F.col("answer"), lenient=True)
    return draws.withColumn("verdict", verdict).join(gold, "prompt_id").withColumn(
        "right", F.coalesce(F.col("verdict") == F.col("label"), F.lit(False)))


def draw_outcomes(draws: DataFrame, gold: DataFrame) -> DataFrame:
    """Per prompt: always_right, never_right or split.

    A prompt without a readable wrong draw counts as always right.
    """
    wrong = F.col("verdict").isNotNull() & ~F.col("right")
    per_prompt = _judged(draws, gold).groupBy("prompt_id").agg(
        F.bool_or("right").alias("any_right"), F.bool_or(wrong).alias("any_wrong"),
        F.count(F.lit(1)).alias("draws"))
    bucket = (F.when(~F.col("any_wrong"), "always_right").when(F.col("any_right"), "split")
              .otherwise("never_right"))
    return per_prompt.select("prompt_id", "draws", bucket.alias("bucket"))


def draw_outcome_buckets(draws: DataFrame, gold: DataFrame) -> DataFrame:
    return draw_outcomes(draws, gold).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("prompts"), F.sum("draws").alias("draws"))


def on_policy_pairs(draws: DataFrame, gold: DataFrame, max_rejected: int | None = None) -> DataFrame:
    """Shortest right draw (else the authored answer) against the first wrong draws.

    ``draws`` holds (prompt_id, pos, answer); ``gold`` (prompt_id, label, authored).
    """
    judged = _judged(draws, gold)
    chosen = judged.where("right").groupBy("prompt_id").agg(
        F.min_by("answer", F.struct(F.length("answer"), F.col("pos"))).alias("best"))
    wrong = judged.where(F.col("verdict").isNotNull() & ~F.col("right")).groupBy("prompt_id", "answer").agg(
        F.min("pos").alias("pos"), F.min("authored").alias("authored"))
    rejected = wrong if max_rejected is None else first_rows(wrong, ["prompt_id"], ["pos"], max_rejected)
    return rejected.join(chosen, "prompt_id", "left").select(
        "prompt_id", F.coalesce("best", "authored").alias("chosen"), F.col("answer").alias("rejected"),
        F.when(F.col("best").isNull(), "never_right").otherwise("split").alias("bucket"))


def prompt_digest(prompt: Column) -> Column:
    return F.sha2(F.encode(prompt, "UTF-8"), 256)

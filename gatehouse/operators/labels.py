"""Learned labels: a multi-label text classifier as Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_modulus
from ..functions.text import fields, head_tail_tokens
from ..session import materialise

def truncated(text: Column, limit: int | None = None, head: int = 128) -> Column:
    """The lower-cased words of a text; with ``limit``, only so many of its head and tail."""
    words = fields(F.lower(text))
    return F.array_join(words if limit is None else head_tail_tokens(words, limit, head), " ")


class Labeller:
    """One sigmoid per label over shared hashed features."""

    def __init__(self, features: PipelineModel, heads: Mapping[str, object], thresholds: Mapping[str, float]):
        self.features, self.heads, self.thresholds = features, dict(heads), dict(thresholds)

    def score_labels(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Add ``scores``: ARRAY<STRUCT<label, score>>, in label order."""
        return self.score_features(self.features.transform(rows.withColumn("__text", truncated(F.col(text)))), rows.columns)

    def score_features(self, out: DataFrame, columns: Sequence[str]) -> DataFrame:
        """``columns`` and ``scores`` of rows that have their features already."""
        for label, model in self.heads.items():
            model = model.copy()
            out = model.transform(out).withColumn(
                f"__p_{label}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        scores = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"__p_{n}").alias("score")) for n in self.heads])
        return out.select(*columns, scores.alias("scores"))


BINS = 1000
"""Thresholds that are told apart."""


def score_histograms(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, bin, n, positives): scores of all labels counted in one pass over ``scored`` (label columns and ``scores``)."""
    truth = F.create_map(*(x for n in labels for x in (F.lit(n), F.col(n))))
    each = scored.select(F.explode("scores").alias("s"), truth.alias("t")).select(
        F.col("s.label").alias("label"), F.least(F.floor(F.col("s.score") * BINS), F.lit(BINS - 1)).alias("bin"), F.col("t")[F.col("s.label")].alias("y"))
    return each.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("positives"))


def best_thresholds(histograms: DataFrame) -> DataFrame:
    """(label, threshold, f1): the lower end of the bin from which on F1 is greatest; of equal ones the highest."""
    above = Window.partitionBy("label").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("label")
    sums = histograms.select("label", "bin", F.sum("n").over(above).alias("named"), F.sum("positives").over(above).alias("tp"), F.sum("positives").over(every).alias("all"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("named") + F.col("all")), F.lit(0.0))
    best = sums.groupBy("label").agg(F.max(F.struct(f1.alias("f1"), "bin")).alias("b"))
    return best.select("label", (F.col("b.bin") / BINS).alias("threshold"), "b.f1")


def calibration(scored: DataFrame, labels: Sequence[str], parts: int = 10) -> DataFrame:
    """(label, part, n, positives, stated): per tenth of the score range how many rows are labelled, and how many the scores state."""
    truth = F.create_map(*(x for n in labels for x in (F.lit(n), F.col(n))))
    each = scored.select(F.explode("scores").alias("s"), truth.alias("t"))
    part = F.least(F.floor(F.col("s.score") * parts), F.lit(parts - 1))
    return each.groupBy(F.col("s.label").alias("label"), part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("t")[F.col("s.label")] == 1).alias("positives"), F.sum("s.score").alias("stated"))


def fit_labeller(rows: DataFrame, labels: Sequence[str], text: str = "text", buckets: int = 1 << 16, validation: int = 5) -> Labeller:
    """Fit on training rows whose ``labels`` columns are 0/1.

    One text in ``validation``, by its digest, is kept from the fit; thresholds are those of
    the best F1 on these, from one histogram pass for all labels.  Report quality on rows
    held out by :func:`gatehouse.operators.decontam.hash_split` only.
    """
    marked = rows.select(F.col(text).alias("__whole"), *labels).withColumn("__valid", F.coalesce(md5_modulus(F.col("__whole"), validation) == 0, F.lit(False)))
    counting = Pipeline(stages=[
        RegexTokenizer(inputCol="__text", outputCol="__words", pattern="[^a-z0-9]+", toLowercase=True),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=buckets),
    ]).fit(marked)  # learns nothing
    # Texts are read and counted once; every fit and the thresholds read the counts.
    counted = materialise(counting.transform(marked.withColumn("__text", truncated(F.col("__whole")))).select(*labels, "__valid", "__tf"))
    base = counted.where("NOT __valid")
    weights = IDF(inputCol="__tf", outputCol="__features").fit(base)
    prepared = weights.transform(base)
    # One fit per label: the label set is fixed and small.
    heads = {label: LogisticRegression(featuresCol="__features", labelCol=label, maxIter=20, regParam=0.01).fit(prepared) for label in labels}
    untuned = Labeller(PipelineModel([*counting.stages, weights]), heads, dict.fromkeys(labels, 0.5))
    scored = untuned.score_features(weights.transform(counted.where("__valid")), labels)
    found = best_thresholds(score_histograms(scored, labels)).collect()  # one row per label
    return Labeller(untuned.features, heads, untuned.thresholds | {r.label: r.threshold for r in found})

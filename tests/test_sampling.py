"""Selections of any size, slot banks and thresholds."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gatehouse.operators import labels, ordering, sampling


def test_first_by_digest_equals_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["cold", None]), rng.randrange(3), hashlib.md5(str(rng.randrange(4000)).encode()).hexdigest(), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k STRING, p INT, d STRING, i INT").repartition(5)
    for need in (1, 700, 4200, 10_000):
        got = sorted(map(str, ordering.first_by_digest(df, ["k"], F.lit(need), "d", ["i"], ["p"], edge=2).collect()))
        want = []
        for k in ("hot", "cold", None):
            want += sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2], r[3]))[:need]
        assert len(got) == len(want)
        assert {r[3] for r in want} == {int(g.split("i=")[1].rstrip(")")) for g in got}


def test_first_by_digest_with_one_digest(spark):
    df = spark.range(500).select(F.lit("a").alias("k"), F.lit("0" * 32).alias("d"), "id")
    got = ordering.first_by_digest(df, ["k"], F.lit(20), "d", ["id"], edge=8)
    assert sorted(r.id for r in got.collect()) == list(range(20))
    assert ordering.first_by_digest(df, ["k"], F.lit(None).cast("int"), "d").count() == 0
    assert ordering.first_by_digest(df.limit(0), ["k"], F.lit(3), "d").count() == 0


def test_cap_per_family_keeps_one_row_per_prompt(spark):
    rows = [("f", "p", 1, "first"), ("f", "p", 0, "second"), ("f", "q", 1, "third"), (None, "p", 1, "fourth"), ("f", None, 1, "fifth"), ("f", "r", 2, "sixth")]
    df = spark.createDataFrame(rows, "family STRING, prompt STRING, rank INT, answer STRING")
    got = sampling.cap_per_family(df, 3, F.col("rank"))
    assert got.columns == df.columns
    assert sorted(r.answer for r in got.collect()) == ["fifth", "fourth", "second", "third"]


def test_banks_fill_without_repeats(spark):
    banks = {"a": spark.createDataFrame([(f"a{i}",) for i in range(7)] + [("a0",), (None,)], "v STRING"), "b": spark.createDataFrame([(f"b{i}",) for i in range(5)], "v STRING")}
    templates = ["{a} and {b}", "{b} or {a}", "{a}{b}"]
    every = [r.prompt for r in sampling.expand_banks(105, templates, banks, seed=3).collect()]
    assert len(set(every)) == 105
    some = {r.n: r.prompt for r in sampling.expand_banks(20, templates, banks, seed=3).collect()}
    assert sorted(some) == list(range(20)) and len(set(some.values())) == 20
    assert some != {r.n: r.prompt for r in sampling.expand_banks(20, templates, banks, seed=4).collect()}
    with pytest.raises(ValueError):
        sampling.expand_banks(106, templates, banks)


def test_permutations_are_complete():
    for total in (1, 2, 3, 10, 97, 360):
        for seed in (0, 1, 50, 1000):
            factor, offset = sampling.permutation(total, seed)
            assert {(factor * i + offset) % total for i in range(total)} == set(range(total))


def test_thresholds_are_the_best_ones(spark):
    rng = random.Random(2)
    rows = [(i, int(rng.random() < 0.3), rng.random()) for i in range(400)]
    scored = spark.createDataFrame([(y, [("x", min(0.999, s * 0.5 + 0.4 * y))]) for _, y, s in rows], "x INT, scores ARRAY<STRUCT<label: STRING, score: DOUBLE>>")
    got = labels.best_thresholds(labels.score_histograms(scored, ["x"])).first()
    points = [(y, min(0.999, s * 0.5 + 0.4 * y)) for _, y, s in rows]

    def f1(t):
        tp = sum(y for y, s in points if s >= t)
        return 2 * tp / (sum(s >= t for _, s in points) + sum(y for y, _ in points))

    assert abs(f1(got.threshold) - got.f1) < 1e-9 and got.f1 == pytest.approx(max(f1(t / 1000) for t in range(1000)))
    parts = labels.calibration(scored, ["x"]).collect()
    assert sum(r.n for r in parts) == 400 and sum(r.positives for r in parts) == sum(y for y, _ in points)


def test_a_fit_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    n = 60
    rows = spark.range(n).select(
        F.concat(F.when(F.col("id") % 2 == 0, "good ").otherwise("bad "), F.col("id").cast("string")).alias("text"), (F.col("id") % 2).cast("int").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    model = labels.fit_labeller(rows.withColumn("text", seen.asNondeterministic()("text")), ["x", "y"])
    assert read.value == n
    scores = {r.text: r.scores[0].score for r in model.score_labels(rows).collect()}
    assert len(scores) == n and all((s > 0.5) == t.startswith("bad") for t, s in scores.items())

"""Groups of near copies and splits that keep them whole."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gatehouse.operators import decontam, near


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(120):
        base = rng.choices(words, k=rng.randrange(60, 400))
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(len(base) // 100):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows) + i, t) for i, t in enumerate([None, "", "two words", "two words", "Two, words!", "!!"])]


def runs(text):
    import re
    w = re.findall("[a-z0-9]+", text.lower()) if text else []
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def leaks(rows, side):
    sets = [(i, runs(t), side[i]) for i, t in rows]
    best = {}
    for i, a, sa in sets:
        for j, b, sb in sets:
            if sa == "heldout" and sb == "train" and a and b and 100 * len(a & b) >= 80 * len(a | b):
                text = dict(rows)
                key = (text[i], text[j])
                best[key] = min(best.get(key, (i, j, 0, 0))[:2], (i, j)) + (len(a & b), len(a | b))
    return set(best.values())


def test_leaks_equal_brute_force_and_cluster_split_has_none(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4).withColumn("__digest", F.lit("own"))
    plain = decontam.hash_split(docs)
    want = leaks(rows, {r.doc_id: r.split for r in plain.collect()})
    got = {tuple(r) for r in near.split_leaks(plain).collect()}
    assert got == want and want
    whole = near.cluster_split(docs)
    assert whole.columns == [*docs.columns, "split"] and whole.count() == docs.count()
    side = {r.doc_id: r.split for r in whole.collect()}
    assert not leaks(rows, side) and near.split_leaks(whole).isEmpty()
    assert set(side.values()) == {"heldout", "train"}
    # A text without near copies keeps the side that it had.
    grouped = {r.digest for r in near.near_groups(docs).collect()}
    alone = docs.withColumn("d", near.digest_of(F.col("text"))).where(~F.coalesce(F.col("d").isin(list(grouped)), F.lit(False)))
    own = {r.doc_id: r.split for r in decontam.hash_split(alone).collect()}
    assert own and all(side[i] == s for i, s in own.items())


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(900, 960)] + [(5, 5), (2000, 2001)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(chain, "a INT, b INT")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 900 for i in [*range(900, 960), 1000]}, 2000: 2000, 2001: 2000}


def test_splits_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert near.cluster_split(none).count() == 0 and near.split_leaks(decontam.hash_split(none)).count() == 0


def test_ids_without_pairs(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "one two three four five six seven eight")], "item_id INT, text STRING")
    docs = spark.createDataFrame([(1, "x a b c d e f g h"), (2, "a b c d e f g x"), (3, "one two three four five six seven eight a b c d e f g h i"), (4, None)], "doc_id INT, text STRING")
    assert sorted(r.doc_id for r in decontam.contaminated_ids(docs, bench).collect()) == [1, 3]
    assert sorted(r.doc_id for r in decontam.contaminated_ids(docs, bench, min_shared=2).collect()) == [3]


def test_leaks_where_many_texts_share_a_line(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    line = " ".join(rng.choices(words, k=40))
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(5, 80))) + " " + line) for i in range(150)]
    rows += [(200 + i, t + " more") for i, (_, t) in enumerate(rows[:60])] + [(300 + i, line + " " + " ".join(rng.choices(words, k=2))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    plain = decontam.hash_split(docs)
    want = leaks(rows, {r.doc_id: r.split for r in plain.collect()})
    seen = {}
    for spare in (64, 0):
        monkeypatch.setattr(near, "FREQUENT", 20)
        monkeypatch.setattr(near, "SPARE", spare)
        got = [tuple(r) for r in near.split_leaks(plain).collect()]
        assert len(got) == len(want) and set(got) == want and want
        texts = near._one_of_equal(plain, "doc_id", "text")
        heads = near._heads(near._rarest_first(texts, 80))
        seen[spare] = sorted(heads.select("id", "pos", "run").collect())
        # The runs of the line are not what texts with other runs meet on.
        long = heads.where("n > 80").groupBy("run").count().agg(F.max("count")).first()[0]
        assert long <= 20
    assert seen[64] == seen[0]


def test_leaks_of_rows_that_are_there_twice(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(1, "heldout", base), (1, "heldout", base), (2, "train", base + " x"), (2, "train", base + " x"), (None, "train", base)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, split STRING, text STRING")
    assert [tuple(r) for r in near.split_leaks(docs).collect()] == [(1, 2, 46, 47)]


def test_a_large_group_leaves_a_seventh_held_out(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=120)
    for part in (0.05, 0.3):
        rows = [(i, " ".join(rng.choices(words, k=30))) for i in range(4000)]
        for i in range(int(4000 * part)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            rows[i] = (i, " ".join(copy))
        docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
        side = {r.doc_id: r.split for r in near.cluster_split(docs).collect()}
        assert len(side) == 4000 and len({side[i] for i in range(int(4000 * part))}) == 1
        assert abs(sum(s == "heldout" for s in side.values()) / 4000 - 1 / 7) <= 0.01 + 3 * (6 / 49 / 4000) ** 0.5


def test_words_are_split_once_and_sketches_are_those_of_each_set(spark):
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate([None, "", "!!", "two words", "a b c d e", "a a a a a a a"] + [" ".join(rng.choices("abcdefgh", k=k)) for k in (6, 40, 900)])]
    docs = spark.createDataFrame(rows, "doc_id INT, text STRING")
    hashed = docs.select("doc_id", near.word_runs(F.col("text")).alias("runs"))
    assert hashed._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    plain = docs.selectExpr("doc_id", "array_remove(split(lower(text), '[^a-z0-9]+'), '') AS w").selectExpr(
        "doc_id", "CASE WHEN size(w) >= 5 THEN array_distinct(transform(sequence(1, size(w) - 4), i -> xxhash64(slice(w, i, 5)))) WHEN size(w) > 0 THEN array(xxhash64(w)) ELSE array() END AS runs")
    sets = {r.doc_id: r.runs for r in hashed.collect()}
    assert sets == {r.doc_id: r.runs for r in plain.collect()} and [len(sets[i]) for i in range(6)] == [0, 0, 0, 1, 1, 1]
    # All sets of a batch at once, an empty one among them.
    together = [np.array(sets[i], np.int64) for i in (6, 7, 8, 3)]
    ends = np.cumsum([0, *map(len, together)])
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in sets]), pa.array([sets[i] for i in sets], pa.list_(pa.int64()))], ["digest", "runs"])
    found = {k: v for b in near._sketch([batch.slice(1)]) for k, v in zip(b[0].to_pylist(), b[1].to_pylist())}
    assert sorted(found) == [str(i) for i in range(3, 9)]
    for i, s, alone in zip((6, 7, 8, 3), near._signatures(np.concatenate(together), ends), together):
        cells = [min((v for v in (int(h) % 2**64 * 0x9E3779B97F4A7C15 % 2**64 for h in alone) if (v ^ v >> 32) % 200 == c), key=lambda v: v ^ v >> 32, default=None) for c in range(200)]
        cells = [None if v is None else v ^ v >> 32 for v in cells]
        full = [next(cells[(c + k) % 200] for k in range(200) if cells[(c + k) % 200] is not None) for c in range(200)]
        want = []
        for b in range(40):
            out = b + 1
            for v in full[5 * b:5 * b + 5]:
                out = (out ^ v) * 0xD6E8FEB86659FD93 % 2**64
                out ^= out >> 29
            want.append(out - 2**64 if out >= 2**63 else out)
        assert s.tolist() == want == found[str(i)]


def test_pairs_that_share_too_few_of_the_first_runs_are_not_compared(spark, monkeypatch):
    """Texts that have three tenths in common share runs, but their whole sets are not made again."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(60):
        base = rng.choices(words, k=300)
        rows += [(2 * i, "heldout", " ".join(base)), (2 * i + 1, "train", " ".join(base[:90] + rng.choices(words, k=210)))]
    rows += [(1000, "heldout", " ".join(base + ["x"])), (1001, "train", " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, split STRING, text STRING")
    stored = []
    monkeypatch.setattr(near, "materialise", lambda df, f=near.materialise: stored.append(f(df)) or stored[-1])
    want = leaks([(i, t) for i, _, t in rows], {i: s for i, s, _ in rows})
    assert {tuple(r) for r in near.split_leaks(docs).collect()} == want and {r[:2] for r in want} == {(1000, 1001), (118, 1001)}
    candidates = [s for s in stored if s.columns == ["heldout", "train"]]
    assert len(candidates) == 1 and candidates[0].count() <= 12

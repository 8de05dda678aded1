"""The pipeline's stages on a small corpus."""

from pyspark.sql import functions as F

import corpus_pipeline
from gatehouse.llm import packing, signature_tree, toxicity

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).filter("predicted = 1").collect()}
    assert bad and {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad
    cut = corpus_pipeline.drop_repeated_lines(spark, clean, SF)
    assert cut.filter(F.length("text") != F.col("n_chars")).count() == 0
    kept = corpus_pipeline.keep_one_of_each_group(spark, cut, SF)
    groups = signature_tree.link_components(cut, 5, 80)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.component_id for r in groups.collect()}
    private = corpus_pipeline.replace_personal_data(spark, kept, SF)
    assert private.count() == kept.count()
    for stage in (clean, cut, kept, private):
        assert stage.columns == docs.columns and stage.dtypes == docs.dtypes


def test_one_row_of_each_group_stays(spark):
    texts = {name: " ".join(f"{name}{i}" for i in range(40)) for name in "abcde"}
    near = {name: t + " more" for name, t in texts.items()}
    rows = [(1, texts["a"]), (5, near["a"]), (5, texts["b"]),  # an id with a near copy of a smaller id and a text of its own
            (2, texts["c"]), (2, texts["c"]), (2, near["c"]), (7, texts["c"]),  # repeated rows of the smallest id
            (None, texts["d"]), (None, near["d"]), (None, near["d"]), (None, near["a"]),  # near copies without an id
            (9, texts["e"]), (9, ""), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("v", F.lit("v"))
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = [(r.doc_id, r.text) for r in kept.collect()]
    blank = [(9, ""), (9, None), (None, "")]
    worded = [r for r in got if r not in blank]
    assert sorted(map(str, [r for r in got if r in blank])) == sorted(map(str, blank))
    assert len(worded) == 5 and {(1, texts["a"]), (5, texts["b"]), (9, texts["e"])} <= set(worded)
    assert len([r for r in worded if r[0] == 2 and r[1] in (texts["c"], near["c"])]) == 1
    assert len([r for r in worded if r[0] is None and r[1] in (texts["d"], near["d"])]) == 1


def test_run_packs_every_document(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert rows and max(used.values()) <= 1024
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "pii", "packing"]


def test_stages_leave_columns_with_helper_names_alone(spark):
    """A table may have columns that are called as the stages' own helpers are."""
    texts = ["one two three four five six\nMrs Clara Smith came, call 555-010-9999 or write a.b@example.org", "one two three four five six\nseven eight nine ten", "plain words of a text that has no copy", None, ""]
    names = ["__text", "__deleted", "__lines", "__id", "__th", "__entities", "__pattern", "__found", "__digest", "__titled", "__at", "__entity", "__new",
             "__v", "__least", "__chosen", "__row", "__bucket", "__rank", "__length", "own__text"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rich = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    stages = (corpus_pipeline.drop_repeated_lines, corpus_pipeline.keep_one_of_each_group, corpus_pipeline.replace_personal_data)
    for stage in stages:
        want = {r.doc_id: r.text for r in stage(spark, docs, SF).collect()}
        got = stage(spark, rich, SF)
        assert got.columns == rich.columns
        for r in got.collect():
            assert r.text == want[r.doc_id] and all(r[n] == f"{n}{r.doc_id}" for n in names)
        assert got.count() == len(want)
    pieces = spark.createDataFrame([(i, 100 + i) for i in range(30)], "__rank int, length int").withColumn("__bucket", F.lit("own"))
    packed = packing.pack(pieces, ["__rank"], 1024)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and sorted(r["__rank"] for r in packed.collect()) == list(range(30))

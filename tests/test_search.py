"""Exact best documents per query against the table of all scores."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gatehouse.operators import retrieval, scan, search

WORDS = ["http-address", "https", "table", "tables", "stable", "query", "sequence", "river", "driver", "stream", "upstream", "node", "nodes", "merge", "emerge", "plan"]


def corpus(spark, n=400):
    rng = random.Random(3)
    rows = [(f"d{i:04d}" if i % 9 else f"path/river-{i}", " ".join(rng.choices(WORDS, k=rng.randrange(0, 25))) + " common", rng.randrange(0, 60)) for i in range(n)]
    rows += [("none", None, 5), ("blank", "", 5)]
    asked = [(q, " ".join(rng.choices(WORDS, k=rng.randrange(1, 6)))) for q in range(12)] + [(50, "common"), (51, "absent-token"), (52, None), (53, "river river table common")]
    return spark.createDataFrame(rows, "doc_id STRING, text STRING, n_chars INT"), spark.createDataFrame(asked, "query_id INT, query STRING")


def ranked(scores, k):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return sorted(map(tuple, scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "doc_id", "score").collect()))


@pytest.mark.parametrize("options", [{}, {"count_repeats": True, "min_score": 2}, {"preferred": ["d0005", "d0010", "none"]}, {"name": "doc_id"}])
def test_top_documents_are_those_of_all_scores(spark, monkeypatch, options):
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "FIRST", 1)
    docs, asked = corpus(spark)
    got = search.top_documents(asked, docs, 5, **options)
    assert sorted(map(tuple, got.select("query_id", "doc_id", "score").collect())) == ranked(retrieval.relevance_join(asked, docs, **options), 5)


def test_a_token_in_every_document_reads_few_blocks(spark, monkeypatch):
    """The token alone names no block as better: only blocks with names small enough for a tie are read."""
    monkeypatch.setattr(search, "BLOCK", 8)
    docs, _ = corpus(spark, 800)
    asked = spark.createDataFrame([(1, "common")], "query_id INT, query STRING")
    read = []
    plain = search.first_rows

    def spy(df, keys, order, k, rank=None):
        out = plain(df, keys, order, k, rank)
        if "bound" in df.columns:
            read.append(out.count())
        return out

    monkeypatch.setattr(search, "first_rows", spy)
    got = [r.doc_id for r in search.top_documents(asked, docs, 5).orderBy("doc_id").collect()]
    assert got == sorted(r.doc_id for r in docs.where("text LIKE '%common'").collect())[:5]
    blocks = 100
    assert 0 < sum(read) < blocks / 2


def test_skip_over_equals_the_greedy_choice(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    docs, asked = corpus(spark)
    got = sorted((r.query_id, r.turn, r.doc_id) for r in search.skip_over(asked, docs, 50, 3).collect())
    size = {r.doc_id: r.n_chars for r in docs.collect()}
    scores = sorted(((r.query_id, -r.score, r.doc_id) for r in retrieval.relevance_join(asked, docs).collect()))
    want = []
    for q in {s[0] for s in scores}:
        room, turn = 50, 0
        for _, _, d in (s for s in scores if s[0] == q):
            if turn < 3 and size[d] <= room:
                room, turn = room - size[d], turn + 1
                want.append((q, turn, d))
    assert got == sorted(want)


def test_rarest_gram_is_the_key(spark):
    words = spark.createDataFrame([(f"https://{i}".replace("/", "-").replace(":", "-"),) for i in range(50)] + [("https-rare",)], "run STRING")
    tokens = spark.createDataFrame([("https-rare",), ("http",), ("httpx",)], "token STRING")
    pieces = words.select("run", F.explode(retrieval.grams(F.col("run"))).alias("gram"))
    keys = {r.token: r.gram for r in retrieval.rarest_grams(tokens, pieces).collect()}
    assert set(keys) == {"https-rare", "http"} and keys["https-rare"] not in ("http", "ttps", "tps-") and keys["http"] == "http"


@pytest.mark.parametrize("rows", [0, 5, 12])
def test_only_seldom_runs_are_shuffled(spark, monkeypatch, rows):
    """A vocabulary beyond the broadcast bound keeps its common runs broadcast; scores stay as they are."""
    docs, asked = corpus(spark)
    want = sorted(map(tuple, retrieval.relevance_join(asked, docs).collect()))
    monkeypatch.setattr(retrieval.session, "BROADCAST_ROWS", rows)
    uses = spark.createDataFrame([(f"often-{i}", 400 + i, [1]) for i in range(4)] + [(f"seldom-{i}", 1 + i % 3, [1]) for i in range(50)], "run STRING, n BIGINT, numbers ARRAY<BIGINT>")
    common, seldom = retrieval.by_use(uses)
    assert {r.run for r in common.collect()} == {f"often-{i}" for i in range(4 if rows else 0)} and seldom.count() == (50 if rows else 54)
    assert sorted(map(tuple, retrieval.relevance_join(asked, docs).collect())) == want


def test_scores_need_no_shuffle_of_token_rows(spark):
    """A document's tokens are one row and its scores are summed where that row lies: one exchange by document."""
    docs, asked = corpus(spark)
    plan = retrieval.relevance_join(asked, docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


def test_boosts_do_not_shuffle_all_scores(spark):
    """The exchange by query and document gets rows of the preferred documents only; documents without a name keep their scores."""
    docs = spark.createDataFrame([(3, "alpha beta"), (4, "alpha"), (None, "beta beta"), (7, "none")], "doc_id INT, text STRING")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id INT, query STRING")
    got = retrieval.relevance_join(asked, docs, preferred=[3, 9])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 3, 7), (1, 4, 1), (1, None, 1), (1, 9, 5), (2, 3, 5), (2, 9, 5)]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("\n")[0].startswith("Union") and plan.count("NOT coalesce(doc_id") >= 1


def test_few_tokens_need_no_vocabulary(spark, monkeypatch):
    """Tokens that one trie holds are looked for in the texts; the scores are those of the vocabulary."""
    docs, asked = corpus(spark, 60)
    odd = spark.createDataFrame([("odd", "TABLE-tableséstable Kernel sequences", 1), ("odd", "upstream", 2), (None, "merge", 3)], docs.schema)
    docs, asked = docs.unionByName(odd), asked.unionByName(spark.createDataFrame([(60, "kernel sequences able-tables"), (61, "stable upstream")], asked.schema))
    with monkeypatch.context() as m:
        m.setattr(retrieval, "TRIE_BYTES", 0)
        want = sorted(map(str, retrieval.relevance_join(asked, docs).collect()))
    monkeypatch.setattr(retrieval, "rarest_grams", None)
    assert sorted(map(str, retrieval.relevance_join(asked, docs).collect())) == want


def test_trie_finds_tokens_across_spans(monkeypatch):
    rng = random.Random(5)
    tokens = sorted({"".join(rng.choices("ab-1", k=rng.randrange(4, 9))) for _ in range(80)})
    texts = ["".join(rng.choices("ab-1 é", [6, 6, 2, 2, 1, 1], k=rng.randrange(0, 60))) for _ in range(50)] + ["", "ab", "abab" * 30]
    want = [[i for i, t in enumerate(tokens) if t in x] for x in texts]
    for span, cells in ((1 << 20, 1 << 24), (7, 1), (1, 3 * len(tokens))):
        monkeypatch.setattr(scan, "SPAN", span)
        monkeypatch.setattr(scan, "CELLS", cells)
        got = []
        for counts, places in scan.found_in(pa.array(["cut", *(x + "\n" for x in texts)]).slice(1), scan.trie(tuple(tokens)), len(tokens)):
            ends = counts.cumsum()
            got += [sorted(places[e - n:e].tolist()) for e, n in zip(ends, counts)]
        assert got == want


def test_documents_beyond_the_budget_are_not_indexed(spark, monkeypatch):
    """They can never be picked; a size below zero gives room, so that a later one may be above the budget."""
    asked = spark.createDataFrame([(1, "river table")], "query_id INT, query STRING")
    rows = [("a", "river table", -5), ("b", "river table", 12), ("c", "river table", 21), ("d", "river", 4), ("e", "river", 90), ("f", "table", None)]
    docs = spark.createDataFrame(rows, "doc_id STRING, text STRING, n_chars INT")
    given, plain = [], search.build_index
    monkeypatch.setattr(search, "build_index", lambda documents, *a: given.append(sorted(r.doc_id for r in documents.collect())) or plain(documents, *a))
    got = search.skip_over(asked, docs, 10, 2).collect()
    assert sorted((r.turn, r.doc_id) for r in got) == [(1, "a"), (2, "b")]
    assert [r.doc_id for r in search.skip_over(asked, docs.where("n_chars > 0"), 10, 2).collect()] == ["d"]
    assert given == [["a", "b", "d"], ["d"]]

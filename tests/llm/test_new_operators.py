"""Language mixtures, Merkle proofs and the source audit against brute force on small tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatehouse.llm import merkle, mixture_lang, oracles, source_audit

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def clashing(df):
    """Extra columns with the names that operators use themselves."""
    return df.select("*", *(F.lit("x").alias(c) for c in ("tree", "part", "size", "block", "copies", "terms", "vector", "index", "n", "number", "tile", "bucket", "root")))


# --- language mixtures -------------------------------------------------------
EN = "the cat and the dog were there with their thing and then the other one "
DE = "der hund und die katze sind auch noch nicht durch schwarze gegend gegangen "


def mixture_rows():
    rows = []
    for i in range(60):
        rows.append((2 * i, " ".join(EN.split()[i % 7:] + EN.split()[:i % 5 + 1]), "en", None, None))
        rows.append((2 * i + 1, " ".join(DE.split()[i % 7:] + DE.split()[:i % 5 + 1]), "de", None, None))
    return rows


def test_mixture_finds_languages_and_edges(spark):
    extra = [(1000, EN * 20 + DE * 20, None, None, None), (1001, EN, None, None, None), (1002, None, "en", None, None), (1003, "", "en", None, None),
             (1004, "123 --- 456", "de", None, None), (None, DE, "de", None, None), (1005, "漢字かな", None, None, None), (1006, EN * 3000, None, None, None)]
    docs = clashing(spark.createDataFrame(mixture_rows() + extra + extra[1:2], DOCS))
    model = mixture_lang.train(docs)
    assert model.langs == ["de", "en"]
    got = mixture_lang.predict(docs, model).collect()
    assert len(got) == 129 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert set(by[1000].languages) == {"en", "de"} and abs(by[1000].proportions[0] - 0.5) < 0.1
    assert by[1001].languages == ["en"] == by[1006].languages and by[None].lang_pred == "de" and by[None].held_out
    assert [by[i].lang_pred for i in (1002, 1003, 1004)] == ["und"] * 3 and by[1002].score == 0.0
    assert by[1005].lang_pred in ("de", "en")
    for r in got:
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_mixture_without_labels(spark):
    docs = spark.createDataFrame([(1, EN, None, None, None)], DOCS)
    model = mixture_lang.train(docs)
    assert [r.lang_pred for r in mixture_lang.predict(docs, model).collect()] == ["und"]
    assert mixture_lang.predict(docs.limit(0), model).count() == 0


def test_counts_are_those_of_all_training_rows(spark):
    rows = mixture_rows()
    got = {(r.lang, r.bucket): r.n for r in mixture_lang.counts(spark.createDataFrame(rows, DOCS)).collect()}
    want = {}
    for doc_id, text, lang, _, _ in rows:
        if zlib.crc32(str(doc_id).encode()) % 4 != 2:
            for g in mixture_lang.grams(text):
                want[lang, int(g)] = want.get((lang, int(g)), 0) + 1
    assert got == want


def test_proportions_reach_the_best_mixture():
    rng = np.random.default_rng(1)
    p, n = rng.random((50, 2)) + 0.01, rng.integers(1, 9, 50).astype(float)
    share, value = mixture_lang.proportions(p, n, np.array([0.5, 0.5]))
    grid = np.linspace(0, 1, 2001)
    best = max(float(n @ np.log(p @ np.array([g, 1 - g]))) for g in grid)
    assert abs(value - best) < 0.05 and abs(share.sum() - 1) < 1e-9


def test_gradient_bounds_what_a_language_adds():
    """The bound that lets a set go untried holds: no mixture gains more than the gradient says."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        p, n = rng.random((30, 2)) ** 3 + 0.01, rng.integers(1, 5, 30).astype(float)
        gain = float((n / p[:, 0]) @ p[:, 1] - n.sum())
        best = max(float(n @ np.log(p @ np.array([1 - g, g]))) for g in np.linspace(0, 1, 501))
        assert best - float(n @ np.log(p[:, 0])) <= max(gain, 0) + 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixture_lang.predict(docs, mixture_lang.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


# --- Merkle proofs -----------------------------------------------------------
def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lowered(s):
    return None if s is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def up(level):
    return [sha("".join(level[i:i + 8])) for i in range(0, len(level), 8)]


def path(nodes, at):
    out = []
    while len(nodes) > 1:
        first = at // 8 * 8
        out.append((nodes[first:at], nodes[at + 1:first + 8]))
        nodes, at = up(nodes), at // 8
    return out, nodes[0]


def brute(rows):
    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    by = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        by.setdefault(r[2], []).append((r[0] if r[0] is not None else -1, leaf(r, r[1]), leaf(r, lowered(r[1])) if tampered else None))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by[lang].sort(key=lambda x: x[:2])
    subroots = [path([x[1] for x in by[lang]], 0)[1] for lang in langs]
    out = []
    for k, lang in enumerate(langs):
        for at, (doc_id, digest, changed) in enumerate(by[lang]):
            low, subroot = path([x[1] for x in by[lang]], at)
            high, root = path(subroots, k)
            fold = changed or digest
            for left, right in low + high:
                fold = sha("".join([*left, fold, *right]))
            out.append((None if doc_id == -1 else doc_id, digest, subroot, root, sha("".join("".join(a + b) for a, b in low + high)), fold, fold == root))
    return sorted(out, key=str)


def merkle_rows():
    rows = [(i * 7 % 300, f"Text {i} Ünï" + "X" * (i % 3), ("en", "de", None, "éo", "zz")[min(i % 11, 4)], f"s{i % 3}" if i % 5 else None, i if i % 4 else None)
            for i in range(200)]
    rows += [(5, "same Row", "en", "s", 1)] * 70 + [(5, "other Text", "en", "s", 1), (None, "No Id", "en", "s", 1), (None, None, None, None, None),
                                                    (900, None, "en", "s", 1), (901, "", "one", "s", 1), (902, "A" * 200_000, "en", "s", 1)]
    return rows + [(2000 + i, "t", f"l{i}", None, None) for i in range(12)]


@pytest.mark.parametrize("depth", [1, 4])
def test_proofs_equal_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "SPAN", 8 ** depth)
    docs = clashing(spark.createDataFrame(merkle_rows(), DOCS).repartition(5))
    got = sorted((tuple(r) for r in merkle.verify(docs).collect()), key=str)
    assert got == brute(merkle_rows())
    assert {r[-1] for r in got} == {True, False}


def test_proofs_of_some_leaves_are_those_of_all(spark):
    tree = merkle.manifest(spark.createDataFrame(merkle_rows(), DOCS))
    every = {tuple(r) for r in merkle.proofs(tree).collect()}
    some = [tuple(r) for r in merkle.proofs(tree, tree.leaves.filter("doc_id % 5 = 0 AND doc_id <> 5")).collect()]
    assert some and set(some) == {r for r in every if r[0] is not None and r[0] % 5 == 0 and r[0] != 5}


def test_proofs_of_empty_and_single_tables(spark):
    assert merkle.verify(spark.createDataFrame([], DOCS)).count() == 0
    (row,) = merkle.verify(spark.createDataFrame([(1, "a", "en", None, 3)], DOCS)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("") and row.verified


def test_missing_is_the_smallest_sufficient_set():
    rng = np.random.default_rng(0)
    for size in (1, 2, 8, 9, 64, 65, 700):
        for _ in range(5):
            have = np.unique(rng.integers(0, size, rng.integers(1, 40)))
            known = {(0, int(i)) for i in have} | set(merkle.missing(have, size))
            assert not {(0, int(i)) for i in have} & set(merkle.missing(have, size))
            for level in range(merkle.height(size)):
                runs = {i // 8 for at, i in known if at == level}
                for r in runs:
                    kids = {(level, i) for i in range(r * 8, min(r * 8 + 8, merkle.width(size, level)))}
                    assert kids <= known
                    assert (level + 1, r) not in known  # nothing fetched that can be derived
                    known.add((level + 1, r))
            assert (merkle.height(size), 0) in known


# --- source audit ------------------------------------------------------------
def audit_rows():
    words = ["Alpha", "beta", "gamma", "ÉTÉ", "delta", "zwölf", "omega", "漢字", "a1b2", "don't"]
    rows = []
    for i in range(240):
        text = " ".join(words[(i * k + k) % len(words)] for k in range(1, 3 + i % 6)) + (" Alpha" * (i % 4))
        rows.append((i, text, ("en", "de", None, "")[i % 4 if i % 9 else 0], ("a", "b", "c", None, "é")[i % 5], None))
    return rows + [(500, None, "en", "none", None), (501, "12 34", "en", "digits", None), (502, "rare", "xx", "a", None), (503, "rare", "xx", "b", None),
                   (504, "beta " * 50_000, "en", "long", None)] + [(505, "Alpha beta", "en", "a", None)] * 5


@pytest.mark.parametrize("tile, block", [(64, 512), (2, 3)])
def test_audit_equals_sql(spark, monkeypatch, tile, block):
    import duckdb
    monkeypatch.setattr(source_audit, "TILE", tile)
    monkeypatch.setattr(source_audit, "BLOCK", block)
    docs = clashing(spark.createDataFrame(audit_rows(), DOCS))
    got = sorted(tuple(r) for r in source_audit.audit(docs).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", audit_rows())
    assert got == sorted(con.execute(oracles.source_audit()).fetchall())
    assert {r[2] for r in got} == {"pair", "term"} and ("xx", "a", "pair", "b", 0, 1) in got


@pytest.mark.parametrize("held", [8_000_000, 40])
def test_audit_hands_terms_on_once(spark, monkeypatch, held):
    """The fit gets a document's distinct terms, the sums get a group's texts together; no occurrence is lost."""
    from collections import Counter
    monkeypatch.setattr(source_audit, "HELD", held)
    langs = ["en", "e", "", "\0", "\1", "\2", "\2a", "en\0"]
    texts = [(i % 16, langs[i % 8], ("Alpha beta alpha ", "beta \u00e9t\u00c9 ", "12 ", "")[i % 4] * (i % 5)) for i in range(400)]
    docs = spark.createDataFrame(texts, "`group` BIGINT, lang STRING, text STRING").coalesce(1)
    want = Counter((g, source_audit.tag(n).decode() + w) for g, n, t in texts for w in t.encode().translate(source_audit.FOLD).decode().split())
    rows = source_audit.group_terms(docs).collect()
    assert Counter((r.group, t) for r in rows for t in r.terms) == want
    assert len(rows) == len({g for g, _ in want}) if held > 40 else len(rows) > 16
    assert len({source_audit.tag(n) for n in langs}) == len(langs)
    once = source_audit.document_terms(docs).collect()
    assert all(len(r.terms) == len(set(r.terms)) for r in once) and {t for r in once for t in r.terms} == {t for _, t in want}


def test_audit_of_small_tables(spark):
    docs = spark.createDataFrame(audit_rows()[:3], DOCS)
    assert {r.part for r in source_audit.audit(docs).collect()} <= {"pair"}
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_shares_do_not_overflow(spark):
    for n in (0, 7, source_audit.SMALL - 1, source_audit.SMALL, 4 * 10**13):
        row = spark.range(1).select(source_audit.share(F.lit(n).cast("bigint"), F.lit(3 * n + 5).cast("bigint"), F.lit(7).cast("bigint")).alias("p")).first()
        assert row.p == 1 + 10**9 * (n + 2) // (3 * n + 5 + 14)

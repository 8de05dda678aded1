"""Training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatehouse.llm import (ann_tree, bpe, chunk_bpe, line_suffix, oracles, packing, prefix_counts, quality, signature_tree,
                           surrogates, toxicity, url_vocab)
from gatehouse.llm.queries import JSON_50K, QUERIES, RANKS_50K

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "one", "don't  stop\n\nwe're here", "naïve café ñandú", "日本語 テキスト  x", "a<|endoftext|>b", "z" * 3000, ("word " * 9000).strip(),
         "Same line here today\nother", "Same line here today\nmore", "\x1c\x85 odd"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(3, "one", 7, "x"), (None, "lost id", 7, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, lang string").withColumn("size", F.lit(1)).withColumn("v", F.lit("v"))


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, n_chars bigint")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON_50K)


def test_vocabulary_constants():
    assert bpe.PATTERN == public_tokenizers.PATTERN
    assert bpe.ranks(JSON_50K)[0] == bpe.ranks(RANKS_50K)[0]


def best_possible(sizes, capacity):
    """Fewest sequences by trying all, for small instances."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity and bins[b] not in bins[:b]:
                place(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1:]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 13, 20])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        left = Counter(sizes)
        fixed = packing.reduce_dominated(left, capacity)
        rest = sorted(left.elements(), reverse=True)
        assert sum(n for n, _ in fixed) + (best_possible(rest, capacity) if rest else 0) == best_possible(sizes, capacity)


def check_layout(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing(docs, library):
    rows = packing.pack_documents(docs, JSON_50K, capacity=64, with_ids=True).collect()
    assert check_layout(rows, 64) <= -(-sum(r.length for r in rows) // 64) + 1
    want = Counter()
    for d in docs.select("doc_id", "text").collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        want.update((d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_prefix_counts_are_exact(library):
    table, rng = prefix_counts.PrefixTable(JSON_50K), random.Random(2)
    parts = ["a", "th", " ", "  ", "\n", "'", "'s", "'re", "'ll", "é", "1", "!", "<|endoftext|>", "<|", "世"]
    for text in [t for t in TEXTS if t and len(t) < 100] + ["".join(rng.choices(parts, k=20)) for _ in range(60)]:
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        assert table.counts(text).tolist() == want


def test_token_counts(docs, library):
    got = Counter(tuple(r) for r in prefix_counts.token_counts(docs, JSON_50K, limit=3).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    n = {d.text: len(library.encode(d.text or "", add_special_tokens=False).ids) for d in docs.collect()}
    assert got == Counter((d.doc_id, len((d.text or "").encode()), n[d.text], n[d.text] > 3) for d in docs.collect())
    fit = prefix_counts.token_counts(docs.filter("doc_id = 9"), JSON_50K, limit=10).first()
    assert len(library.encode(TEXTS[9][:fit.fit_chars]).ids) <= 10 < len(library.encode(TEXTS[9][:fit.fit_chars + 1]).ids)


def test_chunked_encoding(docs):
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks(RANKS_50K)[0], special_tokens={})
    for chunk, overlap in ((32_768, 512), (200, 40), (50, 8)):
        got = Counter(tuple(r) for r in chunk_bpe.digests(docs, RANKS_50K, chunk, overlap).collect())
        want = Counter()
        for d in docs.collect():
            ids = own.encode_ordinary(d.text or "")
            want[d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()] += 1
        assert got == want
    assert chunk_bpe.decode_documents(chunk_bpe.encode_documents(docs, RANKS_50K, 50, 8), RANKS_50K).filter("doc_id = 6").first().decoded == TEXTS[6].encode()


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 12)).astype("float32")
    x[100:900] = x[100]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 12), (5200, [float("nan")] * 12), (5300, [1.0]), (None, x[0].tolist()), (7, x[7].tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("leaf", F.lit("clash"))
    got = ann_tree.search(table).collect()
    queries = table.filter("vec_id % 100 = 0 AND vec_id < 3000")
    want = set(ann_tree.exact_search(table.filter("vec_id < 3000"), queries))
    assert len(got) == 300 and len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 200] == list(range(100, 110))
    for r in got[:50]:
        assert r.score == pytest.approx(float(np.sqrt(((x[r.query_id].astype(float) - x[r.vec_id].astype(float)) ** 2).sum())), rel=1e-12)
    assert ann_tree.search(table.limit(0)).count() == 0
    few = ann_tree.search(table.filter("vec_id <= 4"))
    assert [(r.query_id, r.rank) for r in few.orderBy("rank").collect()] == [(0, k) for k in range(1, 5)]


def test_neighbour_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in QUERIES["op3_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect()}
    want = set(ann_tree.exact_search(table, table.filter("vec_id % 100 = 0")))
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("min_words", [1, 3, 6])
def test_line_dedup(spark, min_words):
    rng = random.Random(min_words)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "c c c", "d", "", "g g g g", " "]) for _ in range(rng.randint(0, 14)))) for i in range(50)]
    rows += [(50 + i, rows[3][1]) for i in range(3)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(con.execute(oracles.line_dedup(min_words=min_words)).fetchall())
    assert sorted(tuple(r) for r in line_suffix.line_report(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words).collect()) == want


def test_line_dedup_edges(docs, no_docs):
    got = {(r.doc_id, r.n_deleted, r.text) for r in line_suffix.line_report(docs).collect()}
    assert (10, 0, TEXTS[10]) in got and (11, 1, "more") in got and (0, 0, None) in got and (1, 0, "") in got
    assert line_suffix.drop_repeated(docs).columns == docs.columns
    assert line_suffix.line_report(no_docs).count() == 0


def test_quality_features():
    def brute(text):
        words = text.split()
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        count = Counter(windows)
        return len({j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)})

    rng = random.Random(3)
    for _ in range(200):
        text = " ".join(rng.choices("ab", k=rng.randint(0, 30)))
        assert quality.text_features(text)[5] == brute(text)
    assert quality.text_features("a # b\na # b\n\n x|") == (7, 8, 3, 3, 1, 0, 0)


def test_certified_cutoffs():
    assert quality.binomial_tail(0, 100, 0.02) == pytest.approx(0.98 ** 100)
    assert quality.binomial_tail(2, 4, 0.5) == pytest.approx(11 / 16)
    n = len(quality.LADDER)
    assert quality.certified_cutoff([0] * n, 100, 0.01, 0.01) is None
    assert quality.certified_cutoff([0] * n, 5000, 0.01, 0.01) == quality.LADDER[-1]
    assert quality.certified_cutoff([0, 0, 900] + [0] * (n - 3), 5000, 0.01, 0.01) == quality.LADDER[1]


def test_quality_verdicts(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id bigint, quality int")
    good = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(12)), "en") for i in range(3000)] + [(9000, " ".join(f"# w{j}" for j in range(12)), "en"), (9001, None, None)],
                                 "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_verdicts(good, labels).collect()}
    assert got[5].kept and not got[9000].kept and got[9000].failed_rule == "symbol_share" and got[9001].base_failed
    assert quality.quality_verdicts(docs, labels.limit(0)).count() == docs.count()
    assert quality.quality_verdicts(no_docs, labels).count() == 0


def test_surrogates(spark, no_docs):
    texts = ["Mail ann.lee@mail.example.com or ANN.LEE@MAIL.EXAMPLE.COM, +1 (017) 555-7713 or +1-017-555-7713", "97.51.17.173 4845168114407329 123-45-6789",
             'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "Mrs Clara Smith, Mr Bruno Jones, Mrs. Clara Smith, Dr Иван Петров", None, "", "plain 12 text"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    got = surrogates.surrogate_report(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__at", F.lit(1)), "k").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[i].n_entities for i in range(7)] == [4, 3, 1, 4, 0, 0, 0]
    assert by[6].text == texts[6] and by[4].text is None and by[None].text == by[1].text
    for text in texts[:3]:
        for entity in spark.range(1).select(surrogates.entities(F.lit(text))).first()[0]:
            assert all(entity not in (r.text or "") for r in got)
    first, second = (w.strip(",") for w in (by[0].text.split()[1], by[0].text.split()[3]))
    assert first.upper() == second and first.endswith(".com")
    names = by[3].text.split(", ")
    assert names[0].removeprefix("Mrs ") == names[2].removeprefix("Mrs. ") and names[0].split()[1].lower() in surrogates.GIVEN["f", "Latin"]
    assert names[1].split()[1].lower() in surrogates.GIVEN["m", "Latin"] and not names[3].isascii()
    assert surrogates.surrogate_report(no_docs, "k").count() == 0


def test_names_keep_their_references(spark):
    texts = ["Mrs Clara Smith came. Clara Smith left, and Smith's bag stayed; Smithson too.", "Mr Jones met Mr Bruno Jones. Bruno Jones and Jones spoke.",
             "Clara Smith without a title", "Dr Jean Smith-Jones, then Smith-Jones and Jean Smith-Jones"]
    got = {r.doc_id: r for r in surrogates.surrogate_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "k").collect()}
    words = [got[i].text.replace(".", "").replace(",", "").split() for i in range(4)]
    full, family = words[0][1:3], words[0][2]
    assert full[0].lower() in surrogates.GIVEN["f", "Latin"] and family != "Smith"
    assert words[0][4:6] == full and f"{family}'s bag stayed; Smithson too" in got[0].text and got[0].n_entities == 3
    jones = words[1][1]
    assert words[1][5] == jones and words[1][6:8] == words[1][4:6] and words[1][9] == jones and "Jones" not in got[1].text and got[1].n_entities == 4
    assert got[2].text == texts[2] and got[2].n_entities == 0
    assert words[3][1:3] == words[3][-2:] and "Smith" not in got[3].text and got[3].n_entities == 3


def test_many_given_names_of_one_family(spark):
    found = spark.createDataFrame([("NAME", f"given{chr(97 + i // 26)}{chr(97 + i % 26)} smith", "f") for i in range(300)], "kind string, value string, gender string")
    table = surrogates.surrogate_table(found, "k").collect()
    assert len(table) == 300 and len({r.surrogate for r in table}) == 300 and len({r.surrogate.split()[1] for r in table}) == 1


def test_secrets_of_letters_only(spark):
    secrets = ["correct-horse-battery", "abcdefghijklmnop", "QwertyQwertyQwerty", "deadbeefcafedeadbeefcafedeadbeefca"]
    texts = [f"the password: {secrets[0]} is kept", f"api_key = '{secrets[1]}' here", f"TOKEN={secrets[2]}", f"a run {secrets[3]} of hex", "plain words, nothing else"]
    got = {r.doc_id: r for r in surrogates.surrogate_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "k").collect()}
    assert [got[i].n_entities for i in range(5)] == [1, 1, 1, 1, 0] and got[4].text == texts[4]
    assert all(s not in r.text for s in secrets for r in got.values())


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def mod97(iban):
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_check_digits_decide_and_are_kept(spark):
    texts = ["order 12345678901234 and 4845 1681 1440 7329", "4845168114407329", "12345678901234", "DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00",
             "password: 1234567890123 stays no secret", "GB82WEST12345698765432"]
    got = [r.text for r in surrogates.surrogate_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "k").orderBy("doc_id").collect()]
    card = got[0].removeprefix("order 12345678901234 and ")
    assert luhn(card) and card.replace(" ", "") == got[1] != texts[1] and [len(p) for p in card.split()] == [4] * 4
    assert got[2] == texts[2]
    iban, other = got[3].split(" and ")
    assert mod97(iban) and iban[:2] == "DE" and len(iban) == 27 and iban != texts[3][:27] and other == "DE88 3704 0044 0532 0130 00"
    assert "1234567890123" not in got[4] and got[4].endswith(" stays no secret") and mod97(got[5]) and got[5] != texts[5]


def test_check_digits_equal_brute_force(spark):
    rng = random.Random(3)
    numbers = ["".join(rng.choices("0123456789", k=rng.randint(13, 19))) for _ in range(300)]
    ibans = [rng.choice(["DE", "FR", "NO"]) + "".join(rng.choices("0123456789", k=2)) + "".join(rng.choices("0123456789ABCXYZ", k=16)) for _ in range(600)]
    rows = spark.createDataFrame([(v,) for v in numbers + ibans], "v string").select("v", surrogates.is_entity(F.col("v")).alias("ok")).collect()
    assert {r.v: r.ok for r in rows} == {**{v: luhn(v) for v in numbers}, **{v: mod97(v) for v in ibans}}


def test_phones_and_long_addresses(spark):
    texts = ["(017) 555-7713", "+1-017-555-7713", "+44 017 555 7713", "2001:db8::8a2e:370:7334", "2001:DB8::8a2e:370:7334 2001:db8:0:0:0:8a2e:370:7334", "std::vector 12:30 00:1a:2b:3c:4d:5e ab::cd"]
    got = [r.text for r in surrogates.surrogate_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "k").orderBy("doc_id").collect()]
    local = "".join(c for c in got[0] if c.isdigit())
    assert local != "0175557713" and got[1].startswith("+1-") and got[2].startswith("+44 ")
    assert all("".join(c for c in g if c.isdigit()).endswith(local) for g in got[:3])
    assert got[3] != texts[3] and got[3].count(":") == texts[3].count(":") and "::" in got[3] and got[4].split()[0].lower() == got[3]
    assert got[4].split()[1] not in (got[3], texts[4].split()[1]) and got[5] == texts[5]


def test_surrogates_in_a_very_long_text(spark):
    text = "plain words and numbers 12345678901234 " * 20_000 + "ann.lee@mail.example.com"
    got = surrogates.surrogate_report(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "k").first()
    assert got.n_entities == 1 and got.text[:-24] == text[:-24] and got.text[-24:] != text[-24:]


def test_surrogates_stay_distinct(spark):
    found = spark.createDataFrame([("NAME", f"smith{chr(97 + i // 26)}{chr(97 + i % 26)}", None) for i in range(600)], "kind string, value string, gender string")
    table = surrogates.surrogate_table(found, "k").collect()
    assert len(table) == 600 and len({r.surrogate for r in table}) == 600 and not {r.surrogate for r in table} & {r.value for r in table}


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.NET/x", "http://net", "https://example.net/en/1?x", "https://m.example.com/de/1", "http://x.org/fr/", "http://notnet/x",
            "http://casino.example.com/", "http://casinos.example.com/", "http://free-win.example.com/", "http://free.free.com/free", "http://a.b#://c"]
    got = {r.page_id: r for r in url_vocab.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    assert [got[i].verdict for i in range(len(urls))] == ["allow", "allow", "allow", "block", "allow", "allow", "block", "allow", "allow", "block", "allow", "block", "allow", "allow"]
    assert (got[3].host, got[3].path, got[3].rule) == ("a.net", "/x", "net/") and got[0].host == "" and got[13].host == "a.b"
    assert got[5].rule == "example.net/en/" and got[12].n_soft == 1


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    hit, miss = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(hit) > 0.8 and np.mean(miss) < 0.02


def test_toxicity_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, None), (3, None, 1)], "doc_id bigint, toxic int, quality int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == docs.count()
    model = toxicity.train(no_docs, labels)
    assert toxicity.score(no_docs, model).count() == 0 and toxicity.keep_clean(docs, model).count() == docs.count()


def _labelled_words(n, seed):
    """Toxic are texts with both "plum" and "those", and those with "vile"; "those" alone is as toxic as any text."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        words = {f"w{chr(97 + rng.randrange(26))}" for _ in range(6)}
        kind = rng.random()
        words |= {"plum", "those"} if kind < 0.1 else {"plum"} if kind < 0.2 else {"those"} if kind < 0.55 else {"vile"} if kind < 0.67 else set()
        text = " ".join(sorted(words))
        rows.append((text, int("vile" in words or {"plum", "those"} <= words)))
    return rows


def test_toxicity_learns_a_pair_with_a_neutral_term():
    cache = {}
    def packed(rows):
        return [(np.sort(toxicity.terms(t, cache)).tobytes(), y) for t, y in rows]
    model = toxicity.fit(packed(_labelled_words(3000, 1)))
    those = toxicity.terms_of("those")[0]
    alone = toxicity.fit(packed(_labelled_words(3000, 1)), alpha=1e-300)
    assert those in model.place and those not in alone.place
    def wrong(m):
        return sum((toxicity.score_text(m, t, {}) >= 0.3) != y for t, y in _labelled_words(1000, 2))
    assert wrong(model) == 0 and wrong(alone) > 50


def test_toxicity_score_is_the_sum_over_pairs():
    model = toxicity.fit([(np.sort(toxicity.terms(t, {})).tobytes(), y) for t, y in _labelled_words(800, 3)])
    for text, _ in _labelled_words(40, 4) + [("", 0), ("plum " * 5000, 0)]:
        at = [model.place[int(t)] for t in toxicity.terms(text, {}) if int(t) in model.place]
        logit = model.bias + sum(model.weights[i] for i in at) + sum(
            float(model.factors[i] @ model.factors[j]) for k, i in enumerate(at) for j in at[:k])
        assert toxicity.score_text(model, text, {}) == pytest.approx(1 / (1 + np.exp(-logit)))


def test_toxicity_partners_by_brute_force():
    rng = random.Random(5)
    texts = [frozenset(rng.sample(range(30), rng.randint(0, 9))) for _ in range(400)]
    labels = [int({1, 7} <= t or rng.random() < 0.1) for t in texts]
    scores = np.array([0.4 if 1 in t else 0.1 for t in texts])
    docs = np.zeros(1 << toxicity.BITS, np.int64)
    for t in texts:
        docs[list(t)] += 1
    rows = [(np.array(sorted(t), np.int32).tobytes(), y) for t, y in zip(texts, labels)]
    for alpha in (1e-4, 0.05, 5.0, 500.0):
        expected, chosen = set(), [1, 2, 3]
        others = [t for t in range(30) if t not in chosen and docs[t] >= 3]
        for c in chosen:
            for t in others:
                both = [i for i, words in enumerate(texts) if {c, t} <= words]
                off, variance = abs(sum(labels[i] - scores[i] for i in both)), sum(scores[i] * (1 - scores[i]) for i in both)
                if len(both) >= 3 and off * off / 2 / (variance + off / 3) > np.log(len(chosen) * len(others) / alpha):
                    expected.add(t)
        assert set(toxicity.partners(rows, scores, np.array(chosen), docs, 3, alpha).tolist()) == expected
    assert expected


@pytest.mark.parametrize("n,percent,block", [(3, 90, 10**6), (5, 80, 10**6), (2, 60, 300)])
def test_ngram_join(spark, n, percent, block):
    rng, rows = random.Random(n), []
    for base in range(12):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), " ".join(w if rng.random() > 0.03 else "NEW" for w in words)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (0, rows[0][1])]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = Counter(con.execute(oracles.ngram_join(n=n, percent=percent)).fetchall())
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("cluster", F.lit(0))
    assert Counter(tuple(r) for r in signature_tree.link_components(frame, n, percent, block).collect()) == want


def test_signatures_miss_no_link():
    rng, links = np.random.default_rng(4), 0
    for _ in range(1500):
        a = np.unique(rng.integers(0, 2**63, rng.choice([9, 10, 19, 20, 40, 100, 400])).astype(np.uint64))
        cut = rng.integers(0, max(1, len(a) // 8) + 1)
        b = np.unique(np.r_[rng.permutation(a)[cut:], rng.integers(0, 2**63, rng.integers(0, cut + 1)).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            links += 1
            assert len(np.intersect1d(signature_tree.signatures(a, 90), signature_tree.signatures(b, 90)))
    assert links > 300


def test_repeated_rows_are_one_class_in_a_block(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words))] * 400 + [(1, " ".join([*words, "more"]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    feats = signature_tree.features(frame, 3, 90).groupBy("v").agg(F.min("doc_id").alias("least_id"))
    zero = F.lit(0).cast("bigint")
    placed = feats.select("v", zero.alias("cluster"), zero.alias("band"), zero.alias("block"), "least_id")
    assert signature_tree._sets(frame.coalesce(1), placed, 3).count() == 2
    assert signature_tree._sets(frame.repartition(4), placed, 3).count() <= 2 * 8
    batch = pa.RecordBatch.from_pylist([{"block": 1, "v": v, "shingles": b"x"} for v in (1, 1, 1, 2, 2)])
    assert list(signature_tree._grouped(iter([batch, batch.slice(3)]), 1)) == [((1,), [[1, 2], [b"x", b"x"]])]
    assert {r.component_id for r in signature_tree.link_components(frame, 3, 90).collect()} == {0}


def test_ngram_join_edges(docs, no_docs):
    got = {r.doc_id: r for r in signature_tree.link_components(docs).collect()}
    assert got[0].n_shingles == 0 and got[0].component_id == 0 and got[3].n_shingles == 1 and got[None].component_id is None
    assert signature_tree.link_components(no_docs).count() == 0


def test_empty_tables(no_docs):
    assert packing.pack_documents(no_docs, JSON_50K).count() == 0
    assert prefix_counts.token_counts(no_docs, JSON_50K).count() == 0
    assert chunk_bpe.digests(no_docs, RANKS_50K).count() == 0

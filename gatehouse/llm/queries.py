"""Queries of the training-data operators, with DuckDB SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers

from . import (
    ann_tree, chunk_bpe, line_suffix, merkle, mixture_lang, oracles, packing, prefix_counts, quality, signature_tree, source_audit, surrogates, toxicity, url_vocab,
)
from .common import read

JSON_50K = public_tokenizers.path("byte_bpe_50k.json")
RANKS_50K = public_tokenizers.path("byte_bpe_50k.tiktoken")

SECRET_KEY = "example key; a real run passes its own"


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), JSON_50K)


def op2_token_counts(spark, sf_dir):
    return prefix_counts.token_counts(read(spark, sf_dir, "documents"), JSON_50K)


def op3_nearest_neighbours(spark, sf_dir):
    return ann_tree.search(read(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark, sf_dir):
    return line_suffix.line_report(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality.quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_surrogates(spark, sf_dir):
    return surrogates.surrogate_report(read(spark, sf_dir, "documents"), SECRET_KEY)


def op7_url_filters(spark, sf_dir):
    return url_vocab.url_verdicts(read(spark, sf_dir, "pages"))


def op8_byte_bpe(spark, sf_dir):
    return chunk_bpe.digests(read(spark, sf_dir, "documents"), RANKS_50K)


def op9_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_ngram_join(spark, sf_dir):
    return signature_tree.link_components(read(spark, sf_dir, "documents"))


def op11_language_mixture(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return mixture_lang.predict(docs, mixture_lang.train(docs))


def op12_merkle_proofs(spark, sf_dir):
    return merkle.verify(read(spark, sf_dir, "documents"))


def op13_source_audit(spark, sf_dir):
    return source_audit.audit(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op3_nearest_neighbours, op4_line_dedup, op5_quality_rules, op6_surrogates, op7_url_filters, op8_byte_bpe, op9_toxicity, op10_ngram_join,
                                   op11_language_mixture, op12_merkle_proofs, op13_source_audit)}

ORACLES: dict[str, str] = {
    "op4_line_dedup": oracles.line_dedup(),
    "op7_url_filters": oracles.url_filters(),
    "op10_ngram_join": oracles.ngram_join(),
    "op12_merkle_proofs": oracles.merkle_proofs(),
    "op13_source_audit": oracles.source_audit(),
}

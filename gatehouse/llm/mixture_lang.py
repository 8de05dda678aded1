"""Language identification by mixture inference.

A language is a distribution over hashed letter n-grams (one to three letters, words with a
blank on either side), counted on Spark over every labelled training row.  A document is a
mixture: each of its n-grams comes from one of its languages, and expectation-maximisation
estimates the proportions.  The language set is chosen by penalised likelihood: starting with
the best single language, the language that helps most joins while the likelihood rises by
more than one and half the logarithm of the number of words, for each n-gram length.  The mixture's likelihood is concave, so a
gradient at the current proportions bounds what any further language could add; where that
bound is below the penalty no set is tried at all.

The prediction is the language with the largest proportion; its score is that proportion times
its tempered posterior among the languages that the set leaves out.

Rows: a null text and a text without letters give ``und`` and score 0, as does everything
where no row is labelled.  Repeated training rows count each time; a null id is held out.  Ties
go to the smaller language.  Only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

BITS = 15
BUCKETS = 1 << BITS
"""Hashed n-grams; a language's model is 4 bytes for each, 128 KB."""

ORDERS = 3
"""N-gram lengths: every letter is counted about as often, so likelihoods are that many times too large."""

SMOOTHING = 0.5
STEPS = 30
TOLERANCE = 1e-3
HELD = 32
"""Languages whose counts a training task holds before it hands them on."""

UNKNOWN = "und"

_BREAK = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Rows whose language is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def grams(text: str) -> np.ndarray | None:
    """Hashes of the text's n-grams, in no order; None without a letter."""
    if not _LETTER.search(text):
        return None
    flat = " " + _BREAK.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = c == 32
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + c[2:]
    # Blanks stand at word ends only: none by itself, and none inside of three.
    found = np.concatenate([one[~blank], two, three[~blank[1:-1]]]) * np.uint64(0xD6E8FEB86659FD93)
    return (found >> np.uint64(64 - BITS)).astype(np.int32)


def counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n: n-gram counts of all training rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                found = grams(text.as_py())
                if found is not None:
                    lang = lang.as_py()
                    if lang not in held:
                        if len(held) >= HELD:
                            yield from handed()
                        held[lang] = np.zeros(BUCKETS, np.int64)
                    held[lang] += np.bincount(found, minlength=BUCKETS)
        yield from handed()

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    return rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    log: np.ndarray
    """Log probability of each bucket (rows) in each language (columns)."""


def train(docs: DataFrame) -> Model:
    """The model of every language with a training row; its size is the number of languages times ``BUCKETS``."""
    table = counts(docs).toArrow()
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    place = {lang: i for i, lang in enumerate(langs)}
    n = np.zeros((BUCKETS, len(langs)))
    n[table.column("bucket").to_numpy(), np.array([place[x] for x in names], np.int64)] = table.column("n").to_numpy()
    return Model(langs, np.log((n + SMOOTHING) / (n.sum(0) + SMOOTHING * BUCKETS)).astype(np.float32))


def proportions(p: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation: the mixture's proportions and its log likelihood, for ``n`` times each row of ``p``."""
    share, total, best = start, n.sum(), -np.inf
    for _ in range(STEPS):
        joint = p * share
        whole = joint.sum(1)
        value = float(n @ np.log(whole))
        if value - best < TOLERANCE:
            break
        best, share = value, (n / whole) @ joint / total
    return share, max(best, value)


def infer(model: Model, text: str) -> tuple[list[tuple[str, float]], float] | None:
    """The text's languages with their proportions, largest first, and the first one's score; None without a letter."""
    found = grams(text)
    if found is None or not model.langs:
        return None
    at, n = np.unique(found, return_counts=True)
    log, n = model.log[at].astype(np.float64), n.astype(np.float64)
    alone = n @ log
    top = int(alone.argmax())
    words = text.count(" ") + text.count("\n") + 2
    penalty = ORDERS * (1 + 0.5 * np.log(words))
    chosen, share, value = [top], np.ones(1), float(alone[top])
    p = np.exp(log - log.max(1, keepdims=True))
    value -= float(n @ log.max(1))
    while len(chosen) < len(model.langs):
        gain = (n / (p[:, chosen] @ share)) @ p - n.sum()
        gain[chosen] = -np.inf
        better = None
        for lang in np.argsort(-gain, kind="stable"):
            if gain[lang] <= penalty or (better and better[2] - value >= gain[lang]):
                break  # nor can any language after it
            trial = [*chosen, int(lang)]
            got, likelihood = proportions(p[:, trial], n, np.r_[share * 0.9, 0.1])
            if likelihood - value > penalty and (better is None or likelihood > better[2]):
                better = trial, got, likelihood
        if better is None:
            break
        chosen, share, value = better
    order = sorted(range(len(chosen)), key=lambda i: (-share[i], model.langs[chosen[i]]))
    first = chosen[order[0]]
    rivals = [i for i in range(len(model.langs)) if i == first or i not in chosen]
    posterior = 1 / np.exp(np.clip((alone[rivals] - alone[first]) / np.sqrt(n.sum()), -50, 50)).sum()
    return [(model.langs[chosen[i]], float(share[i])) for i in order], float(min(1.0, share[order[0]] * min(1.0, posterior)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and all the text's languages with their proportions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        rows = [infer(shared.value, t) if t is not None else None for t in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [r[0][0][0] if r else UNKNOWN for r in rows],
                "score": [r[1] if r else 0.0 for r in rows], "languages": [[x for x, _ in r[0]] if r else [] for r in rows],
                "proportions": [[x for _, x in r[0]] if r else [] for r in rows]}

    return arrow_map(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run,
                     "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>")

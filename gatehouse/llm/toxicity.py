"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its lower-cased letter runs and of their first five and six
letters, hashed.  A document's score is logistic in a bias, the terms' weights and
the products of the terms' factor vectors, so that a pair of terms, as an insult and
a group it is aimed at, adds more than both alone.

Two screens choose the terms that are fitted, however many pass.  The first takes terms
that occur in toxic documents more often than chance allows.  The second takes terms that
are neutral alone but not beside a term of the first: where both stand, the labels differ
from the scores that the first terms give.  A pair of terms of which neither is tied to the
label alone is not found.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hand_back

LETTERS = re.compile(r"[^\W\d_]+")
BITS = 18
STEMS = (5, 6)

MAX_LABELLED = 16_000
"""Labelled documents the model is fitted on at most: those with the smallest id hash."""

CACHED = 300_000


@dataclass
class Model:
    """Bias, and weight and factors of the screened terms; ``place`` maps a hashed term to its row."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    place: dict[int, int] = field(default_factory=dict)


def terms_of(word: str) -> list[int]:
    mask = (1 << BITS) - 1
    return [zlib.crc32(word.encode()) & mask] + [zlib.crc32(f"{n}^{word[:n]}".encode()) & mask for n in STEMS if len(word) >= n]


def terms(text: str, cache: dict[str, list[int]]) -> np.ndarray:
    """Distinct hashed terms of a whole text."""
    if len(cache) > CACHED:
        cache.clear()
    found: set[int] = set()
    for word in set(LETTERS.findall(text.lower())):
        known = cache.get(word)
        if known is None:
            known = cache[word] = terms_of(word)
        found.update(known)
    return np.fromiter(found, np.int32, len(found))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[tuple[bytes, int]]:
    """(hashed terms, label) of at most ``max_labelled`` documents.

    Of several labels of a document the largest counts; null labels do not.
    Of repeated rows of an id one counts.
    """
    sample = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))

    def run(batch):
        cache: dict[str, list[int]] = {}
        return {"doc_id": batch.column(0), "toxic": batch.column(1), "terms": [np.sort(terms(t or "", cache)).tobytes() for t in batch.column(2).to_pylist()]}

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("toxic").cast("int"), "text")
    found = arrow_map(rows, run, "doc_id bigint, toxic int, terms binary").groupBy("doc_id").agg(F.min("terms").alias("terms"), F.max("toxic").alias("toxic"))
    return [(bytes(r.terms), r.toxic) for r in found.orderBy("doc_id").collect()]


def chance_bound(off: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Bernstein's bound, as a negative logarithm, on the chance that labels lie ``off`` as far from their scores in sum."""
    off = np.abs(off)
    return off * off / 2 / np.maximum(variance + off / 3, 1e-12)


def partners(rows: list[tuple[bytes, int]], scores: np.ndarray, chosen: np.ndarray, docs: np.ndarray, min_docs: int, alpha: float) -> np.ndarray:
    """Terms that are not chosen, but beside a chosen one the labels differ from the model's ``scores``.

    All pairs that stand in ``min_docs`` documents are tested, at level ``alpha`` for all of
    them together.  Documents are visited one at a time, so that memory follows the number of
    hashes and not the sample; a chosen term whose documents are scored too well for any pair
    to pass is not visited.
    """
    is_chosen = np.zeros(1 << BITS, bool)
    is_chosen[chosen] = True
    others = np.flatnonzero((docs >= min_docs) & ~is_chosen)
    if not len(others):
        return others
    least, passed = np.log(len(chosen) * len(others) / alpha), np.zeros(1 << BITS, bool)
    left = np.array([label for _, label in rows]) - scores
    of_term: dict[int, list[int]] = {int(c): [] for c in chosen}
    for i, (packed, _) in enumerate(rows):
        found = np.frombuffer(packed, np.int32)
        for c in found[is_chosen[found]]:
            of_term[int(c)].append(i)
    for places in of_term.values():
        # No pair is further off than all labels of a side, and without variance.
        if 1.5 * max(left[places].clip(0).sum(), -left[places].clip(None, 0).sum()) <= least:
            continue
        both, off, variance = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS), np.zeros(1 << BITS)
        for i in places:
            found = np.frombuffer(rows[i][0], np.int32)
            both[found] += 1
            off[found] += left[i]
            variance[found] += scores[i] * (1 - scores[i])
        beside = others[both[others] >= min_docs]
        passed[beside[chance_bound(off[beside], variance[beside]) > least]] = True
    return np.flatnonzero(passed)


def fit(rows: list[tuple[bytes, int]], factors: int = 4, steps: int = 150, min_z: float = 4.0, min_docs: int = 3, alpha: float = 0.05,
        decay: float = 1e-3, rate: float = 0.05, seed: int = 0) -> Model:
    """Fit on the terms of the first screen, then again with those of the second.  Without labels of both kinds the score is constant."""
    y = np.array([t for _, t in rows], float)
    n = len(rows)
    mean = (y.sum() + 0.5) / (n + 1) if n else 0.0
    bias = float(np.log(mean / (1 - mean))) if 0 < mean < 1 else -30.0
    if not n or y.min() == y.max():
        return Model(bias, np.zeros(0), np.zeros((0, factors)))
    docs, hits = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
    for packed, label in rows:
        found = np.frombuffer(packed, np.int32)
        docs[found] += 1
        hits[found] += label
    z = (hits - docs * mean - 0.5) / np.sqrt(docs * mean * (1 - mean) + 1e-9)
    chosen = np.where((docs >= min_docs) & (z > min_z))[0]
    if not len(chosen):
        return Model(bias, np.zeros(0), np.zeros((0, factors)))
    chosen = chosen[np.argsort(-z[chosen], kind="stable")]
    model, scores = _learn(rows, y, chosen, bias, factors, steps, decay, rate, seed)
    more = partners(rows, scores, chosen, docs, min_docs, alpha)
    if not len(more):
        return model
    return _learn(rows, y, np.concatenate([chosen, more]), bias, factors, steps, decay, rate, seed)[0]


def _learn(rows: list[tuple[bytes, int]], y: np.ndarray, chosen: np.ndarray, bias: float, factors: int, steps: int,
           decay: float, rate: float, seed: int) -> tuple[Model, np.ndarray]:
    """The model of the chosen terms by full-batch Adam, and its scores of the rows."""
    n, m = len(rows), len(chosen)
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(m)
    # One row at a time: all terms of all rows are never held unpacked.
    kept = [(p := place[np.frombuffer(packed, np.int32)])[p >= 0] for packed, _ in rows]
    at, row = np.concatenate(kept), np.repeat(np.arange(n), [len(k) for k in kept])
    w, v, b = np.zeros(m), np.random.default_rng(seed).normal(0, 0.05, (m, factors)), np.array([bias])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v, b)]

    def scored():
        sums = np.stack([np.bincount(row, weights=v[at, f], minlength=n) for f in range(factors)], 1)
        squares = np.bincount(row, weights=(v[at] ** 2).sum(1), minlength=n)
        logit = b[0] + np.bincount(row, weights=w[at], minlength=n) + 0.5 * ((sums * sums).sum(1) - squares)
        return sums, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    for step in range(1, steps + 1):
        sums, scores = scored()
        slope = (scores - y) / n
        grads = (np.bincount(at, weights=slope[row], minlength=m) + 10 * decay * w / n,
                 np.stack([np.bincount(at, weights=slope[row] * (sums[row, f] - v[at, f]), minlength=m) for f in range(factors)], 1) + decay * v,
                 np.array([slope.sum()]))
        for (first, second), p, g in zip(state, (w, v, b), grads):
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            p -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Model(float(b[0]), w, v, {int(c): i for i, c in enumerate(chosen)}), scored()[1]


def score_text(model: Model, text: str, cache: dict[str, tuple[int, ...]]) -> float:
    if len(cache) > CACHED:
        cache.clear()
    found: set[int] = set()
    for word in set(LETTERS.findall(text.lower())):
        known = cache.get(word)
        if known is None:
            known = cache[word] = tuple(model.place[t] for t in terms_of(word) if t in model.place)
        if known:
            found.update(known)
    logit = model.bias
    if found:
        at = sorted(found)
        v = model.factors[at]
        logit += model.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """The model of at most ``max_labelled`` labelled documents that are not held out.

    Null ids and labels do not count, a null text is an empty one, of repeated ids one counts
    with its largest label; without labels of both kinds, as in empty tables, the score is
    constant.  Columns other than doc_id, text and toxic have no influence.
    """
    try:
        return fit(training_rows(docs, labels, max_labelled))
    finally:
        hand_back()  # the sample was the driver's


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``docs``, a null text scored as empty."""
    def run(batch):
        scores = [score_text(model, t or "", cache) for t in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    cache: dict[str, tuple[int, ...]] = {}
    return arrow_map(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    def run(batches):
        import pyarrow as pa
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            text = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([score_text(model, t or "", cache) < threshold for t in batch.column(text).to_pylist()], pa.bool_()))
        cache.clear()
        hand_back()

    return docs.mapInArrow(run, docs.schema)

"""Which of a bounded set of tokens occur in texts, as substrings, in one pass over each text.

The tokens form a trie.  Every place of a text where some token's first four characters
stand is followed down the trie, all places of a span at once, until no token goes on.  The
work follows the texts' length; no vocabulary, no run and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as V

LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789-"
"""Bytes that a token may hold."""

BASE = len(LETTERS) + 1

SPAN = 1 << 20
"""Bytes that are searched at once; a longer text is searched in several spans."""

CELLS = 1 << 24
"""(document, token) marks that are kept at once."""

CODES = np.zeros(256, np.uint8)
CODES[list(LETTERS)] = range(1, BASE)


class Trie(NamedTuple):
    heads: np.ndarray
    """Node of every run of four codes, zero where no token begins so."""

    children: np.ndarray
    """(node, code) to node, zero where no token goes on."""

    ends: np.ndarray
    """Place of the token that ends at a node, else -1."""

    longest: int


@lru_cache(maxsize=4)
def trie(tokens: tuple[str, ...]) -> Trie:
    heads = np.zeros(BASE ** V.MIN_TOKEN, np.int32)
    steps: dict[tuple[int, int], int] = {}
    ends = [-1]
    for place, token in enumerate(tokens):
        codes = CODES[list(token.encode())].tolist()
        head = 0
        for c in codes[:V.MIN_TOKEN]:
            head = head * BASE + c
        node = int(heads[head])
        if not node:
            node = heads[head] = len(ends)
            ends.append(-1)
        for c in codes[V.MIN_TOKEN:]:
            if (node, c) not in steps:
                steps[node, c] = len(ends)
                ends.append(-1)
            node = steps[node, c]
        ends[node] = place
    children = np.zeros((len(ends), BASE), np.int32)
    for (node, c), child in steps.items():
        children[node, c] = child
    return Trie(heads, children, np.array(ends, np.int32), max(map(len, tokens), default=V.MIN_TOKEN))


def mark(seen: np.ndarray, codes: np.ndarray, upto: int, owner: np.ndarray, t: Trie) -> None:
    """Set ``seen[document, token]`` for the tokens that begin within the first ``upto`` codes; ``owner`` names the document of each."""
    wide = codes[:upto + V.MIN_TOKEN - 1].astype(np.int32)
    n = max(len(wide) - V.MIN_TOKEN + 1, 0)
    head = np.zeros(n, np.int32)
    for i in range(V.MIN_TOKEN):
        head *= BASE
        head += wide[i:i + n]
    node = t.heads[head]
    at = np.flatnonzero(node)
    node, depth = node[at], V.MIN_TOKEN
    while len(at):
        token = t.ends[node]
        whole = token >= 0
        seen[owner[at[whole]], token[whole]] = True
        # A text ends in a byte that no token holds, so there is a next code.
        node = t.children[node, codes[at + depth]]
        on = np.flatnonzero(node)
        at, node, depth = at[on], node[on], depth + 1


def found_in(texts: pa.Array, t: Trie, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of tokens, places of the tokens) of consecutive documents; every text ends in a byte that no token holds."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    most = max(CELLS // max(width, 1), 1)
    for first in range(0, len(texts), most):
        bounds = ends[first:first + most + 1]
        seen = np.zeros((len(bounds) - 1, width), bool)
        for start in range(bounds[0], bounds[-1], SPAN):
            stop = min(start + SPAN, bounds[-1])
            codes = CODES[data[start:min(stop + t.longest, bounds[-1])]]
            low = np.searchsorted(bounds, start, "right") - 1
            high = np.searchsorted(bounds, stop, "left")
            lengths = np.diff(np.clip(bounds[low:high + 1], start, stop))
            mark(seen, codes, stop - start, np.repeat(np.arange(low, high), lengths), t)
        yield seen.sum(1), np.nonzero(seen)[1]


def searcher(tokens: tuple[str, ...], numbers: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches):
        t = trie(tokens)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, places = zip(*found_in(batch.column(1), t, len(tokens)))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[np.concatenate(places)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), held], ["id", "numbers"])
    return search


def held_tokens(texts: DataFrame, tokens: Sequence) -> DataFrame:
    """(id, numbers) of the rows of ``texts`` (id, lower-case text) that hold any of ``tokens``, rows (token, number)."""
    words, numbers = tuple(r.token for r in tokens), np.array([r.number for r in tokens], np.int64)
    key, text = texts.columns
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("numbers", T.ArrayType(T.LongType()))])
    closed = texts.select(key, F.concat(text, F.lit("\n")).alias(text)).where(F.col(text).isNotNull())
    return closed.mapInArrow(searcher(words, numbers), schema).where(F.size("numbers") > 0)

"""Exact token counts at every prefix of a text, by dynamic programming.

In byte-level BPE the last token of a prefix's encoding is the one vocabulary entry
that ends there and may stand behind the last token of what precedes it.  So the
last token at each place follows from earlier places, and its count is one more.
The table answers "how many tokens has this prefix" and "how much text fits this
budget" without encoding again.
"""

from __future__ import annotations

import sys
from array import array

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_map

CACHED = 900_000
"""Pre-tokens, and token pairs, a Python worker keeps before it starts anew: about 200 bytes each."""

PRE = regex.compile(bpe.PATTERN)
TWO_SPACES = regex.compile(r"\s\s")
CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))


class PrefixTable:
    """Prefix counts under one vocabulary file."""

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        self.ranks, special = bpe.ranks(vocabulary)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        # Every ending of a token: its rank, or None for an ending that is no token itself.
        self.endings = dict.fromkeys(t[i:] for t in self.ranks for i in range(1, len(t))) | self.ranks
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.core = bpe.encoding(vocabulary)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand behind ``left``: their bytes encode to just these two."""
        if len(self.pairs) > CACHED:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.core._encode_single_piece(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def piece(self, raw: bytes) -> list[int]:
        """Token counts of the first 1, 2, ... bytes of one pre-token."""
        endings, pairs, follows = self.endings, self.pairs, self.follows
        last, count = [-1], [0]
        for end in range(1, len(raw) + 1):
            start = end
            while True:  # one and only one token fits, so the search may stop at it
                start -= 1
                token = endings[raw[start:end]]
                if token is not None:
                    if not start:
                        break
                    left = last[start]
                    fits = pairs.get(left << 32 | token)
                    if follows(left, token) if fits is None else fits:
                        break
            last.append(token)
            count.append(count[start] + 1)
        return count[1:]

    def word(self, token: str) -> bytes:
        """Counts after each character of a pre-token, as 32-bit numbers."""
        known = self.words.get(token)
        if known is None:
            raw = token.encode()
            counts = self.piece(raw)
            if len(raw) > len(token):
                counts = [c for c, nxt in zip(counts, [*raw[1:], 0]) if nxt & 0xC0 != 0x80]
            if token in CONTRACTIONS:  # cut before its last letter it is no contraction
                counts[1] = self.total(token[:1]) + self.total(token[1:2])
            if len(self.words) > CACHED:
                self.words.clear()
            known = array("I", counts).tobytes()
            if len(token) <= 64:
                self.words[token] = known
        return known

    def total(self, token: str) -> int:
        return int.from_bytes(self.word(token)[-4:], sys.byteorder)

    def _pretokens(self, text: str) -> list[str]:
        if bpe.plain(text):
            return bpe.PLAIN_PATTERN.findall(text)
        if self.vocabulary.endswith(".json"):
            return [text[a:b] for _, (a, b) in bpe.library(self.vocabulary).pre_tokenizer.pre_tokenize_str(text)]
        return PRE.findall(text)

    def _ordinary(self, text: str) -> np.ndarray:
        tokens = self._pretokens(text)
        if not tokens:
            return np.zeros(0, np.int64)
        tables = list(map(self.words.get, tokens))
        if None in tables:
            tables = [t or self.word(token) for t, token in zip(tables, tokens)]
        table = np.frombuffer(b"".join(tables), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(lengths)
        own = table[ends - 1]
        totals = np.cumsum(own)
        table += np.repeat(totals - own, lengths)
        if TWO_SPACES.search(text):  # a prefix that ends in white space has the whole run as one pre-token
            for i, (token, nxt) in enumerate(zip(tokens, tokens[1:])):
                if token.isspace() and nxt[:1].isspace():
                    table[ends[i]] = (totals[i - 1] if i else 0) + self.total(token + nxt[0])
        return table

    def counts(self, text: str) -> np.ndarray:
        """Token counts of the first 1, 2, ... characters of a text, exact for each."""
        if self.special is None:
            return self._ordinary(text)
        parts, at, base = [], 0, 0
        for m in self.special.finditer(text):
            # Until its last character a special string is ordinary text.
            table = self._ordinary(text[at:m.end() - 1]) + base
            base = (int(table[m.start() - at - 1]) if m.start() > at else base) + 1
            parts += [table, [base]]
            at = m.end()
        return np.concatenate([*parts, self._ordinary(text[at:]) + base]) if parts else self._ordinary(text)


_LOADED: dict[str, PrefixTable] = {}


def loaded(vocabulary: str) -> PrefixTable:
    """The worker's table builder; one vocabulary is kept at a time."""
    if vocabulary not in _LOADED:
        _LOADED.clear()
        _LOADED[vocabulary] = PrefixTable(vocabulary)
    return _LOADED[vocabulary]


def prefix_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes and ``prefix_tokens``: the count after every character of the whole text.

    A null or empty text has 0 bytes and an empty table.  One row per row of ``docs``.
    """
    def run(batch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts],
                "prefix_tokens": [loaded(vocabulary).counts(t).astype(np.int32) for t in texts]}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, n_bytes bigint, prefix_tokens array<int>")


def tokens_of_prefix(table: Column | str, n_chars: Column | int) -> Column:
    """Tokens of the first ``n_chars`` characters; of the whole text if it has fewer."""
    table = F.col(table) if isinstance(table, str) else table
    at = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size(table))
    return F.coalesce(F.when(at > 0, F.element_at(table, at)), F.lit(0)).cast("bigint")


def longest_within(table: Column | str, budget: int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    table = F.col(table) if isinstance(table, str) else table
    fits = F.transform(table, lambda c, i: F.when(c <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("bigint")


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars, the longest prefix within the limit."""
    table = prefix_table(docs, vocabulary)
    n = tokens_of_prefix("prefix_tokens", F.size("prefix_tokens"))
    return table.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"),
                        F.when(n > limit, longest_within("prefix_tokens", limit)).otherwise(F.size("prefix_tokens")).cast("bigint").alias("fit_chars"))

"""Byte-level BPE of long texts in overlapping chunks, and decoding.

A text longer than a chunk is cut into chunks that overlap.  Chunks are pre-tokenised
in parallel, each from its own start.  Pre-tokens depend only on the text that
follows, so from the first place where two neighbours both have a boundary they
agree for good.  The text is cut there and the pieces are encoded apart.  Where
neighbours never agree within the overlap, as in one endless word, the document is
encoded whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.session import materialise

from . import bpe
from .common import arrow_map

CHUNK = 32_768
"""Characters of a chunk without its overlap."""

OVERLAP = 512
"""Characters that a chunk shares with the next."""

MARGIN = 3
"""Boundaries so near a chunk's end may be its end's doing: a contraction has three characters."""


def encode_text(vocabulary: str, text: str) -> np.ndarray:
    return np.asarray(bpe.encoding(vocabulary).encode_ordinary(text), dtype="<u4")


def decode_ids(vocabulary: str, ids: bytes) -> bytes:
    """Raw bytes of little-endian ids, joined."""
    table = _token_bytes(vocabulary)
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


_TABLES: dict[str, list[bytes]] = {}


def _token_bytes(vocabulary: str) -> list[bytes]:
    if vocabulary not in _TABLES:
        own, special = bpe.ranks(vocabulary)
        table = [b""] * (max([*own.values(), *special.values()]) + 1)
        for token, i in own.items():
            table[i] = token
        for token, i in special.items():
            table[i] = token.encode()
        _TABLES[vocabulary] = table
    return _TABLES[vocabulary]


def boundaries(text: str, start: int, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """Pre-token starts in a chunk's first and last ``overlap`` characters, as places in the whole text."""
    ends = np.fromiter((m.end() for m in regex.finditer(bpe.PATTERN, text)), np.int64)
    if not last:
        ends = ends[ends <= len(text) - MARGIN]
    return (ends[ends < overlap] + start).tolist(), ([] if last else (ends[ends >= len(text) - overlap] + start).tolist())


def _encoded(rows: DataFrame, vocabulary: str, *keys: str) -> DataFrame:
    """Ids of ``text`` as bytes, beside the key columns."""
    def run(batch):
        texts = batch.column(len(keys)).to_pylist()
        return {k: batch.column(i) for i, k in enumerate(keys)} | {"ids": [encode_text(vocabulary, t or "").tobytes() for t in texts]}

    kinds = dict(rows.dtypes)
    return arrow_map(rows.select(*keys, "text"), run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ids binary")


def stitched_pieces(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """uid, chunk, text of the pieces between stitches; ``text`` is null where a text never resynchronised."""
    n = F.length("text")
    chunks = (long.select("uid", "text", F.posexplode(F.sequence(F.lit(0), F.greatest(n - 1 - overlap, F.lit(0)), F.lit(chunk))).alias("chunk", "start"))
              .select("uid", "chunk", "start", (F.col("start") + chunk + overlap >= n).alias("last"),
                      F.expr(f"substring(text, start + 1, {chunk + overlap})").alias("text")))

    def run(batch):
        found = [boundaries(t, s, overlap, last) for s, last, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
        return {k: batch.column(i) for i, k in enumerate(("uid", "chunk", "start", "last", "text"))} | {"head": [f[0] for f in found], "tail": [f[1] for f in found]}

    cut = arrow_map(chunks, run, "uid bigint, chunk int, start int, last boolean, text string, head array<int>, tail array<int>")
    w = Window.partitionBy("uid").orderBy("chunk")
    cut = cut.withColumn("to", F.when(~F.col("last"), F.array_min(F.array_intersect("tail", F.lead("head").over(w)))))
    cut = cut.withColumn("from", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.lag("to").over(w)))
    good = F.col("last") | F.col("to").isNotNull()
    piece = F.expr("substring(text, from - start + 1, if(last, length(text), to - from))")
    return cut.select("uid", "chunk", F.when(F.min(good).over(Window.partitionBy("uid")), piece).alias("text"))


def encode_documents(docs: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ``ids``, the little-endian unsigned 32-bit ids of the whole text as bytes.

    A null or empty text has no ids (empty bytes).  Each row of ``docs`` gives one
    row; repeated rows and null ids are kept.  Special strings are ordinary text.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > chunk + overlap
    short = _encoded(docs.filter(~is_long), vocabulary, "doc_id")
    # Chunks meet again by a row number, which has to outlive a recomputed scan.
    long = materialise(docs.filter(is_long).withColumn("uid", F.monotonically_increasing_id()))
    pieces = materialise(stitched_pieces(long, chunk, overlap))
    parts = _encoded(pieces.filter(F.col("text").isNotNull()).repartition("uid", "chunk"), vocabulary, "uid", "chunk")
    joined = (parts.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("p"))
              .select("uid", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.ids)).alias("ids")))
    stuck = pieces.filter(F.col("text").isNull()).select("uid").distinct()
    return (short
            .unionByName(long.select("uid", "doc_id").join(joined, "uid").select("doc_id", "ids"))
            .unionByName(_encoded(long.join(stuck, "uid", "left_semi"), vocabulary, "doc_id")))


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids``."""
    def run(batch):
        ids = batch.column(1).to_pylist()
        return {"doc_id": batch.column(0), "ids": batch.column(1), "decoded": [decode_ids(vocabulary, i) for i in ids]}

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id bigint, ids binary, decoded binary")


def digests(docs: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token number and digests of ids and of the decoded bytes, one row per document."""
    def run(batch):
        ids = batch.column(1).to_pylist()
        return {"doc_id": batch.column(0), "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(decode_ids(vocabulary, i)).hexdigest() for i in ids]}

    return arrow_map(encode_documents(docs, vocabulary, chunk, overlap), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

"""Shared pieces of the training-data operators: table access and Arrow maps."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a longest run of characters other than space and U+0009 to U+000D."""

WORD_RE = re.compile(WORD)

BATCH_ROWS = 256
"""Rows that a Python helper holds at once, so that its memory follows the longest texts and not the batch size."""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def own_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let a table's own columns have names with two leading underscores, which operators use for theirs.

    Such columns go through the operator under other names and get their own back.
    """
    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        away = {}
        for c in docs.columns:
            if c.startswith("__"):
                name = f"own{c}"
                while name.lower() in taken:
                    name = f"own_{name}"
                taken.add(name.lower())
                away[c] = name
        if not away:
            return operator(docs, *args, **options)
        return operator(docs.withColumnsRenamed(away), *args, **options).withColumnsRenamed({v: k for k, v in away.items()})

    return run


def hand_back() -> None:
    """Return freed memory to the system: a reused worker would otherwise keep the peak of every operator it ran."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``fn`` to small record batches; it returns one list or array per output column.  ``done`` runs at a task's end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    columns = fn(batch.slice(at, BATCH_ROWS))
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in out)], schema=out)
        finally:
            if done:
                done()
            hand_back()

    return df.mapInArrow(run, schema)

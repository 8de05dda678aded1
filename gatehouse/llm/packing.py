"""Best-fit packing of token pieces into sequences, after a dominance reduction.

``tokenise`` cuts documents into pieces; ``pack`` lays pieces of any table into
sequences.  The instance that is solved is the histogram of piece lengths, at most
``capacity`` numbers however large the corpus is.  Martello and Toth's dominance
criterion fixes sequences of up to three pieces that are provably as good as any
other; best-fit decreasing packs what is left.  Both work on counts, so a step
places all equal cases at once.  The plan goes back to the pieces by their rank
among pieces of equal length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.session import materialise

from . import bpe
from .common import arrow_map, own_names

Pattern = tuple[tuple[int, int], ...]
"""(length, copies) of the pieces of a sequence, in order."""

PLAN_ROWS = 500_000
"""Most plan rows (about 50 bytes each) that are broadcast; a larger plan is joined by shuffle."""

RANK_ROWS = 100_000
"""Pieces of one length in a bucket that is ranked by one task."""


def tokenise(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, ids if asked for.

    A document is its ids and ``end_id``.  Only longer ones are cut; the first piece
    takes the remainder.  A null or empty text is one piece that holds ``end_id``
    alone.  Each row of ``docs`` counts, repeated ones and null ids too.
    """
    def pieces(batch):
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(np.asarray(bpe.encode(vocabulary, text or ""), dtype="<u4"), np.uint32(end_id)).astype("<u4")
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids), capacity), len(ids)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                out["doc_id"].append(doc_id)
                out["piece"].append(k)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                if with_ids:
                    out["ids"].append(ids[a:b].astype(np.int32))
        return out

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return arrow_map(docs.select("doc_id", "text"), pieces, schema)


def _near(lengths: list[int], at_most: int) -> int | None:
    i = bisect.bisect_right(lengths, at_most)
    return lengths[i - 1] if i else None


def _smallest(left: Counter, lengths: list[int], n: int, above: int = 0) -> list[int]:
    """The n smallest pieces longer than ``above``, as far as there are so many."""
    found: list[int] = []
    for x in lengths[bisect.bisect_right(lengths, above):]:
        found += [x] * min(left[x], n - len(found))
        if len(found) == n:
            break
    return found


def _dominant(left: Counter, lengths: list[int], j: int, capacity: int) -> list[int] | None:
    """A set with piece ``j`` that dominates all others, or None.  ``left``: the other pieces."""
    room, small = capacity - j, _smallest(left, lengths, 3)
    if not small or small[0] > room:
        return [j]
    k = _near([x for x in lengths if left[x]], room)
    if k == room or len(small) == 1 or small[0] + small[1] > room:
        return [j, k]
    if len(small) == 3 and sum(small) <= room:
        return None
    # At most two companions fit: the longest one alone, or with the longest beside it.
    pair, open_lengths = 0, [x for x in lengths if left[x] and x <= room]
    for x in open_lengths:
        y = _near([z for z in open_lengths if z <= x and (z < x or left[x] > 1)], room - x)
        pair = max(pair, x + y if y else 0)
    if k >= pair:
        return [j, k]
    b = _near([z for z in open_lengths if z != k or left[k] > 1], room - k)
    if b is None:
        return None
    rest = left.copy()
    rest[k] -= 1
    longer = _smallest(rest, lengths, 2, above=b)
    return [j, k, b] if len(longer) < 2 or sum(longer) > room else None


def reduce_dominated(counts: Counter, capacity: int) -> list[tuple[int, Pattern]]:
    """Fix dominant sets until none is left; takes their pieces out of ``counts``."""
    fixed: list[tuple[int, Pattern]] = []
    changed = True
    while changed:
        changed = False
        for j in sorted((x for x in counts if counts[x]), reverse=True):
            while counts[j]:
                counts[j] -= 1
                chosen = _dominant(counts, sorted(x for x in counts if counts[x]), j, capacity)
                counts[j] += 1
                if chosen is None:
                    break
                need = Counter(chosen)
                times = min(counts[x] // n for x, n in need.items())
                counts.subtract({x: n * times for x, n in need.items()})
                fixed.append((times, tuple(sorted(need.items(), reverse=True))))
                changed = True
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing over counts of equal lengths."""
    by_room: dict[int, list[tuple[int, Pattern]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, pattern: Pattern) -> None:
        if n:
            if room not in by_room:
                bisect.insort(rooms, room)
            by_room.setdefault(room, []).append((n, pattern))

    for j in sorted((x for x in counts if counts[x] > 0), reverse=True):
        n = counts[j]
        while n:
            at = bisect.bisect_left(rooms, j)
            if at == len(rooms):
                room, have, pattern = capacity, -(-n // (capacity // j)), ()
            else:
                room = rooms[at]
                have, pattern = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            per = room // j
            full, rest = min(have, n // per), n % per if n // per < have else 0
            put(room - per * j, full, (*pattern, (j, per)))
            put(room - rest * j, bool(rest), (*pattern, (j, rest)))
            put(room, have - full - bool(rest), pattern)
            n -= full * per + rest
    return [g for groups in by_room.values() for g in groups]


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """(how many sequences, what each holds), covering every counted piece."""
    left = Counter({x: n for x, n in counts.items() if n})
    if left and max(left) > capacity:
        raise ValueError(f"a piece of {max(left)} tokens does not fit {capacity}")
    return reduce_dominated(left, capacity) + best_fit(left, capacity)


def plan_rows(plan: list[tuple[int, Pattern]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies, place) of each slot of the plan."""
    rows, used, sequence = [], Counter(), 0
    for times, pattern in plan:
        place = 0
        for length, copies in pattern:
            rows.append((length, used[length], used[length] + times * copies, sequence, copies, place))
            used[length] += times * copies
            place += length * copies
        sequence += times
    return rows


def pack(pieces: DataFrame, order: list[str], capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` from 1 to ``capacity``.

    ``order`` names columns that tell pieces of a length apart; pieces that are equal
    in them may swap places.  Empty input gives no rows.  The pieces are checkpointed,
    because the histogram and the placing both read them.  Columns may have any names.
    """
    return _pack(pieces, [pieces.columns.index(c) for c in order], capacity)


@own_names
def _pack(pieces: DataFrame, order_at: list[int], capacity: int) -> DataFrame:
    order = [pieces.columns[i] for i in order_at]
    spark = pieces.sparkSession
    stored = materialise(pieces)
    counts = {r.length: r.n for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan_rows(plan_sequences(counts, capacity))
    slots = spark.createDataFrame(rows, "__length bigint, __from bigint, __to bigint, __sequence bigint, __copies bigint, __place bigint")
    buckets = max(64, -(-max(counts.values(), default=0) // RANK_ROWS))
    hashed = stored.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = (hashed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
             .select(F.col("length").alias("__l"), F.col("__bucket").alias("__b"),
                     (F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("__n")).alias("__before")))
    local = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*order)) - 1
    ranked = (hashed.withColumn("__local", local)
              .join(sizes, (F.col("length") == F.col("__l")) & (F.col("__bucket") == F.col("__b")))
              .withColumn("__rank", F.col("__before") + F.col("__local")))
    return (ranked.join(F.broadcast(slots) if len(rows) <= PLAN_ROWS else slots,
                        (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
            .select(*pieces.columns,
                    F.expr("__sequence + (__rank - __from) div __copies").alias("sequence_id"),
                    F.expr("__place + (__rank - __from) % __copies * length").alias("offset")))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` with ``sequence_id`` and ``offset``; see ``tokenise`` for null, empty, long and repeated texts, ``pack`` for empty tables.

    Only ``doc_id`` and ``text`` are read; other columns have no influence.
    """
    return pack(tokenise(docs, vocabulary, capacity, end_id, with_ids), ["doc_id", "piece", "start", "ids_crc32"], capacity)

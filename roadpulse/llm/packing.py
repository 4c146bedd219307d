"""Best-fit packing with large-item matching (operator 9).

How many bins of what make-up are needed depends only on how many pieces have
which length, and a piece has at most ``capacity`` tokens. So the lengths are
counted by Spark (at most ``capacity`` rows come to the driver, whatever the
size of the corpus), the plan is made for whole runs of equal pieces at once,
and the pieces look up their place by their rank among the pieces of their
length. No bin, group or table is ever gathered in one place.

The plan: pieces above a third of the capacity fit at most twice into a bin
and are paired greedily, the longest with the longest that still fits; then
the smaller ones, longest first, go where they leave the least room.

Defined results: a null or empty text is one piece, its end token; repeated
rows are packed as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact_rank, materialize
from .tokens import public_path, tokenizer

CAPACITY = 4096
END = 1
ROWS = 4000  # texts encoded at a time in a worker


def pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: row (unique per document row), doc_id, piece, start, length, ids_crc32."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        mark = np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, offsets = tok.encode(part.column(2))
                raw = ids.tobytes()
                which, piece, start, length, crc = [], [], [], [], []
                for i in range(part.num_rows):
                    whole = raw[4 * offsets[i]:4 * offsets[i + 1]] + mark
                    for k in range(0, len(whole), 4 * capacity):
                        own = whole[k:k + 4 * capacity]
                        which.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                which = pa.array(which, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(which), part.column(1).take(which), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(cut, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts`` pieces by length: rows (length, first, last + 1,
    bin, per_bin, offset). Of the pieces of that length, those ranked from
    ``first`` on go ``per_bin`` to a bin, to consecutive bins from ``bin`` on,
    the first of them at ``offset``."""
    out: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of bins (first, how many)
    gaps: list[int] = []

    def place(n: int, c: int, first: int, per_bin: int, offset: int) -> None:
        out.append((n, used[n], used[n] + c, first, per_bin, offset))
        used[n] += c
        left[n] -= c

    def leave(gap: int, first: int, m: int) -> None:
        if gap > 0:
            if not room.get(gap):
                insort(gaps, gap)
                room[gap] = []
            room[gap].append((first, m))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect_left(large, min(n, capacity - n) + 1) - 1
            while k >= 0 and not left[large[k]]:
                large.pop(k)  # all placed; never a partner again
                k -= 1
            mate = large[k] if k >= 0 else None
            if mate is None or (mate == n and left[n] < 2):
                mate = None
                if k > 0:  # a lone piece of its length: the next shorter ones
                    j = k - 1
                    while j >= 0 and not left[large[j]]:
                        j -= 1
                    mate = large[j] if j >= 0 else None
            m = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            first, bins = bins, bins + m
            if mate == n:
                place(n, 2 * m, first, 2, 0)
            else:
                place(n, m, first, 1, 0)
                if mate is not None:
                    place(mate, m, first, 1, n)
            leave(capacity - n - (mate or 0), first, m)

    for n in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                m = -(-left[n] // (capacity // n))
                leave(capacity, bins, m)
                bins += m
                continue
            gap = gaps[at]
            first, m = room[gap].pop()
            if not room[gap]:
                gaps.pop(at)
            per_bin = gap // n
            full = min(m, left[n] // per_bin)
            if full:
                place(n, full * per_bin, first, per_bin, capacity - gap)
                leave(gap - per_bin * n, first, full)
            rest = left[n] if full < m else 0
            if rest:
                place(n, rest, first + full, rest, capacity - gap)
                leave(gap - rest * n, first + full, 1)
            if m - full - bool(rest):
                leave(gap, first + full + bool(rest), m - full - bool(rest))
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, doc_id: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    Sequence ids are gapless from 0; every sequence is filled from its offset 0
    without gaps.
    """
    path = tokenizer_path or public_path("word_bpe_49k.json")
    cut = materialize(pieces(docs, path, doc_id, text, capacity, end), "pieces")
    # bounded: one row per length that occurs, at most ``capacity``
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = sorted(plan(counts, capacity))
    table = np.array(places, np.int64).reshape(-1, 6)
    # ranks of a length are below 2**48 and lengths below 2**15
    starts = (table[:, 0] << 48) + table[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            k = np.searchsorted(starts, (length << 48) + rank, side="right") - 1
            nth = rank - table[k, 1]
            own = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(table[k, 3] + nth // table[k, 4]), pa.array(table[k, 5] + nth % table[k, 4] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = exact_rank(cut, ["length"], F.struct("row", "piece"), "rank", 16)
    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        look_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

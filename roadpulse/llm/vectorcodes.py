"""Vector code compression with active-entry Lloyd (operator 13).

A vector of integers is cut into ``parts`` equal parts, and each part is
replaced by the number of the nearest entry of its position's codebook. The
codebooks are improved by rounds of assignment and means.

Every row keeps, per part, its assigned entry and the exact squared distance
to it. In a later round only entries that moved can change anything for a part
whose own entry stayed: its stored distance is still exact and every entry
that stayed is still no better. Such parts compare the moved entries only;
parts whose own entry moved look at the whole codebook. Ties go to the lower
number in both cases, as the pair (distance, number) is compared.

A round is one pass over the rows without a shuffle of them: tasks add up
their parts by entry, and only those sums (parts x entries rows a task) are
shuffled. The codebooks (parts x entries rows) come to the driver.

Defined results: rows whose vector is null, or holds a null or non-finite
component, are dropped, as are rows whose length differs from that of the row
with the smallest id or can't be cut into the parts. Null ids come last in the
order that the codebooks start from, equal ids are ordered by their vectors.
Fewer rows than entries give smaller codebooks; an empty table gives no rows.
Components are compared as whole numbers; beyond 2**27 in absolute value
(half a million, at a scale of 256) exact distances pass 64 bits, which is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
ROWS = 2048  # rows compared at once
LIMIT = 1 << 27
EXACT = 1 << 22  # below it float products of the parts are exact

STATE = "vec_id {}, label {}, q array<int>, code array<int>, dist array<long>"


def quantised(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, q (whole numbers); rows without a whole vector are gone."""
    own = F.col(vector).cast("array<double>")
    nan = F.exists(own, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    far = F.raise_error(F.lit(f"a component is beyond {LIMIT} after scaling; exact distances need less"))
    q = F.transform(own, lambda x: F.when(F.abs(x * scale) < LIMIT, F.floor(x * scale)).otherwise(far))
    whole = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.when(~nan, q).alias("q"))
    return whole.where("q is not null")


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)


def nearest(x: np.ndarray, book: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the best of ``which`` entries of a part's
    codebook for every row; ties to the lower number."""
    some = book[which]
    if max(np.abs(x).max(initial=0), np.abs(some).max(initial=0)) < EXACT:
        inner = (x.astype(float) @ some.T.astype(float)).astype(np.int64)
    else:
        inner = x @ some.T
    d = (x * x).sum(1)[:, None] - 2 * inner + (some * some).sum(1)
    k = d.argmin(1)
    return which[k], d[np.arange(len(x)), k]


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray | None, dist: np.ndarray | None):
    """One part position: new (entry, distance) of every row."""
    every = np.arange(len(book))
    if code is None:
        return nearest(x, book, every)
    code, dist = code.copy(), dist.copy()
    changed = np.flatnonzero(moved)
    if not len(changed):
        return code, dist
    own_moved = moved[code]
    again = np.flatnonzero(own_moved)
    if len(again):
        code[again], dist[again] = nearest(x[again], book, every)
    still = np.flatnonzero(~own_moved)
    if len(still):
        k, d = nearest(x[still], book, changed)
        better = (d < dist[still]) | ((d == dist[still]) & (k < code[still]))
        code[still[better]], dist[still[better]] = k[better], d[better]
    return code, dist


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """``rows`` (with code and dist, if ``moved`` is given) with new code and dist."""
    parts = len(books)
    first = moved is None
    schema = STATE.format(*[rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                q = _matrix(b.column("q")).reshape(b.num_rows, parts, -1)
                code = None if first else _matrix(b.column("code"))
                dist = None if first else _matrix(b.column("dist"))
                new = [assign(q[:, p], books[p], None if first else moved[p], None if first else code[:, p], None if first else dist[:, p])
                       for p in range(parts)]
                ends = pa.array(np.arange(0, (b.num_rows + 1) * parts, parts, dtype=np.int32))
                code = pa.ListArray.from_arrays(ends, pa.array(np.stack([c for c, _ in new], 1).ravel().astype(np.int32)))
                dist = pa.ListArray.from_arrays(ends, pa.array(np.stack([d for _, d in new], 1).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("q"), code, dist],
                                                 names=["vec_id", "label", "q", "code", "dist"])

    return rows.mapInArrow(run, schema)


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored means of their parts; unused ones stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            if b.num_rows:
                at = (_matrix(b.column("code")) + np.arange(parts) * entries).ravel()
                count += np.bincount(at, minlength=parts * entries)
                np.add.at(total, at, _matrix(b.column("q")).reshape(-1, width))
        used = np.flatnonzero(count)
        ends = pa.array(np.arange(0, (len(used) + 1) * width, width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.ListArray.from_arrays(ends, pa.array(total[used].ravel()))],
                                         names=["at", "n", "total"])

    sums = state.select("q", "code").mapInArrow(run, "at long, n long, total array<long>")
    # whole sums: more digits than a long, as they grow with the rows
    wide = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    new = books.copy()
    for r in sums.groupBy("at").agg(F.sum("n").alias("n"), *wide).collect():  # bounded: parts x entries
        new[r["at"] // entries, r["at"] % entries] = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
    return new


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code array<int>, error long; codebooks [part, entry, place])."""
    found = quantised(vectors, vec_id, vector, label, scale)
    order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    kinds = [found.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    first = [r["q"] for r in found.orderBy(*order).limit(entries).collect()]  # bounded by the parameter
    width = len(first[0]) if first else 0
    if not width or width % parts:
        empty = found.where("false").select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    if any(len(q) != width for q in first):
        first = [r["q"] for r in found.where(F.size("q") == width).orderBy(*order).limit(entries).collect()]
    found = found.where(F.size("q") == width).withColumn("q", F.col("q").cast("array<int>"))
    books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    state, moved = found.select(*[F.col(c).cast(k) for c, k in zip(("vec_id", "label"), kinds, strict=True)], "q"), None
    for _ in range(rounds):
        state = materialize(_assigned(state, books, moved), "codes")
        new = _means(state, books)
        moved, books = (new != books).any(2), new
    state = materialize(_assigned(state, books, moved), "codes")
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, x: a + x)
    return state.select("vec_id", "label", "code", error.alias("error")), books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256."""
    coded, books = compress(vectors, **parameters)
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    # labels are counted first and written, so that their size decides how they are joined
    by_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))

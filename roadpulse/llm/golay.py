"""SimHash near-dedup with Golay-code fuzzy hashing (operator 4).

The binary Golay code has 4096 codewords of 23 bits, and every 23-bit word is
within 3 bits of exactly one. A word's fuzzy keys are the codewords nearest to
it and to each of its 23 one-bit neighbours: one if it lies within 2 bits of a
codeword, six otherwise. Two words at most 2 bits apart share a key, because
the word half way between them is a neighbour of both.

A 64-bit fingerprint is cut into segments A and B of 23 bits and C of 18. For
two fingerprints that differ in at most 3 bits, with a + b + c <= 3 errors:

* c = 0: a <= 2 or b <= 2, so C and a fuzzy key of A, or C and one of B, agree;
* c > 0, a = 0: A and a fuzzy key of B agree (b <= 2); b = 0 likewise;
* a = b = c = 1: a fuzzy key of A, one half of B and one half of C agree.

So every such pair meets under one of these keys; each candidate is verified
by its bit distance. Keys are made for distinct fingerprints only, so copies
cost nothing, and within a key only a spanning forest of the verified links is
kept, never all pairs. Components are then found by alternating stars.

Defined results: null and empty texts have no words and fingerprint zero, and
are linked like any other; fewer words than a shingle are one shingle; null
ids have no say in a component's smallest id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_key, text_of
from .components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
GENERATOR = 0xC75  # x^11+x^10+x^6+x^5+x^4+x^2+1, generates the (23, 12) Golay code
A, B, C = (0, 23), (23, 23), (46, 18)  # segments: first bit, bits


# ---- fingerprints -----------------------------------------------------------

def shingles(text: str, n: int) -> list[bytes]:
    words = text.encode().lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *[e + 1 for e in ends[:-n]]]
    return [joined[a:b] for a, b in zip(starts, ends[n - 1:], strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts whose ``counts`` hashes follow one another: bits
    that are set in over half of them. Eight bit counters share a word, for at
    most 255 hashes at a time."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    ends = np.cumsum(counts[some])
    runs = [np.arange(e - c, e, 255) for e, c in zip(ends, counts[some], strict=True)]
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(lanes, np.concatenate(runs), axis=0).view(np.uint8).astype(np.int64)
    of = np.cumsum([0, *map(len, runs[:-1])])
    total = np.add.reduceat(sums, of, axis=0)
    out[some] = np.packbits(2 * total > counts[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (digest of the text), fp: the 64 bits as a signed long."""
    limit = 200_000  # hashes turned into bits at a time

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest
        for batch in batches:
            out, hashes, counts = [], [], []

            def flush(out=out, hashes=hashes, counts=counts) -> None:
                out.append(majority(np.array(hashes, np.uint64), np.array(counts, np.int64)))
                hashes.clear()
                counts.clear()

            for t in batch.column(2):
                own = [xxh64_intdigest(s, SEED) for s in shingles(t.as_py(), shingle)]
                hashes += own
                counts.append(len(own))
                if len(hashes) > limit:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out).view(np.int64))],
                                             names=["doc_id", "key", "fp"])

    d = docs.select(F.col(doc_id).alias("doc_id"), text_key(text_of(text)).alias("key"), text_of(text).alias("text"))
    return d.mapInArrow(hashed, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, key binary, fp long")


# ---- fuzzy keys -------------------------------------------------------------

@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word, and the error of
    weight 3 or less that each of the 2048 syndromes stands for."""
    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << bit - 11
        return word

    low = np.array([syndrome(x) for x in range(1 << 12)], np.uint32)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.uint32)
    error = np.zeros(1 << 11, np.uint32)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            error[syndrome(word)] = word
    return low, high, error


def codeword(words: np.ndarray) -> np.ndarray:
    """Index (0..4095) of the codeword nearest to each 23-bit word."""
    low, high, error = _tables()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every distinct codeword index of each word's neighbourhood."""
    near = np.stack([codeword(words), *[codeword(words ^ np.uint32(1 << i)) for i in range(bits)]], axis=1)
    near.sort(axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    row, at = np.nonzero(new)
    return row, near[row, at]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all join keys of the fingerprints; the table's number is in
    the highest bits, so keys of different tables never meet."""
    seg = [(fps >> np.uint64(s)) & np.uint64((1 << n) - 1) for s, n in (A, B, C)]
    a, b, c = seg
    ra, ka = fuzzy(a.astype(np.uint32), A[1])
    rb, kb = fuzzy(b.astype(np.uint32), B[1])
    ka, kb = ka.astype(np.uint64), kb.astype(np.uint64)
    sh = np.uint64
    rows, keys = [], []

    def add(table: int, row: np.ndarray, key: np.ndarray) -> None:
        rows.append(row)
        keys.append(key | sh(table << 56))

    add(1, ra, c[ra] << sh(12) | ka)
    add(2, rb, c[rb] << sh(12) | kb)
    add(3, rb, a[rb] << sh(12) | kb)
    add(4, ra, b[ra] << sh(12) | ka)
    halves = [(b & sh(0x7FF), b >> sh(11)), (c & sh(0x1FF), c >> sh(9))]
    for i in range(2):
        for j in range(2):
            add(5 + 2 * i + j, ra, (halves[0][i][ra] << sh(21)) | (halves[1][j][ra] << sh(12)) | ka)
    return np.concatenate(rows), np.concatenate(keys)


# ---- links ------------------------------------------------------------------

WIDE = 16  # runs up to this length are compared pair by pair, all at once
DEEP = 20_000  # runs beyond are cut up by exact quarters of the fingerprint first


def _forest(x: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is within ``distance`` among ``x``, one per
    fingerprint reached."""
    out, todo = [], np.arange(len(x))
    while len(todo):
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            at = front.pop()
            near = np.bitwise_count(x[todo] ^ x[at]) <= distance
            if near.any():
                got = todo[near]
                out.append((np.full(len(got), x[at]), x[got]))
                front.extend(got.tolist())
                todo = todo[~near]
    return out


def links(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between fingerprints under the same key (rows sorted by key)."""
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[cut, len(keys)])
    u, v = [fps[:0]], [fps[:0]]
    short = np.repeat(size <= WIDE, size)
    for step in range(1, min(WIDE, len(keys))):
        if not (size > step).any():
            break
        hit = (keys[step:] == keys[:-step]) & short[step:] & (np.bitwise_count(fps[step:] ^ fps[:-step]) <= distance)
        u.append(fps[:-step][hit])
        v.append(fps[step:][hit])
    for at, n in zip(cut[size > WIDE], size[size > WIDE], strict=True):
        x = fps[at:at + n]
        if n <= DEEP or distance > 3:
            found = _forest(x, distance)
        else:  # at most three errors leave one of four quarters exact
            found = []
            for quarter in range(4):
                part = (x >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
                order = np.argsort(part, kind="stable")
                for own in np.split(x[order], np.flatnonzero(np.diff(part[order])) + 1):
                    found += _forest(own, distance)
        u += [p for p, _ in found]
        v += [q for _, q in found]
    return np.concatenate(u), np.concatenate(v)


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): links between the distinct fingerprints in column fp that
    connect all those within ``distance`` bits (3 at most)."""
    if distance > 3:
        raise ValueError("the keys cover distances of 3 bits at most")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.column(0).slice(at, 20_000).to_numpy().view(np.uint64)
                row, key = fuzzy_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[row].view(np.int64))],
                                                 names=["key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            u, v = links(k, f, distance)
            low, high = np.minimum(u, v), np.maximum(u, v)
            pair = np.unique(np.stack([low, high], axis=1), axis=0) if len(u) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy().view(np.int64)),
                                               pa.array(pair[:, 1].copy().view(np.int64))], names=["u", "v"])

        for batch in batches:
            k = np.r_[rest_k, batch.column(0).to_numpy()]
            f = np.r_[rest_f, batch.column(1).to_numpy().view(np.uint64)]
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))  # its run may go on in the next batch
            if last:
                yield done(k[:last], f[:last])
            rest_k, rest_f = k[last:], f[last:]
        if len(rest_k):
            yield done(rest_k, rest_f)

    keys = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    # keys are dealt out by hash; sorted, a key's fingerprints follow one another
    dealt = keys.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(linked, "u long, v long")


def _rooted(docs: DataFrame, doc_id: str, text: str, shingle: int, distance: int) -> DataFrame:
    """Per document: doc_id, key, fp, root (the component's smallest fingerprint,
    its identity), component_id (smallest doc_id reachable, repeated or null if
    the ids are)."""
    prints = materialize(fingerprints(docs, doc_id, text, shingle), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = materialize(fingerprint_links(distinct, distance), "links")
    roots = components(edges)
    with_root = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    with_root = materialize(with_root, "roots")
    least = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    of = with_root.join(least, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp").select("doc_id", "key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """Per document: doc_id, key, fp, component_id (smallest doc_id reachable)."""
    return _rooted(docs, doc_id, text, shingle, distance).drop("root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row
    with the smallest doc_id stays (ties: the smallest digest, then one row of
    equal ones). Components whose ids are all null keep one row as well, and
    components that share an id keep one each."""
    found = materialize(_rooted(docs, doc_id, text, shingle, distance), "near-duplicates")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("key"))
    stay = found.groupBy("root").agg(F.min(rank).alias("r")).select(
        F.col("r.doc_id").alias("_id"), F.col("r.key").alias("_key"))
    stay = materialize(stay, "stay")
    same = (text_key(text_of(text)) == stay["_key"]) & docs[doc_id].eqNullSafe(stay["_id"])
    kept = docs.join(stay, same, "left_semi")
    twice = found.groupBy("doc_id", "key").count().where("count > 1").limit(1).count()
    if not twice:
        return kept
    # the row travels as one value, so that none of its columns' names can clash
    whole = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), F.col(doc_id).alias("id"), text_key(text_of(text)).alias("digest"))
    return whole.groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*")

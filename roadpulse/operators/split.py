"""Chronological split (W1, W2), split audits (A7, A8), verified recovery.

The split never sorts the table and never funnels it through one partition.
The n-th row in ``(ts, id)`` order is located exactly by histogram
refinement: each round is one aggregate over a two-column projection,
restricted to the key range that still contains the wanted rank, and brings
back at most ``BUCKETS`` counts per cut. When the range is small the rank is
read with a ``row_number`` over those few rows only. The split itself is then
a per-row comparison against the cut keys — a narrow projection, no shuffle.
Any number of rows may share a timestamp (a hot key): ties are refined on the
id, which is unique, so no bucket ever has to be processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Split fractions; the rest is TEST.
TRAIN_FRAC = 0.70
VAL_FRAC = 0.15

BUCKETS = 1024        # counts brought back per refinement round and cut
SMALL_RANGE = 50_000  # below this many rows a range is ranked directly


def split_sizes(n: int, train_frac: float = TRAIN_FRAC, val_frac: float = VAL_FRAC) -> tuple[int, int, int]:
    """Half-even rounding of the cut sizes (Python ``round``)."""
    n_train = int(round(n * train_frac))
    n_val = int(round(n * val_frac))
    n_train = min(n_train, n)
    n_val = min(n_val, n - n_train)
    return n_train, n_val, n - n_train - n_val


def _keys(df: DataFrame, ts: str, key: str) -> DataFrame:
    return df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("k1"), F.col(key).cast("long").alias("k2"))


def _le(k1: Column, k2: Column, c1: int, c2: int) -> Column:
    return (k1 < F.lit(c1)) | ((k1 == F.lit(c1)) & (k2 <= F.lit(c2)))


class _Range:
    """Rows with k1 in [lo1, hi1] and (when ``fixed``) k1 == lo1, k2 in [lo2, hi2]."""

    def __init__(self, rank, lo1, hi1, lo2=None, hi2=None):
        self.rank, self.lo1, self.hi1, self.lo2, self.hi2 = rank, lo1, hi1, lo2, hi2

    @property
    def on_id(self) -> bool:
        return self.lo2 is not None

    def pred(self) -> Column:
        p = (F.col("k1") >= F.lit(self.lo1)) & (F.col("k1") <= F.lit(self.hi1))
        if self.on_id:
            p = p & (F.col("k2") >= F.lit(self.lo2)) & (F.col("k2") <= F.lit(self.hi2))
        return p

    def width(self) -> int:
        lo, hi = (self.lo2, self.hi2) if self.on_id else (self.lo1, self.hi1)
        return max(1, -(-(hi - lo + 1) // BUCKETS))

    def bucket(self) -> Column:
        lo, c = (self.lo2, "k2") if self.on_id else (self.lo1, "k1")
        # exact integer division (keys may use all 60+ bits; a double would round)
        return F.expr(f"({c} - CAST({lo} AS BIGINT)) div CAST({self.width()} AS BIGINT)")


def nth_keys(df: DataFrame, ts: str, key: str, ranks: list[int]) -> list[tuple[int, int] | None]:
    """Exact ``(unix_micros(ts), id)`` of the rows at the given 1-based ranks."""
    return nth_pairs(_keys(df, ts, key), ranks, ts)


def key_stats(keys: DataFrame, what: str = "k1"):
    stats = keys.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k1").isNull()).alias("nulls"),
                     F.min("k1").alias("lo"), F.max("k1").alias("hi"),
                     F.min("k2").alias("lo2"), F.max("k2").alias("hi2")).first()
    if stats["nulls"]:
        raise ValueError(f"{stats['nulls']} rows have an unparseable or missing '{what}'")
    return stats


def nth_pairs(keys: DataFrame, ranks, what: str = "k1", stats=None) -> list[tuple[int, int] | None]:
    """Exact ``(k1, k2)`` at the given 1-based ranks of ``(k1, k2)`` order;
    ``keys`` has two long columns ``k1`` and ``k2`` (``k2`` unique).
    ``ranks`` may be a function of the row count (one stats job serves both)."""
    stats = stats or key_stats(keys, what)
    n = stats["n"]
    if callable(ranks):
        ranks = ranks(n)
    out: list[tuple[int, int] | None] = [None] * len(ranks)
    active: dict[int, tuple[_Range, int]] = {}
    for i, r in enumerate(ranks):
        if 1 <= r <= n:
            active[i] = (_Range(r, stats["lo"], stats["hi"]), n)
    while active:
        # ranges holding few rows are ranked directly, all cuts in one job
        small = {i: rg for i, (rg, cnt) in active.items() if cnt <= SMALL_RANGE}
        if small:
            parts = []
            for i, rg in small.items():
                w = Window.orderBy("k1", "k2")
                parts.append(keys.where(rg.pred()).withColumn("rn", F.row_number().over(w))
                             .where(F.col("rn") == F.lit(rg.rank)).select(F.lit(i).alias("i"), "k1", "k2"))
            res = parts[0]
            for p in parts[1:]:
                res = res.unionByName(p)
            for row in res.collect():
                out[row["i"]] = (row["k1"], row["k2"])
                active.pop(row["i"])
            continue
        for rg, cnt in active.values():
            if rg.on_id and rg.lo2 == rg.hi2:
                raise ValueError(f"{cnt} rows share one pair ({what}, id); the rank inside them is not defined")
        # one refinement round for every open cut
        tagged = F.array(*[F.when(rg.pred(), F.struct(F.lit(i).alias("i"), rg.bucket().alias("b")))
                           for i, (rg, _) in active.items()])
        hist = (keys.where(F.exists(tagged, lambda x: x.isNotNull()))
                .select(F.explode(F.filter(tagged, lambda x: x.isNotNull())).alias("tb"))
                .groupBy("tb.i", "tb.b").agg(F.count(F.lit(1)).alias("c")).collect())
        per: dict[int, list] = {}
        for row in hist:
            per.setdefault(row["i"], []).append((row["b"], row["c"]))
        nxt = {}
        for i, (rg, _) in active.items():
            w = rg.width()
            before = 0
            for b, c in sorted(per[i]):
                if before + c >= rg.rank:
                    rank = rg.rank - before
                    if rg.on_id:
                        lo = rg.lo2 + b * w
                        nrg = _Range(rank, rg.lo1, rg.hi1, lo, min(rg.hi2, lo + w - 1))
                    else:
                        lo = rg.lo1 + b * w
                        hi = min(rg.hi1, lo + w - 1)
                        nrg = _Range(rank, lo, hi)
                        if lo == hi:  # one timestamp: refine ties on the id
                            nrg = _Range(rank, lo, hi, stats["lo2"], stats["hi2"])
                    nxt[i] = (nrg, c)
                    break
                before += c
        active = nxt
    return out


def chronological_split(df: DataFrame, ts: str = "split_timestamp", key: str = "incident_id",
                        train_frac: float = TRAIN_FRAC, val_frac: float = VAL_FRAC) -> DataFrame:
    """Add ``split`` in {train, val, test} by ``(ts, key)`` order."""
    def ranks(n):
        n_train, n_val, _ = split_sizes(n, train_frac, val_frac)
        return [n_train, n_train + n_val]
    cut1, cut2 = nth_pairs(_keys(df, ts, key), ranks, ts)
    k1 = F.unix_micros(F.col(ts).cast("timestamp"))
    k2 = F.col(key).cast("long")
    expr = F.lit("test")
    if cut2 is not None:
        expr = F.when(_le(k1, k2, *cut2), F.lit("val")).otherwise(expr)
    if cut1 is not None:
        expr = F.when(_le(k1, k2, *cut1), F.lit("train")).otherwise(expr)
    return df.withColumn("split", expr)


def split_ranges(df: DataFrame, ts: str = "split_timestamp") -> DataFrame:
    """N, share, first and last timestamp per split."""
    from pyspark.sql import Window as W
    g = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def straddle_ok(ranges: DataFrame) -> DataFrame:
    """A8 check: train ends no later than val starts, val no later than test."""
    p = ranges.groupBy().pivot("split", ["train", "val", "test"]).agg(F.first(F.struct("ts_min", "ts_max")))
    return p.select((F.coalesce(F.col("train.ts_max") <= F.col("val.ts_min"), F.lit(True)) &
                     F.coalesce(F.col("val.ts_max") <= F.col("test.ts_min"), F.lit(True))).alias("ordered"))


def class_balance(df: DataFrame, label: str = "requires_road_closure", min_pos: int = 10) -> DataFrame:
    """N, positives, negatives, rate and a low-positive warning per split."""
    y = F.col(label).cast("boolean")
    return (df.groupBy("split")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(y).alias("positive"), F.count_if(~y).alias("negative"))
            .withColumn("positive_rate", F.round(F.col("positive") / F.col("n"), 6))
            .withColumn("few_positives", F.col("positive") < F.lit(min_pos)))


# ------------------------------------------------------------ J1 recovery
def alignment_mismatches(left: DataFrame, right: DataFrame, key: str, exclude=(),
                         rtol: float = 1e-6, atol: float = 1e-6) -> DataFrame:
    """J1 gate: per shared column, cells that disagree between two key-aligned frames.

    Floats agree when ``|a-b| <= atol + rtol*|b|``; NULL only equals NULL;
    everything else compares as text. Keys present on one side only count as
    a mismatch in ``__missing_key``. One full outer join on the key.
    """
    shared = [c for c in right.columns if c in left.columns and c != key and c not in exclude]
    ltypes, rtypes = dict(left.dtypes), dict(right.dtypes)
    l = left.select(key, *[F.col(c).alias(f"l__{c}") for c in shared], F.lit(True).alias("l__present"))
    r = right.select(key, *[F.col(c).alias(f"r__{c}") for c in shared], F.lit(True).alias("r__present"))
    j = l.join(r, key, "full_outer")
    aggs = [F.count_if(F.col("l__present").isNull() | F.col("r__present").isNull()).alias("__missing_key")]
    for c in shared:
        a, b = F.col(f"l__{c}"), F.col(f"r__{c}")
        both_null = a.isNull() & b.isNull()
        one_null = a.isNull() != b.isNull()
        if ltypes[c] in ("double", "float") and rtypes[c] in ("double", "float"):
            differ = F.abs(a - b) > F.lit(atol) + F.lit(rtol) * F.abs(b)
        else:
            differ = a.cast("string") != b.cast("string")
        bad = ~both_null & (one_null | F.coalesce(differ, F.lit(False)))
        aggs.append(F.count_if(bad & F.col("l__present").isNotNull() & F.col("r__present").isNotNull()).alias(c))
    return j.agg(*aggs)


def recover_column(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Attach ``column`` from ``source`` after the alignment gate passes."""
    mism = alignment_mismatches(target, source, key, exclude=(column,)).first().asDict()
    total = sum(mism.values())
    if total:
        raise ValueError(f"refusing to recover {column!r}: {total} mismatched cells {mism}")
    return target.join(source.select(key, column), key, "left")


POSITION = "__row_number"


def positional_mismatches(target: DataFrame, source: DataFrame, exclude=()) -> DataFrame:
    """J1 gate for files without a key: ``target`` and ``source`` carry their rows'
    numbers in file order (``POSITION``). Rows one file has and the other lacks
    count in ``__missing_key``; per shared column, cells that disagree."""
    return alignment_mismatches(target, source, POSITION, exclude)


def recover_by_position(target: DataFrame, source: DataFrame, column: str) -> DataFrame:
    """``column`` of ``source`` attached to the row of the same number, after
    the gate. Files of different lengths or with cells that disagree raise, with the counts."""
    mism = positional_mismatches(target, source, exclude=(column,)).first().asDict()
    missing = mism.pop("__missing_key")
    if missing:
        raise ValueError(f"refusing to recover {column!r} by position: {missing} rows have no counterpart, the files differ in length")
    total = sum(mism.values())
    if total:
        raise ValueError(f"refusing to recover {column!r} by position: {total} mismatched cells {mism}; the files are not row-aligned")
    return target.join(source.select(POSITION, column), POSITION, "left").drop(POSITION)

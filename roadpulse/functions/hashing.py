"""Order-free seeded randomness from md5.

Spark gives no cross-engine RNG parity, so every seeded choice is a rank by
``md5(seed:key)``: deterministic, independent of partitioning and plan, and
reproducible in SQL (DuckDB: ``('0x'||substr(md5(x),1,8))::bigint``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_key(seed, *parts) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts])


def seeded_hash(seed, *parts) -> Column:
    """32-bit unsigned integer from the first 8 hex digits of md5."""
    return F.conv(F.substring(F.md5(seeded_key(seed, *parts)), 1, 8), 16, 10).cast("long")


def seeded_hash_sql(seed, *parts: str) -> str:
    key = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def seeded_order(seed, *parts) -> Column:
    """Full md5 hex as a sort key (ties impossible in practice, id breaks them)."""
    return F.md5(seeded_key(seed, *parts))


def seeded_order_sql(seed, *parts: str) -> str:
    key = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5({key})"


def fold_of(seed, key, n_folds: int) -> Column:
    """Fold 0..n_folds-1."""
    return F.pmod(seeded_hash(seed, key), F.lit(n_folds))

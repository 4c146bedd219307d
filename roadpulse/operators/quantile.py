"""Quantile-rank transform (M11, M12): uniform output, fitted on TRAIN only.

Fit takes the exact quantiles (``order_stats``) at ``m`` even probabilities
(``m = min(1000, n)``), whatever the size of the table; its output — at most 1000 doubles — is the fitted
model and is held on the driver like any ML model parameter. Transform finds
the rank of a value among the
distinct cut values with ``Bucketizer`` (JVM binary search) and reads the run
positions of its interval through a broadcast join with a table of at most
``m + 1`` rows — no per-row array scan, no array literal in row expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.order_stats import exact_quantiles, number

# Default number of cut points and the clamp tolerance.
N_QUANTILES = 1000
BOUNDS_THRESHOLD = 1e-7


def reference_probs(m: int) -> list[float]:
    """Evenly spaced probabilities 0..1 (m points)."""
    if m == 1:
        return [0.0]
    step = 1.0 / (m - 1)
    return [min(1.0, i * step) for i in range(m)]


@dataclass
class QuantileModel:
    column: str
    quantiles: list[float]

    @property
    def m(self) -> int:
        return len(self.quantiles)


def fit_quantiles(df: DataFrame, cols: list[str], n_quantiles: int = N_QUANTILES) -> dict[str, QuantileModel]:
    """Exact cut points per column (linear interpolation); ``m =
    min(n_quantiles, rows)``. All columns are fitted in one pass. NaN is NULL."""
    def probs(n: int) -> list[float]:
        if n == 0:
            raise ValueError("cannot fit quantiles on an empty table")
        return reference_probs(min(n_quantiles, n))

    found = {r["name"]: r["q"] for r in exact_quantiles(df, {c: c for c in cols}, probs).collect()}
    out = {}
    for c in cols:
        if c not in found:
            raise ValueError(f"column {c!r} has no value to fit quantiles on")
        qs, run = [], -math.inf
        for v in found[c]:
            run = max(run, v)  # keep the cut points monotone
            qs.append(run)
        out[c] = QuantileModel(c, qs)
    return out


def interval_table(spark, model: QuantileModel) -> DataFrame:
    """One row per interval between distinct cut values (at most m + 1 rows).

    Interval ``b`` lies between distinct values ``u[b-1]`` and ``u[b]``; it
    carries the first/last position of the run of ``u[b-1]`` among the cut
    points and the first position of ``u[b]``.
    """
    runs: list[list] = []  # [value, first, last]
    for i, v in enumerate(model.quantiles):
        if runs and runs[-1][0] == v:
            runs[-1][2] = i
        else:
            runs.append([v, i, i])
    rows = []
    for b in range(len(runs) + 1):
        lo = runs[b - 1] if b >= 1 else [None, None, None]
        hi = runs[b] if b < len(runs) else [None, None, None]
        rows.append((float(b), lo[0], lo[1], lo[2], hi[0], hi[1]))
    return spark.createDataFrame(rows, "b double, lo_val double, lo_first int, lo_last int, hi_val double, hi_first int")


def add_quantile_ranks(df: DataFrame, specs: list[tuple[str, QuantileModel, str]]) -> DataFrame:
    """Add uniform quantile ranks in [0, 1] for ``(input, model, output)``.

    Below the first cut point (within 1e-7) -> 0, above the last -> 1 (the low
    clamp wins for a constant column). A value equal to a run of tied cut
    points maps to the middle of the run; between two points, linear
    interpolation. NULL stays NULL, NaN becomes NULL.

    Each value is placed among the distinct cut values by ``Bucketizer`` (a
    JVM binary search), then a broadcast equi-join on the interval number
    brings the run positions. The broadcast side is the interval table, at
    most ``n_quantiles + 1`` rows whatever the data size.
    """
    from pyspark.ml.feature import Bucketizer

    spark = df.sparkSession
    for n, (x, model, name) in enumerate(specs):
        m = model.m
        distinct = sorted(set(model.quantiles))
        b, filled = f"__b{n}", f"__x{n}"
        df = df.withColumn(filled, F.coalesce(number(x), F.lit(0.0)))
        df = Bucketizer(splits=[-math.inf] + distinct + [math.inf], inputCol=filled, outputCol=b).transform(df)
        t = interval_table(spark, model)
        t = t.select(*[F.col(c).alias(f"{c}{n}") for c in t.columns])
        df = df.join(F.broadcast(t), F.col(b) == F.col(f"b{n}"), "left")
        xc = number(x)
        denom = F.lit(float(max(m - 1, 1)))
        lo_val, lo_first, lo_last = F.col(f"lo_val{n}"), F.col(f"lo_first{n}"), F.col(f"lo_last{n}")
        hi_val = F.col(f"hi_val{n}")
        inside = (F.when(xc == lo_val, (lo_first + lo_last).cast("double") / F.lit(2.0) / denom)
                  .otherwise((lo_last.cast("double") + (xc - lo_val) / (hi_val - lo_val)) / denom))
        rank = (F.when(xc.isNull(), F.lit(None).cast("double"))
                .when(xc - F.lit(BOUNDS_THRESHOLD) < F.lit(model.quantiles[0]), F.lit(0.0))
                .when(xc + F.lit(BOUNDS_THRESHOLD) > F.lit(model.quantiles[-1]), F.lit(1.0))
                .otherwise(inside))
        df = df.withColumn(name, rank).drop(b, filled, *t.columns)
    return df


def quantile_rank_sql(x: str, qlist: str, m_expr: str) -> str:
    """Oracle form over a DuckDB list ``qlist`` with ``m_expr`` points."""
    le = f"(len(list_filter({qlist}, lambda v: v <= {x})) - 1)"
    ge = f"({m_expr} - len(list_filter({qlist}, lambda v: v >= {x})))"
    inside = (f"CASE WHEN {ge} <= {le} THEN ({ge} + {le}) / 2.0e0 / ({m_expr} - 1) "
              f"ELSE ({le} + ({x} - {qlist}[{le} + 1]) / ({qlist}[{ge} + 1] - {qlist}[{le} + 1])) / ({m_expr} - 1) END")
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} - 1e-7 < {qlist}[1] THEN 0.0e0 "
            f"WHEN {x} + 1e-7 > {qlist}[{m_expr}] THEN 1.0e0 ELSE {inside} END")


def model_frame(spark, models: dict[str, QuantileModel]) -> DataFrame:
    """The fitted scorer as a one-row table (persist with ``write.parquet``)."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in models])
    return spark.createDataFrame([tuple(models[c].quantiles for c in models)], schema)


def models_from_frame(df: DataFrame) -> dict[str, QuantileModel]:
    row = df.first()
    return {c: QuantileModel(c, list(row[c])) for c in df.columns}

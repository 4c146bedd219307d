"""Profiling aggregates.

Single aggregates over the input plan (partial aggregation on the map side,
one small shuffle); quantiles are exact for groups of any size and come from
``order_stats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.risk import round_half_even
from roadpulse.operators.order_stats import exact_quantiles
from roadpulse.session import stored

SUMMARY_PROBS = (0.25, 0.5, 0.75)


def missingness(df: DataFrame, digits: int = 2) -> DataFrame:
    """A1: % NULL per column (>0 only), one wide aggregate then unpivot."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stacked = wide.unpivot("__n", cols, "column_name", "n_missing")
    return (stacked.where(F.col("n_missing") > 0)
            .select("column_name",
                    round_half_even(F.col("n_missing") * 100.0 / F.col("__n"), digits).alias("pct_missing")))


def value_shares(df: DataFrame, col: str, domain: list) -> DataFrame:
    """A2: count and share per value, zero-filled over a fixed domain."""
    from pyspark.sql import Window
    dom = df.sparkSession.createDataFrame([(v,) for v in domain], [col])
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    # the total is taken over the aggregated rows (one per value), so the
    # unpartitioned window only ever sees the small per-value table
    counts = counts.withColumn("__total", F.sum("n").over(Window.partitionBy()))
    return (F.broadcast(dom).join(counts, col, "left")
            .select(col, F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                    F.round(F.coalesce(F.col("n") / F.col("__total"), F.lit(0.0)), 6).alias("share")))


def distribution_summary(df: DataFrame, col: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """A3: n, min, p25, median, mean, p75, max, sample std (linear quantiles)."""
    by = by or []
    df = stored(df.select(*by, col))  # two aggregates follow: the input is computed once
    q = exact_quantiles(df, {"q": col}, SUMMARY_PROBS, by).select(*[F.col(b).alias(f"__{b}") for b in by], F.col("q").alias("__q"))
    aggs = [F.count(col).alias("n"), F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max"),
            F.stddev_samp(col).alias("std")]
    if by:
        same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
        g = df.groupBy(*by).agg(*aggs).join(q, same, "left")
    else:  # two one-row tables side by side
        one = lambda t: t.withColumn("__one", F.lit(1))
        g = one(df.agg(*aggs)).join(F.broadcast(one(q)), "__one", "left")
    r = lambda c: F.round(c, digits)
    return g.select(*by, "n", r(F.col("min")).alias("min"), r(F.col("__q")[0]).alias("p25"),
                    r(F.col("__q")[1]).alias("p50"), r(F.col("mean")).alias("mean"),
                    r(F.col("__q")[2]).alias("p75"), r(F.col("max")).alias("max"),
                    r(F.col("std")).alias("std"))


def duplicate_count(df: DataFrame, col: str) -> DataFrame:
    """A5: rows whose key value already occurred (count - count distinct)."""
    per_key = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
                       F.count(F.lit(1)).alias("n_distinct"))


def skewness_corrected(df: DataFrame, col: str) -> Column:
    """Bias-corrected sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2);
    NULL for fewer than three values."""
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def distinct_levels(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Number of distinct non-null values per column."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[f(c).alias(f"n_{c}") for c in cols])


def null_share(col: str) -> Column:
    """A15."""
    return F.avg(F.col(col).isNull().cast("double"))


def quantile_pick(df: DataFrame, col: str, probs) -> DataFrame:
    """One row per requested probability (pooled quantiles)."""
    q = exact_quantiles(df, {"q": col}, probs)
    rows = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.col("q")[i].alias("value"))
                     for i, p in enumerate(probs)])
    return q.select(F.inline(rows))

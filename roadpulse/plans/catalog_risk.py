"""Catalogue: quantile rank and cascade risk score."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse.functions import risk as rf
from roadpulse.operators import profile, split
from roadpulse.operators.order_stats import exact_quantiles
from roadpulse.operators.quantile import (N_QUANTILES, add_quantile_ranks, fit_quantiles, quantile_rank_sql,
                                          reference_probs)
from roadpulse.operators.risk import RiskScorer, band_by_range_join
from roadpulse.plans.adapters import X5_SQL, x5_scored
from roadpulse.plans.catalog_split import split_sql
from roadpulse.plans.registry import query

# The oracle's probability list is literal; at the checked scales TRAIN holds
# more than 1000 rows, so m = 1000 there (the Spark side derives m from data).
_PROBS = "[" + ", ".join(f"{p!r}::DOUBLE" for p in reference_probs(N_QUANTILES)) + "]"

X5_SPLIT_SQL = split_sql(f"WITH src AS ({X5_SQL})", "split_timestamp", "incident_id")
FIT_SQL = f"""{X5_SPLIT_SQL},
  fit AS (SELECT quantile_cont(resolution_minutes, {_PROBS}) AS qt,
                 quantile_cont(centrality_score, {_PROBS}) AS qc FROM split_rows WHERE split = 'train'),
  normed AS (SELECT s.*, CASE WHEN closure_probability IS NULL THEN NULL
                              ELSE least(greatest(closure_probability, 0e0), 1e0) END AS p_raw,
                    {quantile_rank_sql('predicted_resolution_minutes', 'qt', str(N_QUANTILES))} AS t_raw,
                    {quantile_rank_sql('centrality_score', 'qc', str(N_QUANTILES))} AS c_raw
             FROM split_rows s, fit),
  scored AS (SELECT *, 0.5e0 * t_raw + 0.5e0 * c_raw AS i_raw,
                    100.0e0 * sqrt(p_raw * (0.5e0 * t_raw + 0.5e0 * c_raw)) AS s_raw FROM normed),
  final AS (SELECT *, {rf.round_half_even_sql('p_raw', 4)} AS p_norm, {rf.round_half_even_sql('t_raw', 4)} AS t_norm,
                   {rf.round_half_even_sql('c_raw', 4)} AS c_norm, {rf.round_half_even_sql('i_raw', 4)} AS impact,
                   {rf.round_half_even_sql('s_raw', 2)} AS cascade_risk_score FROM scored),
  banded AS (SELECT *, {rf.band_sql('cascade_risk_score', 2)} AS priority,
                    {rf.band_sql('cascade_risk_score', 3)} AS recommended_action FROM final)"""


def x5_with_split(spark, sf_dir):
    return split.chronological_split(x5_scored(spark, sf_dir))


def scored_x5(spark, sf_dir):
    """X5 rows with split and score; the scorer is fitted on TRAIN rows only."""
    df = x5_with_split(spark, sf_dir)
    scorer = RiskScorer().fit(df.where(F.col("split") == "train"))
    return scorer.score(df)


@query("quantile_fit", f"""{X5_SPLIT_SQL},
  fit AS (SELECT quantile_cont(resolution_minutes, {_PROBS}) AS qt,
                 quantile_cont(centrality_score, {_PROBS}) AS qc FROM split_rows WHERE split = 'train')
SELECT i - 1 AS i, round(qt[i], 6) AS time_q, round(qc[i], 6) AS centrality_q
FROM fit, range(1, len(qt) + 1) r(i)""")
def q_quantile_fit(spark, sf_dir):
    df = x5_with_split(spark, sf_dir).where(F.col("split") == "train")
    q = exact_quantiles(df, {"qt": "resolution_minutes", "qc": "centrality_score"},
                        lambda n: reference_probs(min(N_QUANTILES, n)))
    fit = q.agg(*[F.max(F.when(F.col("name") == c, F.col("q"))).alias(c) for c in ("qt", "qc")])
    return (fit.select(F.posexplode(F.arrays_zip("qt", "qc")).alias("i", "z"))
            .select(F.col("i").cast("long").alias("i"), F.round("z.qt", 6).alias("time_q"),
                    F.round("z.qc", 6).alias("centrality_q")))


@query("quantile_rank", f"""{FIT_SQL}
SELECT incident_id, round(t_raw, 6) AS t_rank, round(c_raw, 6) AS c_rank FROM normed""")
def q_quantile_rank(spark, sf_dir):
    df = x5_with_split(spark, sf_dir)
    models = fit_quantiles(df.where(F.col("split") == "train"), ["resolution_minutes", "centrality_score"])
    r = add_quantile_ranks(df, [("predicted_resolution_minutes", models["resolution_minutes"], "t_rank"),
                                ("centrality_score", models["centrality_score"], "c_rank")])
    return r.select("incident_id", F.round("t_rank", 6).alias("t_rank"), F.round("c_rank", 6).alias("c_rank"))


@query("cascade_risk_score", f"""{FIT_SQL}
SELECT incident_id, split, p_norm, t_norm, c_norm, impact, cascade_risk_score, priority, recommended_action
FROM banded""")
def q_cascade_risk_score(spark, sf_dir):
    return scored_x5(spark, sf_dir).select("incident_id", "split", "p_norm", "t_norm", "c_norm", "impact",
                                           "cascade_risk_score", "priority", "recommended_action")


@query("risk_bands", f"""{FIT_SQL}
SELECT priority, count(*) AS n, round(min(cascade_risk_score), 6) AS min_score,
       round(max(cascade_risk_score), 6) AS max_score FROM banded GROUP BY priority""")
def q_risk_bands(spark, sf_dir):
    """Band via the broadcast range join; counted per band."""
    s = scored_x5(spark, sf_dir).select("incident_id", "cascade_risk_score")
    b = band_by_range_join(s)
    return b.groupBy("priority").agg(F.count(F.lit(1)).alias("n"),
                                     F.round(F.min("cascade_risk_score"), 6).alias("min_score"),
                                     F.round(F.max("cascade_risk_score"), 6).alias("max_score"))


# Pooled quantile picks used by the worked examples.
POOL_MINUTES_PROBS = (0.92, 0.10, 0.90, 0.15, 0.20, 0.93)
POOL_CENTRALITY_PROBS = (0.95, 0.08, 0.93, 0.90, 0.10, 0.07)


def _pool_sql(col, probs, name):
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS measure, {p!r}::DOUBLE AS prob, round(quantile_cont({col}, {p!r}::DOUBLE), 6) AS value FROM pool"
        for p in probs)
    return parts


@query("pooled_quantiles", f"""{X5_SPLIT_SQL}, pool AS (SELECT * FROM split_rows WHERE split IN ('val', 'test'))
{_pool_sql('resolution_minutes', POOL_MINUTES_PROBS, 'minutes')} UNION ALL
{_pool_sql('centrality_score', POOL_CENTRALITY_PROBS, 'centrality')}""")
def q_pooled_quantiles(spark, sf_dir):
    """U1 + A17: VAL and TEST pooled (union all), then the fixed quantile picks."""
    df = x5_with_split(spark, sf_dir)
    pool = df.where(F.col("split") == "val").unionByName(df.where(F.col("split") == "test"))
    a = profile.quantile_pick(pool, "resolution_minutes", POOL_MINUTES_PROBS).withColumn("measure", F.lit("minutes"))
    b = profile.quantile_pick(pool, "centrality_score", POOL_CENTRALITY_PROBS).withColumn("measure", F.lit("centrality"))
    return a.unionByName(b).select("measure", "prob", F.round("value", 6).alias("value"))

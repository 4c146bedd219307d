"""Catalogue: lifecycle cleaning and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse.functions import timefn
from roadpulse.operators import clean, profile
from roadpulse.plans.adapters import X1_SQL, X2_SQL, x1_lifecycle, x2_incidents
from roadpulse.plans.registry import query

# The driver's dates are random, so the adapter uses a one-year window.
YEAR_MIN = 525600.0

W1 = f"WITH x1 AS ({X1_SQL})"
W2 = f"WITH x2 AS ({X2_SQL})"
RES_SQL = ("(epoch_us(coalesce(resolved_datetime, closed_datetime)) - epoch_us(start_datetime)) / 6e7")
CLEAN_SQL = f"""
  SELECT *, {RES_SQL} AS resolution_minutes,
         CASE WHEN event_type = 'planned' THEN 1 ELSE 0 END AS is_planned,
         lower(regexp_replace(event_cause, '^\\s+|\\s+$', '', 'g')) AS cause,
         coalesce(veh_type, 'unknown') AS veh_filled
  FROM x1"""
KEPT_SQL = f"""{W1}, c AS ({CLEAN_SQL})
  , kept AS (SELECT * FROM c WHERE resolution_minutes IS NOT NULL AND resolution_minutes >= 0
                                  AND resolution_minutes <= {YEAR_MIN!r}e0)"""


def cleaned_x1(spark, sf_dir):
    return clean.clean_pipeline(x1_lifecycle(spark, sf_dir), hi=YEAR_MIN)


@query("resolution_minutes", f"{W1} SELECT incident_id, round({RES_SQL}, 6) AS resolution_minutes FROM x1")
def q_resolution_minutes(spark, sf_dir):
    df = clean.with_resolution_minutes(x1_lifecycle(spark, sf_dir))
    return df.select("incident_id", F.round("resolution_minutes", 6).alias("resolution_minutes"))


@query("resolution_filter", f"{KEPT_SQL} SELECT incident_id, round(resolution_minutes, 6) AS resolution_minutes FROM kept")
def q_resolution_filter(spark, sf_dir):
    df = clean.filter_resolution_window(clean.with_resolution_minutes(x1_lifecycle(spark, sf_dir)), hi=YEAR_MIN)
    return df.select("incident_id", F.round("resolution_minutes", 6).alias("resolution_minutes"))


@query("rejection_counts", f"""{W1}, c AS (SELECT {RES_SQL} AS r FROM x1)
SELECT count(*) AS n_before_filter, CAST(count_if(r IS NULL) AS BIGINT) AS removed_no_end, CAST(count_if(r < 0) AS BIGINT) AS removed_negative,
       CAST(count_if(r > {YEAR_MIN!r}e0) AS BIGINT) AS removed_over_window,
       CAST(count_if(r IS NOT NULL AND r >= 0 AND r <= {YEAR_MIN!r}e0) AS BIGINT) AS n_after_filter,
       round(CAST(count_if(r IS NOT NULL AND r >= 0 AND r <= {YEAR_MIN!r}e0) AS BIGINT) * 100.0e0 / count(*), 6) AS retention_pct
FROM c""")
def q_rejection_counts(spark, sf_dir):
    return clean.rejection_counts(clean.with_resolution_minutes(x1_lifecycle(spark, sf_dir)), hi=YEAR_MIN)


@query("temporal_features", f"""{W2}
SELECT incident_id, hour(split_timestamp + INTERVAL 330 MINUTE) AS hour_of_day,
       isodow(split_timestamp + INTERVAL 330 MINUTE) - 1 AS day_of_week,
       month(split_timestamp + INTERVAL 330 MINUTE) AS month,
       strftime(split_timestamp + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS local_time
FROM x2""")
def q_temporal_features(spark, sf_dir):
    df = clean.with_temporal_features(x2_incidents(spark, sf_dir).withColumnRenamed("split_timestamp", "utc_ts"),
                                      ts="utc_ts")
    return df.select("incident_id", "hour_of_day", "day_of_week", "month",
                     timefn.ts_text("split_timestamp").alias("local_time"))


@query("normalise_fill", f"""{W1}, c AS ({CLEAN_SQL})
SELECT incident_id, is_planned, cause AS event_cause, veh_filled AS veh_type FROM c""")
def q_normalise_fill(spark, sf_dir):
    df = x1_lifecycle(spark, sf_dir)
    df = clean.fill_categoricals(clean.normalise_event_cause(clean.with_planned_flag(df)))
    return df.select("incident_id", "is_planned", "event_cause", "veh_type")


def _missing_sql(cols, src):
    parts = [f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS m, count(*) AS n FROM {src}" for c in cols]
    return (f"SELECT column_name, round_even(m * 100.0e0 / n * 100, 0)::DOUBLE / 100 AS pct_missing "
            f"FROM ({' UNION ALL '.join(parts)}) WHERE m > 0")


_X1_COLS = ["incident_id", "start_datetime", "resolved_datetime", "closed_datetime", "event_type",
            "event_cause", "veh_type", "end_ts", "resolution_minutes"]


@query("missingness_profile", f"""{W1}, c AS (SELECT *, coalesce(resolved_datetime, closed_datetime) AS end_ts,
   {RES_SQL} AS resolution_minutes FROM x1) {_missing_sql(_X1_COLS, 'c')}""")
def q_missingness_profile(spark, sf_dir):
    return profile.missingness(clean.with_resolution_minutes(x1_lifecycle(spark, sf_dir)))


@query("value_shares", f"""{KEPT_SQL}
SELECT d.is_planned, coalesce(k.n, 0)::BIGINT AS n,
       round(coalesce(k.n, 0) / (SELECT count(*) FROM kept)::DOUBLE, 6) AS share
FROM (VALUES (0), (1)) d(is_planned) LEFT JOIN (SELECT is_planned, count(*) AS n FROM kept GROUP BY 1) k
  USING (is_planned)""")
def q_value_shares(spark, sf_dir):
    return profile.value_shares(cleaned_x1(spark, sf_dir), "is_planned", [0, 1])


_SUMMARY_SQL = """count(resolution_minutes) AS n, round(min(resolution_minutes), 6) AS min,
       round(quantile_cont(resolution_minutes, 0.25), 6) AS p25, round(quantile_cont(resolution_minutes, 0.5), 6) AS p50,
       round(avg(resolution_minutes), 6) AS mean, round(quantile_cont(resolution_minutes, 0.75), 6) AS p75,
       round(max(resolution_minutes), 6) AS max, round(stddev_samp(resolution_minutes), 6) AS std"""


@query("distribution_summary", f"{KEPT_SQL} SELECT cause AS event_cause, {_SUMMARY_SQL} FROM kept GROUP BY cause")
def q_distribution_summary(spark, sf_dir):
    """Flagship: resolution-time distribution by cause after cleaning."""
    return profile.distribution_summary(cleaned_x1(spark, sf_dir), "resolution_minutes", by=["event_cause"])


@query("distribution_overall", f"{KEPT_SQL} SELECT {_SUMMARY_SQL} FROM kept")
def q_distribution_overall(spark, sf_dir):
    return profile.distribution_summary(cleaned_x1(spark, sf_dir), "resolution_minutes")


@query("skewness_corrected", f"""{W2}
SELECT count(resolution_minutes) AS n, round(skewness(resolution_minutes), 6) AS skew FROM x2""")
def q_skewness_corrected(spark, sf_dir):
    df = x2_incidents(spark, sf_dir)
    return df.agg(F.count("resolution_minutes").alias("n"),
                  F.round(profile.skewness_corrected(df, "resolution_minutes"), 6).alias("skew"))


@query("duplicate_timestamps", f"""{W1}
SELECT (count(start_datetime) - count(DISTINCT start_datetime))::BIGINT AS n_duplicates,
       count(DISTINCT start_datetime) AS n_distinct FROM x1""")
def q_duplicate_timestamps(spark, sf_dir):
    return profile.duplicate_count(x1_lifecycle(spark, sf_dir), "start_datetime")


@query("distinct_levels", f"""{W2}
SELECT count(DISTINCT junction) AS n_junction, count(DISTINCT corridor) AS n_corridor,
       avg(CASE WHEN junction IS NULL THEN 1e0 ELSE 0e0 END) AS junction_null_share FROM x2""")
def q_distinct_levels(spark, sf_dir):
    df = x2_incidents(spark, sf_dir)
    return df.agg(F.count_distinct("junction").alias("n_junction"),
                  F.count_distinct("corridor").alias("n_corridor"),
                  profile.null_share("junction").alias("junction_null_share"))


@query("fill_counts", f"""{KEPT_SQL}
SELECT CAST(count_if(veh_type IS NULL) AS BIGINT) AS veh_type FROM kept""")
def q_fill_counts(spark, sf_dir):
    df = clean.filter_resolution_window(clean.with_resolution_minutes(x1_lifecycle(spark, sf_dir)), hi=YEAR_MIN)
    return clean.fill_counts(df)


_FINAL_COLS = ["incident_id", "event_cause", "veh_type", "resolution_minutes", "is_planned", "hour_of_day",
               "day_of_week", "month", "split_timestamp"]


@query("missingness_final", f"""{KEPT_SQL},
  f AS (SELECT incident_id, cause AS event_cause, veh_filled AS veh_type, resolution_minutes, is_planned,
               hour(start_datetime + INTERVAL 330 MINUTE) AS hour_of_day, start_datetime AS split_timestamp,
               isodow(start_datetime + INTERVAL 330 MINUTE) - 1 AS day_of_week,
               month(start_datetime + INTERVAL 330 MINUTE) AS month,
               CASE WHEN incident_id % 9 <> 0 THEN 1e0 END AS centrality_score FROM kept)
{_missing_sql([*_FINAL_COLS, 'centrality_score'], 'f')}""")
def q_missingness_final(spark, sf_dir):
    """A1 on the modelling-ready table (after window, flags, fills), where only
    rows that were not snapped lack something."""
    return profile.missingness(cleaned_x1(spark, sf_dir).select(
        *_FINAL_COLS, F.when(F.col("incident_id") % 9 != 0, F.lit(1.0)).alias("centrality_score")))

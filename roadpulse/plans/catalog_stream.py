"""Catalogue: streaming jobs checked against their batch twins (ST1-ST4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roadpulse.functions import risk as rf
from roadpulse.operators.risk import RiskScorer
from roadpulse.plans.adapters import X2_SQL
from roadpulse.plans.catalog_risk import FIT_SQL, x5_with_split
from roadpulse.plans.registry import query
from roadpulse.session import scratch_path
from roadpulse.sources.tables import table
from roadpulse.streaming import jobs


def _x5_stream(spark, sf_dir):
    """The X5 shape over a file stream of the events table."""
    e = jobs.file_stream(spark, sf_dir, "events.parquet")
    j = F.substring(F.concat(F.lit("J"), F.col("user_id")), 2, 1 << 20).cast("long")
    return e.select(
        F.col("event_id").alias("incident_id"),
        F.col("ts").cast("timestamp").alias("split_timestamp"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("event_type").alias("event_cause"),
        F.concat(F.lit("Z"), F.col("user_id") % 10).alias("zone"),
        F.concat(F.lit("C"), F.col("user_id") % 23).alias("corridor"),
        (F.lit(12.65) + ((F.col("event_id") * 7919) % 7000).cast("double") / F.lit(1e4)).alias("latitude"),
        (F.lit(77.25) + ((F.col("event_id") * 104729) % 7000).cast("double") / F.lit(1e4)).alias("longitude"),
        F.col("value").alias("resolution_minutes"),
        (F.col("value") / (F.col("value") + F.lit(60.0))).alias("closure_probability"),
        (F.col("value") * F.lit(0.8) + F.lit(10.0)).alias("predicted_resolution_minutes"),
        ((j * j) % 997).cast("double").__truediv__(F.lit(15000.0)).alias("centrality_score"))


def _scorer(spark, sf_dir):
    df = x5_with_split(spark, sf_dir)
    return RiskScorer().fit(df.where(F.col("split") == "train"))


@query("stream_score", f"""{FIT_SQL}
SELECT 'INC-' || CAST(incident_id AS VARCHAR) AS id, corridor, cascade_risk_score AS crs, priority,
       {rf.round_half_even_sql('closure_probability', 3)} AS closure_prob FROM banded""")
def q_stream_score(spark, sf_dir):
    """ST1: each arriving event is scored with the TRAIN-fitted scorer and appended."""
    out = jobs.new_run_dir(spark, "score")
    jobs.run_available_now(jobs.score_stream(_x5_stream(spark, sf_dir), _scorer(spark, sf_dir)), out)
    return spark.read.parquet(f"{out}/data").select("id", "corridor", "crs", "priority", "closure_prob")


@query("stream_corridors", f"""{FIT_SQL}
SELECT corridor, round(sum(cascade_risk_score), 6) AS total_crs, count(*) AS count FROM banded GROUP BY corridor""")
def q_stream_corridors(spark, sf_dir):
    """ST2: running corridor roll-up (complete mode, state in the checkpoint)."""
    out = jobs.new_run_dir(spark, "corridors")
    q = jobs.score_stream(_x5_stream(spark, sf_dir), _scorer(spark, sf_dir))
    jobs.run_available_now(jobs.corridor_totals(q), out, mode="complete", batch_fn=jobs.overwrite_batch)
    return spark.read.parquet(f"{out}/data").select("corridor", F.round("total_crs", 6).alias("total_crs"), "count")


@query("stream_hours", f"""WITH x2 AS ({X2_SQL})
SELECT strftime(date_trunc('hour', split_timestamp), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n
FROM x2 GROUP BY 1""")
def q_stream_hours(spark, sf_dir):
    """ST3: 1-hour tumbling windows on event time; update mode, so that the
    watermark frees the state of closed windows."""
    out = jobs.new_run_dir(spark, "hours")
    jobs.run_available_now(jobs.hourly_counts(_x5_stream(spark, sf_dir)), out, mode="update", batch_fn=jobs.upsert_batch)
    return jobs.latest(spark.read.parquet(f"{out}/data"), ["window_start"], ["n"]).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query("stream_dedup", """SELECT DISTINCT event_id AS incident_id FROM events""")
def q_stream_dedup(spark, sf_dir):
    """ST4: every event is submitted twice (two streams over the same file);
    the guard keeps one row per id."""
    a = _x5_stream(spark, sf_dir).select("incident_id", "event_time")
    b = _x5_stream(spark, sf_dir).select("incident_id", "event_time")
    out = jobs.new_run_dir(spark, "dedup")
    jobs.run_available_now(jobs.dedup(a.unionByName(b), "incident_id"), out)
    return spark.read.parquet(f"{out}/data").select("incident_id")


def _two_deliveries(spark, sf_dir, again: str):
    """The events as two deliveries, cut in the middle of their time; the second
    one also repeats rows of the first: ``again`` says which, given ``event_time``
    and the first delivery's end ``last``."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("incident_id"), F.col("ts").cast("timestamp").alias("event_time"))
    span = e.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b"))
    cut = span.select(F.timestamp_micros(F.expr("(unix_micros(a) + unix_micros(b)) div 2")).alias("cut")).first()["cut"]
    first = e.where(F.col("event_time") < F.lit(cut))
    last = first.agg(F.max("event_time").alias("last")).first()["last"]
    repeated = first.withColumn("last", F.lit(last)).where(again).drop("last")
    return first, e.where(F.col("event_time") >= F.lit(cut)).unionByName(repeated)


@query("stream_resume_dedup", "SELECT event_id AS incident_id FROM events")
def q_stream_resume_dedup(spark, sf_dir):
    """ST4 stopped and resumed: the second run gets new events and the whole first
    delivery again. What is inside the watermark is known from the recovered
    state, what is behind it is late; each event passes once."""
    out, folder = jobs.new_run_dir(spark, "resume-dedup"), scratch_path(spark, f"arrivals/{uuid.uuid4().hex}")
    for rows in _two_deliveries(spark, sf_dir, "true"):
        rows.write.mode("append").parquet(folder)
        jobs.resume(spark, folder, rows.schema, lambda s: jobs.dedup(s, "incident_id"), out)
    return spark.read.parquet(f"{out}/data").select("incident_id")


@query("stream_resume_hours", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n
FROM events GROUP BY 1""")
def q_stream_resume_hours(spark, sf_dir):
    """ST3 stopped inside an hour and resumed: that hour's count goes on from the
    recovered state; repeated rows of closed hours are late and count nowhere."""
    out, folder = jobs.new_run_dir(spark, "resume-hours"), scratch_path(spark, f"arrivals/{uuid.uuid4().hex}")
    for rows in _two_deliveries(spark, sf_dir, "event_time < last - INTERVAL 3 HOURS"):
        rows.write.mode("append").parquet(folder)
        jobs.resume(spark, folder, rows.schema, jobs.hourly_counts, out, "update", jobs.upsert_batch)
    return jobs.latest(spark.read.parquet(f"{out}/data"), ["window_start"], ["n"]).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")

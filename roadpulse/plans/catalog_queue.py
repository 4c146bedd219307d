"""Catalogue: dispatch queue, KPIs, roll-ups and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse.functions import risk as rf
from roadpulse.functions import text
from roadpulse.operators import queue
from roadpulse.plans.adapters import X5_SQL
from roadpulse.plans.catalog_risk import FIT_SQL, scored_x5
from roadpulse.plans.registry import query
from roadpulse.session import stored

QUEUE_SQL = f"""{FIT_SQL},
  q_all AS (SELECT 'INC-' || CAST(incident_id AS VARCHAR) AS id, event_cause, corridor, zone,
                   hour(split_timestamp + INTERVAL 330 MINUTE) AS hour_of_day, latitude, longitude,
                   {rf.round_half_even_sql('closure_probability', 3)} AS closure_prob,
                   {rf.round_half_even_sql('greatest(predicted_resolution_minutes, 0e0)', 1)} AS resolution_min,
                   {rf.round_half_even_sql('centrality_score', 5)} AS centrality,
                   cascade_risk_score AS crs, priority, split = 'test' AS is_new, 'Active' AS status, split
            FROM banded),
  q AS (SELECT * FROM q_all WHERE split = 'val')"""

_TIERS = queue.TIERS


def val_queue(spark, sf_dir):
    s = scored_x5(spark, sf_dir)
    return queue.build_queue(s.where(F.col("split") == "val"))


@query("dispatch_queue", f"""{QUEUE_SQL}
SELECT id, event_cause, corridor, zone, hour_of_day, latitude, longitude, closure_prob, resolution_min,
       centrality, crs, priority, is_new, status FROM q""")
def q_dispatch_queue(spark, sf_dir):
    return queue.order_queue(val_queue(spark, sf_dir)).drop("reported_at")


_KPI_SQL = ", ".join(f"CAST(count_if(priority = '{t}') AS BIGINT) AS n_{t.lower()}" for t in _TIERS)


@query("queue_kpis", f"""{QUEUE_SQL}
SELECT count(*) AS n_active, {_KPI_SQL}, round(avg(crs), 6) AS avg_crs,
       round(100e0 - least(95e0, coalesce(avg(crs), 0e0)), 6) AS readiness FROM q""")
def q_queue_kpis(spark, sf_dir):
    return queue.kpis(val_queue(spark, sf_dir))


@query("ops_status", f"""{QUEUE_SQL}
SELECT CASE WHEN count_if(priority = 'Critical') > 0 THEN 'Elevated Operations'
            WHEN count_if(priority = 'High') > 0 THEN 'Heightened Operations'
            ELSE 'Normal Operations' END AS ops_status FROM q""")
def q_ops_status(spark, sf_dir):
    return queue.ops_status(queue.kpis(val_queue(spark, sf_dir)))


@query("corridor_rollup", f"""{QUEUE_SQL}
SELECT corridor, round(sum(crs), 6) AS total_crs, count(*) AS count FROM q GROUP BY corridor""")
def q_corridor_rollup(spark, sf_dir):
    r = queue.corridor_rollup(val_queue(spark, sf_dir))
    return r.select("corridor", F.round("total_crs", 6).alias("total_crs"), "count")


@query("top_corridors", f"""{QUEUE_SQL}
SELECT corridor, round(total_crs, 6) AS total_crs, count, rank, CAST(rank AS VARCHAR) || '.' AS rank_label FROM (
  SELECT *, row_number() OVER (ORDER BY total_crs DESC, corridor) AS rank FROM (
    SELECT corridor, sum(crs) AS total_crs, count(*) AS count FROM q GROUP BY corridor)) WHERE rank <= 5""")
def q_top_corridors(spark, sf_dir):
    t = queue.top_corridors(val_queue(spark, sf_dir), 5)
    return t.select("corridor", F.round("total_crs", 6).alias("total_crs"), "count",
                    F.col("rank").cast("long").alias("rank"), "rank_label")


@query("insight", f"""{QUEUE_SQL},
  roll AS (SELECT corridor, sum(crs) AS total_crs, count(*) AS count FROM q GROUP BY corridor),
  c AS (SELECT * FROM roll ORDER BY total_crs DESC, corridor LIMIT 1),
  i AS (SELECT id, crs FROM q ORDER BY crs DESC, id LIMIT 1)
SELECT coalesce(c.corridor, '—') AS corridor, coalesce(c.count, 0)::BIGINT AS incident_count,
       round(coalesce(c.total_crs, 0e0), 6) AS total_crs, coalesce(i.id, '—') AS top_id,
       round(coalesce(i.crs, 0e0), 6) AS top_crs
FROM (SELECT 1) d LEFT JOIN c ON true LEFT JOIN i ON true""")
def q_insight(spark, sf_dir):
    r = queue.insight(val_queue(spark, sf_dir))
    return r.select("corridor", "incident_count", F.round("total_crs", 6).alias("total_crs"), "top_id",
                    F.round("top_crs", 6).alias("top_crs"))


@query("hour_histogram", f"""{QUEUE_SQL}
SELECT h.hour_of_day, coalesce(n, 0)::BIGINT AS n FROM range(24) h(hour_of_day)
LEFT JOIN (SELECT hour_of_day, count(*) AS n FROM q GROUP BY 1) c ON c.hour_of_day = h.hour_of_day""")
def q_hour_histogram(spark, sf_dir):
    return queue.hour_histogram(val_queue(spark, sf_dir)).select(
        F.col("hour_of_day").cast("long").alias("hour_of_day"), "n")


@query("risk_composition", f"""{QUEUE_SQL}
SELECT id, round(closure_prob * 100e0, 6) AS closure_pct, round(least(100e0, resolution_min / 200e0 * 100e0), 6) AS duration_pct,
       round(least(100e0, centrality * 1500e0), 6) AS centrality_pct FROM q""")
def q_risk_composition(spark, sf_dir):
    r = queue.risk_composition(val_queue(spark, sf_dir))
    return r.select("id", *[F.round(c, 6).alias(c) for c in ("closure_pct", "duration_pct", "centrality_pct")])


def _title_sql(c):
    # initcap over '_' -> ' ' (the cause values are single lower-case words)
    return f"upper(substr(replace({c}, '_', ' '), 1, 1)) || substr(replace({c}, '_', ' '), 2)"


@query("dispatch_labels", f"""{QUEUE_SQL}
SELECT id, {_title_sql('event_cause')} AS title, id || ' · ' || {_title_sql('event_cause')} AS tooltip,
       corridor || ' · ' || zone AS location, lpad(CAST(hour_of_day AS VARCHAR), 2, '0') || ':00' AS hour_label,
       CAST(CAST(round_even(closure_prob * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS closure_label,
       '~' || CAST(CAST(round_even(resolution_min, 0) AS BIGINT) AS VARCHAR) || ' min' AS duration_label,
       CASE WHEN closure_prob >= 0.5 THEN 'HIGH' WHEN closure_prob >= 0.3 THEN 'MED' ELSE 'LOW' END AS closure_badge,
       {rf.map_sql('priority', rf.TIER_ACTION, rf.DEFAULT_ACTION)} AS action,
       {rf.map_sql('priority', rf.TIER_RECOMMENDATION, '')} AS recommendation
FROM q""")
def q_dispatch_labels(spark, sf_dir):
    return queue.dispatch_labels(val_queue(spark, sf_dir))


@query("queue_append", f"""{QUEUE_SQL}
SELECT is_new, count(*) AS n, round(sum(crs), 6) AS total_crs, round(max(crs), 6) AS max_crs
FROM q_all WHERE split IN ('val', 'test') GROUP BY is_new""")
def q_queue_append(spark, sf_dir):
    """TEST incidents arrive as new rows appended to the VAL queue."""
    s = scored_x5(spark, sf_dir)
    q = queue.build_queue(s.where(F.col("split") == "val"))
    new = queue.build_queue(s.where(F.col("split") == "test"), is_new=True)
    both = queue.append(q, new)
    return both.groupBy("is_new").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("crs"), 6).alias("total_crs"),
                                      F.round(F.max("crs"), 6).alias("max_crs"))


@query("select_incident", f"""{QUEUE_SQL}
SELECT * FROM (SELECT 'absent' AS asked, id, crs FROM q ORDER BY crs DESC, id LIMIT 1)
UNION ALL SELECT 'present', id, crs FROM q WHERE id = (SELECT min(id) FROM q)""")
def q_select_incident(spark, sf_dir):
    """an id that is in the VAL queue, and one that isn't (the top row)."""
    q = stored(val_queue(spark, sf_dir).select("id", "crs"))
    there = q.agg(F.min("id")).first()[0]
    return queue.select_incident(q, "INC-0").select(F.lit("absent").alias("asked"), "id", "crs").unionByName(
        queue.select_incident(q, there).select(F.lit("present").alias("asked"), "id", "crs"))


@query("intake_defaults", f"""SELECT 'INC-' || CAST(incident_id AS VARCHAR) AS id, CASE WHEN incident_id % 5 IN (0, 1, 2) THEN 'unknown' ELSE junction END AS junction,
       true AS is_new, 'Active' AS status, true AS stamped
FROM ({X5_SQL}) x5 WHERE incident_id % 2 = 0""")
def q_intake_defaults(spark, sf_dir):
    """P33 + P36: junctions sent empty, blank or not at all get the default; new
    queue rows carry the time of their report and are active."""
    s = scored_x5(spark, sf_dir).where("incident_id % 2 = 0")
    kind = F.col("incident_id") % 5
    sent = F.when(kind == 0, "").when(kind == 1, " \t ").when(kind == 2, F.lit(None)).otherwise(F.col("junction"))
    q = queue.build_queue(s, is_new=True)
    j = s.select(F.concat(F.lit("INC-"), F.col("incident_id").cast("string")).alias("id"), text.blank_to(sent).alias("junction"))
    return q.join(j, "id").select("id", "junction", "is_new", "status", F.col("reported_at").rlike(
        "^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$").alias("stamped"))

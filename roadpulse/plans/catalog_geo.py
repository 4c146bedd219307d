"""Catalogue: projection and nearest-edge snapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse.functions import geo
from roadpulse.operators import snap
from roadpulse.plans.adapters import X2_SQL, X3_EDGES_SQL, X3_POINTS_SQL, x2_incidents, x3_edges, x3_points
from roadpulse.plans.registry import query

# Centimetres: the two engines differ by ~1e-9 m (their sin/exp/log differ in
# the last bits), so finer rounding would flip a digit now and then.

_E, _N = geo.utm_project_sql("latitude", "longitude")


@query("utm_project", f"""WITH x2 AS ({X2_SQL})
SELECT incident_id, round({_E}, 2) AS easting, round({_N}, 2) AS northing FROM x2""")
def q_utm_project(spark, sf_dir):
    e, n = geo.utm_project("latitude", "longitude")
    return x2_incidents(spark, sf_dir).select("incident_id", F.round(e, 2).alias("easting"),
                                              F.round(n, 2).alias("northing"))


_DIST = geo.point_segment_distance_sql("p.x", "p.y", "s.ux", "s.uy", "s.vx", "s.vy")
SNAP_SQL = f"""WITH segs AS ({X3_EDGES_SQL}), pts AS ({X3_POINTS_SQL}),
  cand AS (SELECT p.incident_id, s.u, s.v, s.key, {_DIST} AS d FROM pts p, segs s WHERE p.x IS NOT NULL AND p.y IS NOT NULL),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY d, u, v, key) AS rn FROM cand)
           WHERE rn = 1)"""


def _snaps(spark, sf_dir):
    segs = x3_edges(spark, sf_dir).select("u", "v", "key", F.col("ux").alias("ax"), F.col("uy").alias("ay"),
                                          F.col("vx").alias("bx"), F.col("vy").alias("by"))
    pts = x3_points(spark, sf_dir)
    return pts, snap.snap_to_edges(pts, segs)


@query("snap_to_edge", f"""{SNAP_SQL}
SELECT p.incident_id, b.u AS nearest_u, b.v AS nearest_v, b.key AS nearest_key, round(b.d, 6) AS snap_distance,
       coalesce(b.d > 750e0, false) AS low_confidence_snap
FROM pts p LEFT JOIN best b USING (incident_id)""")
def q_snap_to_edge(spark, sf_dir):
    pts, snaps = _snaps(spark, sf_dir)
    out = snap.attach_snaps(pts.select("incident_id"), snaps)
    return out.select("incident_id", "nearest_u", "nearest_v", "nearest_key",
                      F.round("snap_distance", 6).alias("snap_distance"), "low_confidence_snap")


@query("snap_summary", f"""{SNAP_SQL}
SELECT round(min(d), 6) AS min, round(quantile_cont(d, 0.5), 6) AS p50, round(avg(d), 6) AS mean,
       round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS max, count(d) AS n,
       CAST(count_if(d > 750e0) AS BIGINT) AS n_low_confidence,
       round(count_if(d > 750e0) / count(d)::DOUBLE, 6) AS share_low_confidence FROM best""")
def q_snap_summary(spark, sf_dir):
    _, snaps = _snaps(spark, sf_dir)
    s = snap.snap_summary(snaps)
    return s.select(*[F.round(c, 6).alias(c) if c not in ("n", "n_low_confidence") else F.col(c)
                      for c in s.columns])

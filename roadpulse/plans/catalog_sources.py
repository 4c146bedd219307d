"""Catalogue: readers and writers round-tripping data derived from the tables
(S1-S3, S5-S11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.operators import clean, encode
from roadpulse.operators.risk import RiskScorer
from roadpulse.plans.adapters import X1_SQL, X3_EDGES_SQL, X3_NODES_SQL, x1_lifecycle, x3_edges, x3_nodes
from roadpulse.plans.catalog_clean import YEAR_MIN
from roadpulse.plans.catalog_features import TE_BASE, LABEL, x2_split
from roadpulse.plans.catalog_risk import FIT_SQL, x5_with_split
from roadpulse.plans.registry import query
from roadpulse.session import scratch_path
from roadpulse.sources import incidents as src


def _tmp(spark, name):
    return scratch_path(spark, f"io/{name}/{uuid.uuid4().hex}")


@query("csv_intake", f"""WITH x1 AS ({X1_SQL}),
  r AS (SELECT incident_id, (epoch_us(coalesce(resolved_datetime, closed_datetime)) - epoch_us(start_datetime)) / 6e7 AS m
        FROM x1)
SELECT cause, count(*) AS n, round(avg(m), 6) AS mean FROM (
  SELECT lower(regexp_replace(x1.event_cause, '^\\s+|\\s+$', '', 'g')) AS cause, r.m FROM x1 JOIN r USING (incident_id)
  WHERE r.m IS NOT NULL AND r.m >= 0 AND r.m <= {YEAR_MIN!r}e0) GROUP BY cause""")
def q_csv_intake(spark, sf_dir):
    """S9 -> S1/S2 -> P1: the lifecycle table exported as text CSV (timestamps
    written with a '+00' offset), read back as all-string columns, parsed
    tolerantly and cleaned."""
    path = _tmp(spark, "raw_csv")
    x1 = x1_lifecycle(spark, sf_dir)
    text = x1.select(
        F.col("incident_id").cast("string").alias("id"),
        *[F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00")).alias(c)
          for c in ("start_datetime", "resolved_datetime", "closed_datetime")],
        "event_type", "event_cause", "veh_type",
        F.lit(12.97).cast("string").alias("latitude"), F.lit(77.59).cast("string").alias("longitude"))
    src.write_table(text, path, fmt="csv")
    raw = src.load_incidents_csv(spark, path)
    parsed = clean.parse_timestamps(raw)
    df = clean.filter_resolution_window(clean.with_resolution_minutes(parsed), hi=YEAR_MIN)
    df = clean.normalise_event_cause(df)
    return df.groupBy(F.col("event_cause").alias("cause")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("resolution_minutes"), 6).alias("mean"))


@query("graphml_roundtrip", f"""WITH n AS ({X3_NODES_SQL}), e AS ({X3_EDGES_SQL})
SELECT e.u, e.v, e.key, CASE WHEN e.u % 3 = 0 THEN 1 + i ELSE 0 END AS part, CASE WHEN e.u % 5 = 0 THEN NULL ELSE e.ux END AS length,
       CASE WHEN e.u % 3 = 0 AND i = 1 THEN e.ux + 1e0 ELSE e.ux END AS ux, CASE WHEN e.u % 3 = 0 AND i = 1 THEN e.uy + 2e0 ELSE e.uy END AS uy,
       CASE WHEN e.u % 3 = 0 AND i = 0 THEN e.ux + 1e0 ELSE e.vx END AS vx, CASE WHEN e.u % 3 = 0 AND i = 0 THEN e.uy + 2e0 ELSE e.vy END AS vy
FROM e, range(2) r(i) WHERE i = 0 OR e.u % 3 = 0""")
def q_graphml_roundtrip(spark, sf_dir):
    """S5 + S6 + J4: the road network written as GraphML (numbered keys, nodes,
    some edges with a bend as geometry, some without a length), read back
    through the XML source, cut into segments and cached as parquet."""
    path = _tmp(spark, "graphml")
    e = x3_edges(spark, sf_dir)
    at = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    bend = F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", at(F.col("ux"), F.col("uy")), at(F.col("ux") + 1, F.col("uy") + 2),
                                                       at(F.col("vx"), F.col("vy"))), F.lit(")"))
    src.write_graphml(x3_nodes(spark, sf_dir), e.select(
        "u", "v", "key", F.when(F.col("u") % 5 != 0, F.col("ux")).alias("length"), F.when(F.col("u") % 3 == 0, bend).alias("geometry")), path)
    nodes, edges = src.read_graphml(spark, f"{path}/*")
    cache = _tmp(spark, "graph_cache")
    edges = src.cached_graph(spark, cache, lambda: edges)
    lengths = edges.select(F.col("u").alias("_u"), F.col("v").alias("_v"), "length")
    seg = src.edge_segments(nodes, edges)
    first = seg.join(nodes.select(F.col("node_id").alias("u"), "x", "y"), "u")
    part = F.when(F.col("u") % 3 != 0, 0).when((F.col("ux") == F.col("x")) & (F.col("uy") == F.col("y")), 1).otherwise(2)
    return first.join(lengths, (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v"))).select(
        "u", "v", "key", part.alias("part"), "length", "ux", "uy", "vx", "vy")


_META_SCHEMA = T.StructType([T.StructField("feature", T.StringType()),
                             T.StructField("value", T.StringType()),
                             T.StructField("te", T.DoubleType()),
                             T.StructField("global_mean", T.DoubleType()),
                             T.StructField("smoothing", T.DoubleType())])


@query("metadata_roundtrip", f"""{TE_BASE}
SELECT coalesce(CAST(zone AS VARCHAR), 'nan') AS value,
       round((sum(CASE WHEN {LABEL} THEN 1e0 ELSE 0e0 END) + 20e0 * any_value(g)) / (count(*) + 20e0), 6) AS te,
       round(any_value(g), 6) AS global_mean
FROM tr, gm GROUP BY 1""")
def q_metadata_roundtrip(spark, sf_dir):
    """S8 -> S7: the zone encoder persisted as JSON lines — one document per
    category {feature, value, te, global_mean, smoothing}, written in parallel
    (no single document holding every category) — and read back with its schema."""
    tr = x2_split(spark, sf_dir).where(F.col("split") == "train")
    g = encode.global_mean(tr, LABEL)
    enc = encode.encoder_table(tr, "zone", LABEL, g)
    doc = enc.select(F.lit("zone_te").alias("feature"), "value", "te", F.lit(g).alias("global_mean"),
                     F.lit(encode.SMOOTHING).alias("smoothing"))
    path = _tmp(spark, "metadata")
    src.write_metadata(doc, path)
    back = src.read_metadata(spark, path, _META_SCHEMA)
    return back.select("value", F.round("te", 6).alias("te"), F.round("global_mean", 6).alias("global_mean"))


@query("scorer_roundtrip", f"""{FIT_SQL}
SELECT incident_id, cascade_risk_score, priority FROM banded WHERE split = 'test'""")
def q_scorer_roundtrip(spark, sf_dir):
    """The fitted scorer saved as a one-row parquet, loaded and applied."""
    df = x5_with_split(spark, sf_dir)
    path = _tmp(spark, "scorer")
    RiskScorer().fit(df.where(F.col("split") == "train")).save(spark, path)
    s = RiskScorer.load(spark, path).score(df.where(F.col("split") == "test"))
    return s.select("incident_id", "cascade_risk_score", "priority")

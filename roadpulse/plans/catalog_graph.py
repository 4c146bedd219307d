"""Catalogue: graph collapse, edge betweenness, centrality lookup."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roadpulse.functions import geo
from roadpulse.operators import enrich, graph, snap
from roadpulse.operators.ranks import with_next
from roadpulse.plans.adapters import X2_SQL, X3_NODES_SQL, X4_SQL, x2_incidents, x3_edges, x3_nodes, x4_edges, x4_edges_of, x4_items
from roadpulse.plans.registry import query
from roadpulse.session import scratch_path, stored
from roadpulse.sources import incidents as src
from roadpulse.sources.tables import table

_BASE = f"""WITH RECURSIVE e AS ({X4_SQL}),
  arcs AS (SELECT u AS a, v AS b, w FROM e WHERE u <> v UNION ALL SELECT v, u, w FROM e WHERE u <> v),
  nodes AS (SELECT u AS node FROM e UNION SELECT v FROM e),
  d1 AS (SELECT s, t, min(d) AS d FROM (SELECT a AS s, b AS t, w AS d FROM arcs UNION ALL
                                         SELECT node, node, 0 FROM nodes) GROUP BY 1, 2),
  d2 AS (SELECT x.s, y.t, min(x.d + y.d) AS d FROM d1 x JOIN d1 y ON x.t = y.s GROUP BY 1, 2),
  d4 AS (SELECT x.s, y.t, min(x.d + y.d) AS d FROM d2 x JOIN d2 y ON x.t = y.s GROUP BY 1, 2),
  d8 AS (SELECT x.s, y.t, min(x.d + y.d) AS d FROM d4 x JOIN d4 y ON x.t = y.s GROUP BY 1, 2),
  d16 AS (SELECT x.s, y.t, min(x.d + y.d) AS d FROM d8 x JOIN d8 y ON x.t = y.s GROUP BY 1, 2),
  dist AS (SELECT x.s, y.t, min(x.d + y.d) AS d FROM d16 x JOIN d16 y ON x.t = y.s GROUP BY 1, 2),
  tight AS (SELECT x.s, a.a, a.b FROM arcs a JOIN dist x ON x.t = a.a JOIN dist y ON y.s = x.s AND y.t = a.b
            WHERE x.d + a.w = y.d),
  paths(s, node) AS (SELECT node, node FROM nodes UNION ALL
                     SELECT p.s, t.b FROM paths p JOIN tight t ON t.s = p.s AND t.a = p.node),
  sigma AS (SELECT s, node, count(*)::DOUBLE AS sg FROM paths GROUP BY 1, 2),
  k AS (SELECT least(500, count(*) - 1) AS k FROM nodes),
  piv AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY md5('42:' || CAST(node AS VARCHAR)), node) AS r FROM nodes), k WHERE r <= k),
  cred AS (SELECT t.s, least(t.a, t.b) AS u, greatest(t.a, t.b) AS v, sa.sg * sb.sg / sst.sg AS c
           FROM tight t
           JOIN sigma sa ON sa.s = t.s AND sa.node = t.a
           JOIN dist dsb ON dsb.s = t.s AND dsb.t = t.b
           JOIN dist dbt ON dbt.s = t.b
           JOIN dist dst ON dst.s = t.s AND dst.t = dbt.t
           JOIN sigma sb ON sb.s = t.b AND sb.node = dbt.t
           JOIN sigma sst ON sst.s = t.s AND sst.node = dbt.t
           WHERE dbt.t <> t.s AND dsb.d + dbt.d = dst.d),
  n AS (SELECT count(*)::DOUBLE AS n FROM nodes)"""


def nation_edges(spark, sf_dir):
    return x4_edges(spark, sf_dir)


@query("edge_betweenness", f"""{_BASE}
SELECT e.u, e.v, round(coalesce(c, 0e0) / (n * (n - 1)), 12) AS centrality
FROM e LEFT JOIN (SELECT u, v, sum(c) AS c FROM cred GROUP BY 1, 2) USING (u, v), n""")
def q_edge_betweenness(spark, sf_dir):
    eb = graph.edge_betweenness(nation_edges(spark, sf_dir))
    return eb.select("u", "v", F.round("centrality", 12).alias("centrality"))


@query("edge_betweenness_pivots", f"""{_BASE}
SELECT e.u, e.v, round(coalesce(c, 0e0) * (n / k) / (n * (n - 1)), 12) AS centrality
FROM e LEFT JOIN (SELECT u, v, sum(c) AS c FROM cred WHERE s IN (SELECT node FROM piv) GROUP BY 1, 2)
USING (u, v), n, k""")
def q_edge_betweenness_pivots(spark, sf_dir):
    """Pivots as beyond the exact threshold, min(500, n - 1) of them."""
    edges = stored(nation_edges(spark, sf_dir))
    n = edges.select(F.explode(F.array("u", "v"))).distinct().count()
    eb = graph.edge_betweenness(edges, k=min(graph.K_PIVOTS, n - 1))
    return eb.select("u", "v", F.round("centrality", 12).alias("centrality"))


def _road_sql(nodes: str, every: bool = False) -> str:
    """Betweenness of the polylines' edges. An edge with i of its road's l nodes
    before it lies on the paths from each source before it to the l - i nodes
    behind it, and the other way round. Sources follow the rule of the pivots,
    or are all nodes (``every``)."""
    sources = f"""piv AS (SELECT node_id, count(*) OVER () AS n, least({graph.K_PIVOTS}, count(*) OVER () - 1) AS k0,
           row_number() OVER (ORDER BY md5('42:' || CAST(node_id AS VARCHAR)), node_id) AS r FROM {nodes}),
  src AS (SELECT node_id, n, CASE WHEN n <= {graph.EXACT_THRESHOLD_NODES} THEN n ELSE k0 END AS k,
           CASE WHEN n <= {graph.EXACT_THRESHOLD_NODES} OR r <= k0 THEN 1 ELSE 0 END AS is_source FROM piv),"""
    if every:
        sources = f"src AS (SELECT node_id, count(*) OVER () AS n, count(*) OVER () AS k, 1 AS is_source FROM {nodes}),"
    return f"""{sources}
  p AS (SELECT x.*, lead(x.node_id) OVER w AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY label) AS l, n::DOUBLE AS n, k::DOUBLE AS k,
               sum(is_source) OVER w AS before, sum(is_source) OVER (PARTITION BY label) AS every
        FROM {nodes} x JOIN src USING (node_id) WINDOW w AS (PARTITION BY label ORDER BY x.node_id)),
  c AS (SELECT *, (before * (l - i) + (every - before) * i) * (n / k) / (n * (n - 1)) AS c FROM p)"""


@query("edge_betweenness_roads", f"""WITH n0 AS ({X3_NODES_SQL}), {_road_sql("n0")}
SELECT node_id AS u, v, round(c, 12) AS centrality FROM c WHERE v IS NOT NULL""")
def q_edge_betweenness_roads(spark, sf_dir):
    """G2 on a network that grows with the data: the whole polylines, with
    lengths from coordinates."""
    e = x3_edges(spark, sf_dir).select("u", "v", F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")).alias("w"))
    eb = graph.edge_betweenness(stored(e), x3_nodes(spark, sf_dir).select("node_id"))
    return eb.select("u", "v", F.round("centrality", 12).alias("centrality"))


def _nation_arcs(spark, sf_dir):
    """Directed multigraph: one arc per line item, customer nation -> supplier
    nation, length = extended price (self-loops and parallels included)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
            .join(s, F.col("l_suppkey") == s.s_suppkey)
            .select(F.col("c_nationkey").cast("long").alias("u"), F.col("s_nationkey").cast("long").alias("v"),
                    F.col("l_extendedprice").alias("length")))


_ARCS_SQL = """SELECT CAST(c_nationkey AS BIGINT) AS u, CAST(s_nationkey AS BIGINT) AS v, l_extendedprice AS length
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey"""


@query("collapse_graph", f"""WITH arcs AS ({_ARCS_SQL})
SELECT least(u, v) AS u, greatest(u, v) AS v, round(min(coalesce(length, 1e0)), 6) AS length, count(*) AS n_parallel
FROM arcs GROUP BY 1, 2""")
def q_collapse_graph(spark, sf_dir):
    c = graph.collapse_simple(_nation_arcs(spark, sf_dir))
    return c.select("u", "v", F.round("length", 6).alias("length"), "n_parallel")


@query("graph_metadata", f"""WITH arcs AS ({_ARCS_SQL}),
  simple AS (SELECT least(u, v), greatest(u, v), count(*) AS n_parallel FROM arcs GROUP BY 1, 2)
SELECT (SELECT count(*) FROM arcs) AS n_edges_before, (SELECT count(*) FROM simple) AS n_edges_after,
       (SELECT sum(n_parallel - 1) FROM simple)::BIGINT AS n_collapsed, (SELECT count(*) FROM nation) AS n_nodes,
       'exact' AS method, (SELECT count(*) FROM nation) AS k_pivots, 42 AS seed""")
def q_graph_metadata(spark, sf_dir):
    arcs = _nation_arcs(spark, sf_dir)
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"))
    return graph.graph_metadata(arcs, graph.collapse_simple(arcs), nodes)


@query("assign_centrality", f"""{_BASE},
  eb AS (SELECT e.u, e.v, coalesce(c, 0e0) / (n * (n - 1)) AS centrality
         FROM e LEFT JOIN (SELECT u, v, sum(c) AS c FROM cred GROUP BY 1, 2) USING (u, v), n),
  inc AS (SELECT l_orderkey, l_linenumber, c_nationkey AS nu, s_nationkey AS nv
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN supplier ON l_suppkey = s_suppkey)
SELECT l_orderkey, l_linenumber, round(eb.centrality, 12) AS centrality_score
FROM inc LEFT JOIN eb ON eb.u = least(nu, nv) AND eb.v = greatest(nu, nv)""")
def q_assign_centrality(spark, sf_dir):
    """Every line item is an incident snapped to the (customer, supplier)
    nation edge, looked up as an unordered pair; same-nation rows miss."""
    items = stored(x4_items(spark, sf_dir))  # the joins of the large tables serve both the edges and the incidents
    eb = graph.edge_betweenness(stored(x4_edges_of(items)))
    inc = items.select("l_orderkey", "l_linenumber", F.col("cu").alias("nearest_u"), F.col("su").alias("nearest_v"))
    out = graph.assign_centrality(inc, eb)
    return out.select("l_orderkey", "l_linenumber", F.round("centrality_score", 12).alias("centrality_score"))


# X3 as a road network around the city, in degrees
_NE, _NN = geo.utm_project_sql("lat", "lon")
_PE, _PN = geo.utm_project_sql("latitude", "longitude")
_SNAP_DIST = geo.point_segment_distance_sql("q.x", "q.y", "s.ux", "s.uy", "s.vx", "s.vy")


@query("centrality_from_degrees", f"""WITH deg AS (SELECT node_id, label, 12.97e0 + x * 3e-7 AS lat, 77.59e0 + y * 3e-7 AS lon FROM ({X3_NODES_SQL}) n0),
  n1 AS (SELECT node_id, label, round({_NE}, 2) AS x, round({_NN}, 2) AS y FROM deg), {_road_sql("n1")},
  s AS (SELECT c.node_id AS u, v, c.x AS ux, c.y AS uy, n1.x AS vx, n1.y AS vy, c FROM c JOIN n1 ON n1.node_id = v),
  q AS (SELECT incident_id, round({_PE}, 2) AS x, round({_PN}, 2) AS y FROM ({X2_SQL}) x2 WHERE incident_id % 19 <> 0),
  d AS (SELECT q.incident_id, s.u, s.v, s.c, {_SNAP_DIST} AS d FROM q, s),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY d, u, v) AS r FROM d) WHERE r = 1)
SELECT x2.incident_id, b.u AS nearest_u, round(b.d, 4) AS snap_distance_m, round(b.c, 12) AS centrality_score
FROM ({X2_SQL}) x2 LEFT JOIN b USING (incident_id)""")
def q_centrality_from_degrees(spark, sf_dir):
    """Step 2 end to end: network and incidents in degrees, projected; parallel
    edges collapsed; betweenness of its edges; every incident (some have no
    coordinate) snapped to its nearest edge and given that edge's score."""
    east, north = geo.utm_project("lat", "lon")
    n = x3_nodes(spark, sf_dir).select("node_id", "label", (F.lit(12.97) + F.col("x") * F.lit(3e-7)).alias("lat"),
                                       (F.lit(77.59) + F.col("y") * F.lit(3e-7)).alias("lon"))
    n = stored(n.select("node_id", "label", F.round(east, 2).alias("x"), F.round(north, 2).alias("y")))
    road = stored(with_next(n, "label", "node_id", ["node_id", "x", "y"]).where("next_node_id IS NOT NULL").select(
        F.col("node_id").alias("u"), F.col("next_node_id").alias("v"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.col("next_x").alias("bx"), F.col("next_y").alias("by")))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    both = road.select("u", "v", length.alias("length")).unionByName(road.select(F.col("v").alias("u"), F.col("u").alias("v"), (2 * length).alias("length")))
    simple = graph.collapse_simple(both)
    eb = stored(graph.edge_betweenness(simple.select("u", "v", F.col("length").alias("w")), n.select("node_id")))
    pe, pn = geo.utm_project("latitude", "longitude")
    inc = x2_incidents(spark, sf_dir).select("incident_id", F.when(F.col("incident_id") % 19 != 0, F.round(pe, 2)).alias("x"),
                                             F.when(F.col("incident_id") % 19 != 0, F.round(pn, 2)).alias("y"))
    inc = stored(inc)
    snaps = snap.snap_to_edges(inc, road.withColumn("key", F.lit(0)))
    out = graph.assign_centrality(snap.attach_snaps(inc, snaps), eb)
    return out.select("incident_id", "nearest_u", F.round("snap_distance", 4).alias("snap_distance_m"),
                      F.round("centrality_score", 12).alias("centrality_score"))


def _projected_sql(lat: str, lon: str, x: str, y: str) -> str:
    east, north = geo.utm_project_sql(lat, lon)
    return f"round({east}, 2) AS {x}, round({north}, 2) AS {y}"


@query("graphml_to_enriched", f"""WITH n0 AS (SELECT node_id, label, x, y, 77.59e0 + y * 3e-7 AS lon, 12.97e0 + x * 3e-7 AS lat FROM ({X3_NODES_SQL}) t), {_road_sql("n0", every=True)},
  road AS (SELECT p.node_id AS u, v, p.lon AS ulon, p.lat AS ulat, o.lon AS vlon, o.lat AS vlat,
             1e0 + (abs(o.x - p.x) + abs(o.y - p.y)) / 1e3 AS length,
             (p.lon + o.lon) / 2e0 + 1e-4 * (p.node_id % 5 + 1) AS mlon, (p.lat + o.lat) / 2e0 AS mlat
           FROM p JOIN n0 o ON o.node_id = p.v),
  arcs AS (SELECT u, v, u AS source, 0 AS key, CASE WHEN u % 7 <> 3 THEN length END AS length FROM road
    UNION ALL SELECT u, v, v, 1, CASE WHEN u % 2 = 0 THEN 0.5e0 * length ELSE 2e0 * length END FROM road WHERE u % 3 <> 0),
  kept AS (SELECT u, v, key FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY coalesce(length, 1e0), key, source) AS r FROM arcs) WHERE r = 1),
  deg AS (SELECT u, v, 0 AS key, ulon, ulat, vlon, vlat FROM road
    UNION ALL SELECT v, u, 1, vlon, vlat, mlon, mlat FROM road WHERE u % 3 <> 0
    UNION ALL SELECT v, u, 1, mlon, mlat, ulon, ulat FROM road WHERE u % 3 <> 0),
  s AS (SELECT u, v, key, {_projected_sql("ulat", "ulon", "ux", "uy")}, {_projected_sql("vlat", "vlon", "vx", "vy")} FROM deg),
  q AS (SELECT incident_id, {_projected_sql("latitude", "longitude", "x", "y")} FROM ({X2_SQL}) x2 WHERE incident_id % 19 <> 0),
  d AS (SELECT q.incident_id, s.u, s.v, s.key, {_SNAP_DIST} AS d FROM q, s),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY d, u, v, key) AS r FROM d) WHERE r = 1)
SELECT x2.incident_id, b.u AS nearest_u, b.v AS nearest_v, b.key AS nearest_key, round(b.d, 4) AS snap_distance_m,
  coalesce(b.d > 750e0, false) AS low_confidence_snap, kept.key AS kept_key, round(c.c, 12) AS centrality_score
FROM ({X2_SQL}) x2 LEFT JOIN b USING (incident_id)
  LEFT JOIN kept ON kept.u = least(b.u, b.v) AND kept.v = greatest(b.u, b.v)
  LEFT JOIN c ON c.node_id = kept.u AND c.v = kept.v""")
def q_graphml_to_enriched(spark, sf_dir):
    """Step 2 from its files (S5, P18, A19, G2, J4, J2, P16, J3, S9): the roads as
    GraphML in degrees, two thirds of them with a bent edge back beside the
    straight one, some without a length; read, projected, collapsed to the
    shortest parallel edge, scored; incidents (some without coordinates) snapped
    to all edges along their shapes; the enriched table saved and read back."""
    path = scratch_path(spark, f"step2/{uuid.uuid4().hex}")
    lon, lat = (lambda c: F.lit(77.59) + F.col(c) * F.lit(3e-7)), (lambda c: F.lit(12.97) + F.col(c) * F.lit(3e-7))
    e = stored(x3_edges(spark, sf_dir).select(
        "u", "v", lon("uy").alias("ulon"), lat("ux").alias("ulat"), lon("vy").alias("vlon"), lat("vx").alias("vlat"),
        (F.lit(1.0) + (F.abs(F.col("vx") - F.col("ux")) + F.abs(F.col("vy") - F.col("uy"))) / F.lit(1e3)).alias("length")))
    at = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    middle = at((F.col("ulon") + F.col("vlon")) / 2 + F.lit(1e-4) * (F.col("u") % 5 + 1), (F.col("ulat") + F.col("vlat")) / 2)
    bent = F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", at(F.col("vlon"), F.col("vlat")), middle, at(F.col("ulon"), F.col("ulat"))), F.lit(")"))
    there = e.select("u", "v", F.lit(0).alias("key"), F.when(F.col("u") % 7 != 3, F.col("length")).alias("length"), F.lit(None).cast("string").alias("geometry"))
    back = e.where("u % 3 <> 0").select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(1).alias("key"), (
        F.when(F.col("u") % 2 == 0, F.lit(0.5)).otherwise(F.lit(2.0)) * F.col("length")).alias("length"), bent.alias("geometry"))
    n = x3_nodes(spark, sf_dir).select("node_id", lon("y").alias("x"), lat("x").alias("y"))
    src.write_graphml(n, there.unionByName(back), f"{path}/graph")
    nodes, edges = src.read_graphml(spark, f"{path}/graph/*")
    known = F.col("incident_id") % 19 != 0
    inc = x2_incidents(spark, sf_dir).select("incident_id", "zone", F.when(known, F.col("latitude")).alias("latitude"),
                                             F.when(known, F.col("longitude")).alias("longitude"))
    src.write_table(enrich.enrich_incidents(inc, stored(nodes), stored(edges), digits=2), f"{path}/enriched")
    return spark.read.parquet(f"{path}/enriched").select(
        "incident_id", "nearest_u", "nearest_v", "nearest_key", F.round("snap_distance", 4).alias("snap_distance_m"),
        "low_confidence_snap", "kept_key", F.round("centrality_score", 12).alias("centrality_score"))

"""Step 2 as one run: network and incidents in degrees -> incidents with their
nearest edge and its betweenness (P18, A19, G2, J4, J2, P16, J3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.geo import utm_project
from roadpulse.operators import graph, snap
from roadpulse.session import stored
from roadpulse.sources.incidents import edge_segments


def _metres(lat: str, lon: str, zone: int, digits: int | None) -> tuple[Column, Column]:
    both = utm_project(lat, lon, zone)
    return both if digits is None else tuple(F.round(c, digits) for c in both)


def projected_segments(nodes: DataFrame, edges: DataFrame, zone: int = 43, digits: int | None = None) -> DataFrame:
    """Every edge as straight segments in metres (u, v, key, ax, ay, bx, by).

    Line strings are cut in degrees, each of their vertices is then projected:
    flat columns in generated code, nothing is shuffled to put a line together
    again. Edges without a line string run straight between their nodes."""
    s = edge_segments(nodes, edges)  # x is the longitude, y the latitude
    (ax, ay), (bx, by) = _metres("uy", "ux", zone, digits), _metres("vy", "vx", zone, digits)
    return s.select("u", "v", "key", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


def enrich_incidents(incidents: DataFrame, nodes: DataFrame, edges: DataFrame, pid: str = "incident_id",
                     lat: str = "latitude", lon: str = "longitude", zone: int = 43, digits: int | None = None,
                     k: int | None = None) -> DataFrame:
    """``incidents`` with nearest_u, nearest_v, nearest_key, snap_distance,
    low_confidence_snap, centrality_score and kept_key.

    ``nodes`` (node_id, x, y) and ``edges`` (u, v, key, length, geometry) are a
    directed multigraph in degrees, as ``read_graphml`` gives it. Betweenness is
    that of the simple graph, in which the shortest of parallel edges stays
    (``kept_key``), with every node as a source at any size, or ``k`` pivots if
    given; incidents are snapped to all edges, along their own shapes, and
    looked up by the pair of nodes. Every incident stays: without
    coordinates its new columns are NULL. ``digits`` rounds projected
    coordinates, so that results do not hang on a library's last bit."""
    simple = stored(graph.collapse_simple(edges, carry=("key",)))
    score = graph.edge_betweenness(simple.select("u", "v", F.col("length").alias("w")), nodes.select("node_id"), k,
                                   every=k is None)
    score = stored(score.join(simple.select("u", "v", F.col("key").alias("kept_key")), ["u", "v"]))
    east, north = _metres(lat, lon, zone, digits)
    placed = stored(incidents.select(pid, east.alias("x"), north.alias("y")))
    snaps = snap.snap_to_edges(placed, stored(projected_segments(nodes, edges, zone, digits)), pid=pid)
    found = graph.assign_centrality(snaps, score.select("u", "v", "centrality"))
    a, b = F.least("nearest_u", "nearest_v"), F.greatest("nearest_u", "nearest_v")
    kept = score.select(F.col("u").alias("__u"), F.col("v").alias("__v"), "kept_key")
    found = found.join(kept, (a == F.col("__u")) & (b == F.col("__v")), "left").drop("__u", "__v")
    return snap.attach_snaps(incidents, found, pid)

"""Adapters: give the benchmark tables the shapes of the incident data.

Each adapter has two twins that must stay in step: a DataFrame builder (what
the library runs) and a DuckDB SQL text (what the oracle runs). The SQL texts
are the definitions written down in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.operators.ranks import with_next
from roadpulse.sources.tables import table


def _ts(c: str):
    # the parquet timestamps arrive as TIMESTAMP_NTZ; with the session clock at
    # UTC the cast keeps the wall-clock value and gives an instant type
    return F.col(c).cast("timestamp")


# ---------------------------------------------------------------- X1 lifecycle
def x1_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("resolved_datetime"),
               F.min("l_shipdate").alias("closed_datetime")))
    o = table(spark, sf_dir, "orders")
    return (o.join(li, o.o_orderkey == li.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("incident_id"),
                    _ts("o_orderdate").alias("start_datetime"),
                    _ts("resolved_datetime").alias("resolved_datetime"),
                    _ts("closed_datetime").alias("closed_datetime"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", "planned")
                     .otherwise("unplanned").alias("event_type"),
                    F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("event_cause"),
                    F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("veh_type")))


X1_SQL = """
SELECT o_orderkey AS incident_id, o_orderdate AS start_datetime, l.resolved_datetime, l.closed_datetime,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'planned' ELSE 'unplanned' END AS event_type,
       concat('  ', o_orderpriority, ' ') AS event_cause, nullif(o_orderstatus, 'P') AS veh_type
FROM orders LEFT JOIN (
  SELECT l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS resolved_datetime,
         min(l_shipdate) AS closed_datetime FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
"""


# ------------------------------------------------------ X2 labelled incidents
def x2_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("incident_id"),
        _ts("ts").alias("split_timestamp"),
        F.col("event_type").alias("event_cause"),
        F.concat(F.lit("J"), F.col("user_id")).alias("junction"),
        F.concat(F.lit("Z"), F.col("user_id") % 10).alias("zone"),
        F.concat(F.lit("C"), F.col("user_id") % 23).alias("corridor"),
        (F.lit(12.65) + ((F.col("event_id") * 7919) % 7000).cast("double") / F.lit(1e4)).alias("latitude"),
        (F.lit(77.25) + ((F.col("event_id") * 104729) % 7000).cast("double") / F.lit(1e4)).alias("longitude"),
        F.col("value").alias("resolution_minutes"),
        (F.get_json_object("props", "$.k").cast("int") >= 90).alias("requires_road_closure"),
    )


X2_SQL = """
SELECT event_id AS incident_id, ts AS split_timestamp, event_type AS event_cause, concat('J', user_id) AS junction,
       concat('Z', user_id % 10) AS zone, concat('C', user_id % 23) AS corridor,
       12.65e0 + CAST(event_id * 7919 % 7000 AS DOUBLE) / 1e4 AS latitude,
       77.25e0 + CAST(event_id * 104729 % 7000 AS DOUBLE) / 1e4 AS longitude,
       value AS resolution_minutes,
       CAST(props->>'$.k' AS INT) >= 90 AS requires_road_closure
FROM events
"""


# ------------------------------------------------ X3 planar road network
def _emb(i: int):
    return F.round(F.element_at("embedding", i).cast("double") * F.lit(1e6))


def x3_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("node_id"), "label", _emb(1).alias("x"), _emb(2).alias("y"))


def x3_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive node ids within a label form a polyline; key 0."""
    nxt = with_next(x3_nodes(spark, sf_dir), "label", "node_id", ["node_id", "x", "y"])
    return nxt.where("next_node_id IS NOT NULL").select(
        F.col("node_id").alias("u"), F.col("next_node_id").alias("v"), F.lit(0).alias("key"), F.col("x").alias("ux"), F.col("y").alias("uy"),
        F.col("next_x").alias("vx"), F.col("next_y").alias("vy"))


def x3_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("incident_id"), _emb(3).alias("x"), _emb(4).alias("y"))


X3_NODES_SQL = """
SELECT vec_id AS node_id, label, round(CAST(embedding[1] AS DOUBLE) * 1e6) AS x,
       round(CAST(embedding[2] AS DOUBLE) * 1e6) AS y FROM embeddings
"""
X3_EDGES_SQL = f"""
SELECT u, v, 0 AS key, ux, uy, vx, vy FROM (
  SELECT node_id AS u, x AS ux, y AS uy,
         lead(node_id) OVER (PARTITION BY label ORDER BY node_id) AS v,
         lead(x) OVER (PARTITION BY label ORDER BY node_id) AS vx,
         lead(y) OVER (PARTITION BY label ORDER BY node_id) AS vy
  FROM ({X3_NODES_SQL}) n) WHERE v IS NOT NULL
"""
X3_POINTS_SQL = """
SELECT vec_id AS incident_id, round(CAST(embedding[3] AS DOUBLE) * 1e6) AS x,
       round(CAST(embedding[4] AS DOUBLE) * 1e6) AS y FROM embeddings
"""


# ------------------------------------------------------- X4 nation graph
def x4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item with its customer's and its supplier's nation and its price in cents.

    The line items, the one long table, are joined with the suppliers' nations and
    then with the orders, which have met their customers by then."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("cu"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("su"))
    bought = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cu")
    sold = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "cents", "su")
    return sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "cents", "cu", "su")


def x4_edges_of(items: DataFrame) -> DataFrame:
    """The nation graph of ``x4_items``: the cheapest item between two nations."""
    return (items.where("cu <> su").groupBy(F.least("cu", "su").alias("u"), F.greatest("cu", "su").alias("v"))
            .agg(F.min("cents").alias("w")))


def x4_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x4_edges_of(x4_items(spark, sf_dir))


X4_SQL = """
SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS u, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS v,
       min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS w
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN supplier ON l_suppkey = s_suppkey
WHERE c_nationkey <> s_nationkey GROUP BY 1, 2
"""


# ------------------------------------------------ X5 pre-scored incidents
def x5_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    x2 = x2_incidents(spark, sf_dir)
    j = F.substring("junction", 2, 1 << 20).cast("long")
    return x2.select(
        "incident_id", "split_timestamp", "corridor", "zone", "event_cause", "requires_road_closure",
        "resolution_minutes",
        (F.col("resolution_minutes") / (F.col("resolution_minutes") + F.lit(60.0))).alias("closure_probability"),
        (F.col("resolution_minutes") * F.lit(0.8) + F.lit(10.0)).alias("predicted_resolution_minutes"),
        ((j * j) % 997).cast("double").__truediv__(F.lit(15000.0)).alias("centrality_score"),
        "latitude", "longitude", "junction")


X5_SQL = f"""
SELECT incident_id, split_timestamp, corridor, zone, event_cause, requires_road_closure, resolution_minutes,
       resolution_minutes / (resolution_minutes + 60e0) AS closure_probability,
       resolution_minutes * 0.8e0 + 10e0 AS predicted_resolution_minutes,
       CAST(CAST(substr(junction, 2) AS BIGINT) * CAST(substr(junction, 2) AS BIGINT) % 997 AS DOUBLE) / 15000e0 AS centrality_score,
       latitude, longitude, junction
FROM ({X2_SQL}) x2
"""

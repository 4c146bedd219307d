"""Connected components of an edge list, by alternating stars.

Each round links every node to the smallest one it sees, first among larger
neighbours, then among smaller ones. The rounds needed grow with the logarithm
of the largest component; edges never grow in number. Minima are partial
aggregates and are joined back, so a node with very many edges is never
gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (columns u, v) with the smallest
    node reachable from it. Self-links are allowed and ignored."""
    now, before = edges.select("u", "v").where("u <> v").distinct(), None
    while True:
        now = materialize(_small(_large(now).distinct()).distinct(), "stars")
        told = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (told["n"], told["s"]) == before:
            break
        before = (told["n"], told["s"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct().toDF("node", "root"))

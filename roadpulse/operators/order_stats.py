"""Exact quantiles of groups of any size.

Rows are first reduced to (group, value, count), so a value that very many
rows share is one row. The distinct values are dealt out by range of (group,
value); counts per range give each range its offset, and only inside a range a
running sum is taken. A wanted rank is looked up in the one range that holds
it. So no task holds a group, nothing is sampled or approximated, and the
input is read once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.session import stored, stored_with_metrics


def number(col: str | Column) -> Column:
    """A double; NaN counts as missing."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(c), c)


def exact_quantiles(df: DataFrame, cols: dict[str, str | Column], probs: Sequence[float] | Callable[[int], Sequence[float]],
                    by: Sequence[str] = ()) -> DataFrame:
    """(by..., name, q): linearly interpolated quantiles of every column of
    ``cols`` (name -> column or expression) in every group, in the order of
    ``probs``. A group without values has no row. ``probs`` may be a function
    of the number of input rows."""
    stack = F.array(*[F.struct(F.lit(name).alias("name"), number(c).alias("v")) for name, c in cols.items()])
    keys = [F.col(b) for b in by]
    long = df.select(*keys, F.explode(stack).alias("__x"))
    long = long.select(F.struct(*keys, F.col("__x.name").alias("name")).alias("g"), F.col("__x.v").alias("v"))
    counts, m = stored_with_metrics(long.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")), n=F.sum("c"))
    probs = list(probs((m["n"] or 0) // len(cols)) if callable(probs) else probs)
    counts = counts.where("v IS NOT NULL")

    # range partitions are drawn from a sample: they are stored so that every use sees the same
    ranged = stored(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("g", "part").agg(F.sum("c").alias("pc"))
    of_group = Window.partitionBy("g")
    ahead = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("g", "part", "pc", F.coalesce(F.sum("pc").over(ahead), F.lit(0)).alias("before"),
                        F.sum("pc").over(of_group).alias("n"))
    # ranks asked for: below and above every probability's position, bounded by the number of probabilities
    asked = F.transform(F.lit([float(p) for p in probs]) if len(probs) else F.array().cast("array<double>"), lambda p, j: F.struct(
        j.alias("j"), F.floor(p * (F.col("n") - 1)).alias("lo"), F.ceil(p * (F.col("n") - 1)).alias("hi"),
        (p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))).alias("f")))
    inside = lambda x, side: F.filter(x, lambda a: (a[side] >= F.col("before")) & (a[side] < F.col("before") + F.col("pc")))
    wanted = parts.withColumn("a", asked)
    ranks = None
    for side in ("lo", "hi"):
        own = wanted.select("g", "part", "before", F.explode(inside("a", side)).alias("a")).select(
            "g", "part", (2 * (F.col(f"a.{side}") - F.col("before")) + 1).alias("key"), F.lit(None).cast("double").alias("v"),
            F.col("a.j").alias("j"), F.lit(side).alias("side"), F.col("a.f").alias("f"))
        ranks = own if ranks is None else ranks.unionByName(own)

    # within a range: the first value whose running count exceeds the rank
    up = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = ranged.select("g", "part", (2 * F.sum("c").over(up)).alias("key"), "v", F.lit(None).cast("int").alias("j"),
                           F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("f"))
    down = Window.partitionBy("g", "part").orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    found = values.unionByName(ranks).withColumn("at", F.last("v", ignorenulls=True).over(down)).where("j IS NOT NULL")
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("at")))
    each = found.groupBy("g", "j").agg(pick("lo").alias("lo"), pick("hi").alias("hi"), F.max("f").alias("f"))
    each = each.select("g", "j", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")).alias("x"))
    q = each.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda z: z["x"]).alias("q"))
    return q.select(*[F.col(f"g.{b}").alias(b) for b in by], F.col("g.name").alias("name"), "q")

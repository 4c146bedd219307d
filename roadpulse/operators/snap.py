"""Nearest-edge snapping (J4/G4, J2, P16, A4) over a grid and its halvings.

The finest grid has square cells that hold a few segments each; a segment is
keyed to the cells that it crosses. Level ``L`` halves the grid ``L`` times, and
a cell is occupied there if one of its parts is.

1. Descent: every point starts with the occupied cells of the coarsest level (four
   at most). Their occupied parts follow, level by level; of these a point keeps
   the ones that are no farther than the far corner of any other, since each
   holds a piece of a segment. A point far from the network keeps the cells that
   face it, one inside the network those around it.
2. Distance: an equi-join of each point's nearest cell with the segments in it
   gives an upper bound, which is mostly the distance itself.
3. Choice: all cells within that bound are joined with their segments; of the
   candidates within the bound, a few per point, the smallest ``(distance, u, v,
   key)`` is the nearest edge.

There is no candidate cap and no cross join. The joins are on ``(cx, cy)`` with
hot cells salted (see ``_salted_join``). Chords across the whole network cross
about as many cells as the square root of their number, short edges one or two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.geo import low_confidence, point_segment_distance
from roadpulse.session import stored, stored_with_metrics

SEGMENTS_PER_CELL = 8  # wanted on average, for a cell size taken from the data
LEVELS_A_JOB = 4  # levels of the descent that one job goes down


def _seg_cells(segs: DataFrame, cell: float, slack: float) -> DataFrame:
    """``segs`` with the finest cells ``(cx, cy)`` that each one crosses: per column
    of cells the rows between its heights at the column's two sides. ``slack``
    widens both, so that rounding loses no cell."""
    c, e = F.lit(cell), F.lit(slack)
    x0, x1 = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = segs.withColumn("cx", F.explode(F.sequence(F.floor((x0 - e) / c), F.floor((x1 + e) / c))))
    dx = F.col("bx") - F.col("ax")

    def height(x: Column) -> Column:
        return F.col("ay") + (F.col("by") - F.col("ay")) * ((x - F.col("ax")) / dx)

    h0 = height(F.least(x1, F.greatest(x0, F.col("cx") * c - e)))
    h1 = height(F.greatest(x0, F.least(x1, (F.col("cx") + 1) * c + e)))
    low = F.when(dx == 0, F.least("ay", "by")).otherwise(F.least(h0, h1))
    high = F.when(dx == 0, F.greatest("ay", "by")).otherwise(F.greatest(h0, h1))
    return columns.withColumn("cy", F.explode(F.sequence(F.floor((low - e) / c), F.floor((high + e) / c))))


def _salted_join(pc: DataFrame, sc: DataFrame, n_rows: int) -> DataFrame:
    """Point-cell x segment-cell equi-join that splits hot cells.

    The join multiplies rows (each point meets every segment of its cell), so
    both sides are hash-partitioned on the cell key with an explicit count
    (partitions sized by the small inputs would leave the work to a few
    tasks). A cell holding more than ``H = 2 * rows / partitions`` point rows
    is hot: its points are spread over ``ceil(count / H)`` salts and its
    segments replicated once per salt, so no task gets more than about H
    point rows of one cell. The hot-cell table has at most ``partitions / 2``
    rows, a bound that does not grow with the data, so it is broadcast.
    """
    spark = pc.sparkSession
    n_part = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["cx", "cy"]
    h = max(1, -(-2 * n_rows // n_part))
    hot = (pc.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > F.lit(h))
           .select(*keys, F.ceil(F.col("__n") / F.lit(h)).cast("int").alias("__salts")))
    hot = F.broadcast(hot)
    pcs = (pc.join(hot, keys, "left")
           .withColumn("__salt", F.when(F.col("__salts").isNull(), F.lit(0))
                       .otherwise(F.pmod(F.xxhash64("pid"), F.col("__salts")).cast("int")))
           .drop("__salts"))
    scs = (sc.join(hot, keys, "left")
           .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
           .drop("__salts"))
    k = keys + ["__salt"]
    return pcs.repartition(n_part, *k).join(scs.repartition(n_part, *k), k).drop("__salt")


def _cell_of(extent, n: int) -> float:
    """Side of a square that holds a few segments if they lie evenly."""
    wide, high = (extent["x1"] or 0.0) - (extent["x0"] or 0.0), (extent["y1"] or 0.0) - (extent["y0"] or 0.0)
    side = (wide * high * SEGMENTS_PER_CELL / max(n, 1)) ** 0.5 or max(wide, high) * SEGMENTS_PER_CELL / max(n, 1)
    return side or 1.0


def _reach(size: float) -> tuple[Column, Column]:
    """Distance from the point to the nearest and to the farthest place of its cell."""
    near, far = [], []
    for p, i in (("px", "cx"), ("py", "cy")):
        low, high = F.col(i) * F.lit(size) - F.col(p), F.col(p) - (F.col(i) + 1) * F.lit(size)
        near.append(F.greatest(low, high, F.lit(0.0)))
        far.append(F.greatest(F.abs(low), F.abs(high)))
    return F.hypot(*near), F.hypot(*far)


def _descend(points: DataFrame, occupied: DataFrame, cell: float, slack: float, top: int) -> DataFrame:
    """(pid, px, py, cx, cy, near): per point the finest cells that can hold its nearest segment."""
    first = occupied.where(F.col("lvl") == top).select("cx", "cy").collect()  # four at most
    cells = F.array(*[F.struct(F.lit(r["cx"]).alias("cx"), F.lit(r["cy"]).alias("cy")) for r in first])
    state = points.select("*", F.explode(cells).alias("__c")).select(*points.columns, "__c.*", F.lit(0.0).alias("near"))
    for lvl in range(top - 1, -1, -1):
        parts = occupied.where(F.col("lvl") == lvl).select(
            "cx", "cy", F.shiftright("cx", 1).alias("__px"), F.shiftright("cy", 1).alias("__py"))
        whole = state.drop("near").withColumnsRenamed({"cx": "__cx", "cy": "__cy"})
        finer = whole.join(parts, (F.col("__cx") == F.col("__px")) & (F.col("__cy") == F.col("__py"))).select("pid", "px", "py", "cx", "cy")
        near, far = _reach(cell * 2.0 ** lvl)
        bound = F.min(far).over(Window.partitionBy("pid"))
        # a piece of a segment lies in the cell or within the slack of it
        state = finer.withColumn("near", near).withColumn("__bound", bound).where(
            F.col("near") <= F.col("__bound") * F.lit(1 + 1e-9) + F.lit(4 * slack)).drop("__bound")
        if lvl and (top - lvl) % LEVELS_A_JOB == 0:
            state = stored(state)
    return state


def snap_to_edges(points: DataFrame, segments: DataFrame, cell: float | None = None, pid: str = "incident_id",
                  x: str = "x", y: str = "y") -> DataFrame:
    """``(pid, nearest_u, nearest_v, nearest_key, snap_distance)`` per point
    with coordinates. ``segments`` has ``u, v, key, ax, ay, bx, by``. Without
    ``cell`` the finest cell side follows from the number and the extent of the
    segments, so that cells stay about equally full as the network grows.
    """
    ends = ("ax", "ay", "bx", "by")
    segs = segments.select("u", "v", "key", *[F.col(c).cast("double").alias(c) for c in ends])
    segs = segs.where(F.isnotnull(F.col("ax") + F.col("ay") + F.col("bx") + F.col("by")))
    # read four times; dealt out evenly, since each segment is worth as many rows as it crosses cells
    segs = stored(segs.repartition(int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    every = (points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
             .select(F.col(pid).alias("pid"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")))
    extent = segs.agg(F.count(F.lit(1)).alias("n"), F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"),
                      F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1")).first()
    n_todo = every.count()
    if not n_todo or not extent["n"]:
        return points.sparkSession.createDataFrame(
            [], "pid long, nearest_u long, nearest_v long, nearest_key int, snap_distance double") \
            .withColumnRenamed("pid", pid)
    cell = float(cell or _cell_of(extent, extent["n"]))
    slack = cell * 1e-6 + max(abs(extent[c]) for c in ("x0", "x1", "y0", "y1")) * 1e-12
    wide = max(extent["x1"] - extent["x0"], extent["y1"] - extent["y0"]) + 2 * slack
    top = int(wide // cell + 2).bit_length()  # from there on at most two cells a side

    in_cells = _seg_cells(segs, cell, slack)
    levels = in_cells.select("cx", "cy").distinct().withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(top))))
    occupied = stored(levels.select("lvl", F.expr("shiftright(cx, lvl)").alias("cx"), F.expr("shiftright(cy, lvl)").alias("cy")).distinct())
    asked, m = stored_with_metrics(_descend(every, occupied, cell, slack, top), n=F.count(F.lit(1)))

    dist = point_segment_distance("px", "py", *ends)
    nearest = asked.groupBy("pid").agg(F.min_by(F.struct("px", "py", "cx", "cy"), "near").alias("c")).select("pid", "c.*")
    bound = stored(_salted_join(nearest, in_cells.select(*ends, "cx", "cy"), n_todo).groupBy("pid").agg(F.min(dist).alias("d")))
    within = F.col("near") <= F.col("d") * F.lit(1 + 1e-9) + F.lit(4 * slack)
    left, m = stored_with_metrics(asked.join(bound.withColumnRenamed("pid", "__pid"), F.col("pid").eqNullSafe(F.col("__pid")))
                                  .where(within).drop("__pid", "near"), n=F.count(F.lit(1)))
    # the bound itself is among the distances computed here, so every point keeps a candidate
    cand = _salted_join(left, in_cells, m["n"]).withColumn("__d", dist).where(F.col("__d") <= F.col("d"))
    best = cand.groupBy("pid").agg(F.min(F.struct(F.col("__d").alias("d"), "u", "v", "key")).alias("c"))
    out = stored(every.select(F.col("pid").alias("__pid")).join(best, F.col("pid").eqNullSafe(F.col("__pid"))).select(
        "pid", F.col("c.u").alias("nearest_u"), F.col("c.v").alias("nearest_v"),
        F.col("c.key").alias("nearest_key"), F.col("c.d").alias("snap_distance")))
    return out.withColumnRenamed("pid", pid)


def attach_snaps(df: DataFrame, snaps: DataFrame, pid: str = "incident_id") -> DataFrame:
    """J2 + P16: left join back to every row (rows without coordinates keep
    NULLs) and flag low-confidence snaps."""
    return (df.join(snaps, pid, "left")
            .withColumn("low_confidence_snap", low_confidence("snap_distance")))


def snap_summary(df: DataFrame, col: str = "snap_distance", limit: float = 750.0) -> DataFrame:
    """A4: min, p50, mean, p95, max, count and share above the limit."""
    from roadpulse.operators.order_stats import exact_quantiles
    df = stored(df.select(col))
    one = lambda t: t.withColumn("__one", F.lit(1))  # noqa: E731  one-row tables side by side
    q = exact_quantiles(df, {"q": col}, [0.5, 0.95]).select("q")
    rest = df.agg(F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max"), F.count(col).alias("n"),
                  F.count_if(F.col(col) > F.lit(limit)).alias("n_low_confidence"))
    return one(rest).join(F.broadcast(one(q)), "__one", "left").select(
        "min", F.col("q")[0].alias("p50"), "mean", F.col("q")[1].alias("p95"), "max", "n", "n_low_confidence",
        F.try_divide(F.col("n_low_confidence"), F.col("n")).alias("share_low_confidence"))

"""Dispatch queue, KPIs and roll-ups.

The queue is a DataFrame of scored incidents; every roll-up is an aggregate
(partial aggregation first, so a corridor holding a third of the queue costs
one pre-aggregated row per task). Top-n reports use ``orderBy().limit()``,
which Spark runs as a distributed top-k (TakeOrderedAndProject).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions import risk as rf
from roadpulse.functions import text, timefn

TIERS = ["Critical", "High", "Elevated", "Moderate", "Low"]


def build_queue(scored: DataFrame, is_new: bool = False, minutes: str = "predicted_resolution_minutes",
                ts: str = "split_timestamp") -> DataFrame:
    """Queue rows (15 columns). Ids come from the source key, not a counter."""
    return scored.select(
        F.concat(F.lit("INC-"), F.col("incident_id").cast("string")).alias("id"),
        "event_cause", "corridor", "zone",
        timefn.hour_of_day(timefn.to_local(ts)).alias("hour_of_day"),
        "latitude", "longitude",
        rf.round_half_even("closure_probability", 3).alias("closure_prob"),
        rf.round_half_even(rf.floor_zero(minutes), 1).alias("resolution_min"),
        rf.round_half_even("centrality_score", 5).alias("centrality"),
        F.col("cascade_risk_score").alias("crs"),
        "priority",
        F.lit(is_new).alias("is_new"),
        timefn.load_stamp().alias("reported_at"),
        F.lit("Active").alias("status"),
    )


def order_queue(q: DataFrame) -> DataFrame:
    """CRS descending, id as the tie-break."""
    return q.orderBy(F.desc("crs"), F.asc("id"))


def append(q: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Union all by name."""
    return q.unionByName(new_rows)


def kpis(q: DataFrame) -> DataFrame:
    """Active count, count per tier, mean CRS, readiness = 100 - min(95, mean)."""
    avg = F.avg("crs")
    return q.agg(F.count(F.lit(1)).alias("n_active"),
                 *[F.count_if(F.col("priority") == t).alias(f"n_{t.lower()}") for t in TIERS],
                 F.round(avg, 6).alias("avg_crs"),
                 F.round(F.lit(100.0) - F.least(F.lit(95.0), F.coalesce(avg, F.lit(0.0))), 6).alias("readiness"))


def status_of():
    """A10: any Critical -> Elevated, any High -> Heightened, else Normal."""
    return (F.when(F.col("n_critical") > 0, "Elevated Operations")
            .when(F.col("n_high") > 0, "Heightened Operations")
            .otherwise("Normal Operations"))


def ops_status(k: DataFrame) -> DataFrame:
    return k.select(status_of().alias("ops_status"))


def corridor_rollup(q: DataFrame) -> DataFrame:
    """Total CRS and count per corridor."""
    return q.groupBy("corridor").agg(F.sum("crs").alias("total_crs"), F.count(F.lit(1)).alias("count"))


def top_corridors(q: DataFrame, n: int = 5) -> DataFrame:
    """W4 + W9: top-n corridors by total CRS (name breaks ties) with rank labels."""
    top = corridor_rollup(q).orderBy(F.desc("total_crs"), F.asc("corridor")).limit(n)
    w = Window.orderBy(F.desc("total_crs"), F.asc("corridor"))  # over the n kept rows only
    return top.withColumn("rank", F.row_number().over(w)).withColumn(
        "rank_label", F.concat(F.col("rank").cast("string"), F.lit(".")))


def insight(q: DataFrame) -> DataFrame:
    """Top corridor and top incident in one row; empty queue -> defaults.

    Ties: the smallest corridor name / incident id wins. Each side is one
    aggregate with an ordering (no totals are computed twice and compared);
    they are combined by a union, not a join.
    """
    roll = corridor_rollup(q)
    corr = roll.agg(F.min_by(F.struct("corridor", "count", "total_crs"), F.struct(-F.col("total_crs"), F.col("corridor"))).alias("c"))
    inc = q.agg(F.min_by(F.struct("id", "crs"), F.struct(-F.col("crs"), F.col("id"))).alias("i"))
    both = (corr.select("c", F.lit(None).cast("struct<id:string,crs:double>").alias("i"))
            .unionByName(inc.select(F.lit(None).cast(corr.schema["c"].dataType).alias("c"), "i")))
    agg = both.agg(F.first("c", ignorenulls=True).alias("c"), F.first("i", ignorenulls=True).alias("i"))
    return agg.select(F.coalesce(F.col("c.corridor"), F.lit("—")).alias("corridor"),
                      F.coalesce(F.col("c.count"), F.lit(0)).cast("long").alias("incident_count"),
                      F.coalesce(F.col("c.total_crs"), F.lit(0.0)).alias("total_crs"),
                      F.coalesce(F.col("i.id"), F.lit("—")).alias("top_id"),
                      F.coalesce(F.col("i.crs"), F.lit(0.0)).alias("top_crs"))


def hour_histogram(q: DataFrame) -> DataFrame:
    """Incidents per hour of day, 24 zero-filled bins."""
    hours = q.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_of_day"))
    counts = q.groupBy("hour_of_day").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(hours).join(counts, "hour_of_day", "left").select(
        "hour_of_day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def risk_composition(q: DataFrame) -> DataFrame:
    """Closure %, duration % and centrality % behind a score."""
    return q.select("id", (F.col("closure_prob") * F.lit(100.0)).alias("closure_pct"),
                    rf.duration_pct("resolution_min").alias("duration_pct"),
                    rf.centrality_pct("centrality").alias("centrality_pct"))


def dispatch_labels(q: DataFrame) -> DataFrame:
    """Display strings for each queue row."""
    return q.select(
        "id",
        text.display_title("event_cause").alias("title"),
        F.concat_ws(" · ", "id", text.display_title("event_cause")).alias("tooltip"),
        F.concat_ws(" · ", "corridor", "zone").alias("location"),
        text.hour_label("hour_of_day").alias("hour_label"),
        text.percent_label("closure_prob").alias("closure_label"),
        text.minutes_label("resolution_min").alias("duration_label"),
        rf.closure_badge("closure_prob").alias("closure_badge"),
        rf.tier_action("priority").alias("action"),
        rf.tier_recommendation("priority").alias("recommendation"),
    )


def select_incident(q: DataFrame, incident_id: str) -> DataFrame:
    """the chosen row, else the top of the queue (one distributed top-1)."""
    return q.orderBy(F.when(F.col("id") == incident_id, 0).otherwise(1), F.desc("crs"), F.asc("id")).limit(1)

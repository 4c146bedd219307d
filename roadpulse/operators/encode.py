"""Categorical vocabularies and target encoding.

All statistics are fitted on TRAIN rows only. Every encoder is an aggregate
(``groupBy(category[, fold])`` with map-side partial aggregation, so a category
holding a third of all rows is pre-summed in every task) joined back on the
category. The joined side has one row per category (per fold): Spark/AQE
broadcasts it when its measured size is under the broadcast threshold and
otherwise shuffles it, with AQE splitting a skewed category partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.hashing import fold_of
from roadpulse.session import stored

# Encoder settings.
SMOOTHING = 20.0
N_FOLDS = 5
SEED = 42
NULL_CATEGORY = "nan"


def vocabulary(train: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted distinct TRAIN values per feature -> (feature, value, idx).

    A distributed dense rank: the distinct pairs are range-partitioned on
    (feature, value), numbered inside each range partition, and shifted by
    the number of the feature's values in earlier partitions (a counts table
    of at most partitions x features rows). No task ever holds a whole
    feature, however many levels it has.
    """
    long = None
    for c in cols:
        part = train.where(F.col(c).isNotNull()).select(F.lit(c).alias("feature"),
                                                       F.col(c).cast("string").alias("value")).distinct()
        long = part if long is None else long.unionByName(part)
    n_part = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the partition id is materialised once (reliable checkpoint) so both
    # branches below see the same assignment, even after a recompute
    ranged = stored(long.repartitionByRange(n_part, "feature", "value")
                         .withColumn("pid", F.spark_partition_id()))
    local = ranged.withColumn("rn", F.row_number().over(
        Window.partitionBy("pid", "feature").orderBy("value")))      # one range partition at a time
    counts = ranged.groupBy("feature", "pid").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("offset", F.coalesce(F.sum("c").over(
        Window.partitionBy("feature").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(before.select("feature", "pid", "offset"), ["feature", "pid"])
            .select("feature", "value", (F.col("offset") + F.col("rn") - 1).cast("int").alias("idx")))


def apply_vocabulary(df: DataFrame, vocab: DataFrame, cols: list[str], suffix: str = "_idx") -> DataFrame:
    """P25: value -> index in the TRAIN vocabulary; unseen or NULL -> NULL."""
    out = df
    for c in cols:
        v = vocab.where(F.col("feature") == c).select(F.col("value").alias(f"__v_{c}"),
                                                       F.col("idx").alias(f"{c}{suffix}"))
        out = out.join(v, F.col(c).cast("string") == F.col(f"__v_{c}"), "left").drop(f"__v_{c}")
    return out


def unseen_counts(df: DataFrame, vocab: DataFrame, cols: list[str], by: str = "split") -> DataFrame:
    """Rows per split whose non-null category never occurs in TRAIN."""
    parts = None
    for c in cols:
        v = vocab.where(F.col("feature") == c).select(F.col("value").alias("__v"))
        miss = (df.where(F.col(c).isNotNull())
                .join(v, F.col(c).cast("string") == F.col("__v"), "left_anti")
                .groupBy(by).agg(F.count(F.lit(1)).alias("n_unseen"))
                .withColumn("feature", F.lit(c)))
        parts = miss if parts is None else parts.unionByName(miss)
    return parts


def _cat(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_CATEGORY))


def global_mean(train: DataFrame, label: str) -> float:
    return train.agg(F.avg(F.col(label).cast("double")).alias("g")).first()["g"]


def encoder_table(train: DataFrame, col: str, label: str, g: float, smoothing: float = SMOOTHING) -> DataFrame:
    """M2: full-TRAIN smoothed mean per category -> (value, te)."""
    y = F.col(label).cast("double")
    s = F.lit(smoothing)
    return (train.groupBy(_cat(col).alias("value"))
            .agg(F.sum(y).alias("sy"), F.count(F.lit(1)).alias("n"))
            .select("value", ((F.col("sy") + s * F.lit(g)) / (F.col("n") + s)).alias("te")))


def target_encode_oof(train: DataFrame, col: str, label: str, key: str = "incident_id",
                      smoothing: float = SMOOTHING, n_folds: int = N_FOLDS, seed: int = SEED,
                      g: float | None = None, out: str | None = None) -> DataFrame:
    """M1: out-of-fold smoothed target encoding of TRAIN rows.

    Fold = md5(seed:key) mod n_folds. Per (category, fold) sums and counts are
    aggregated once; the out-of-fold statistic of a row is the category total
    minus its own fold, so no row sees its own label. A category absent from
    the other folds gets the global mean through the same formula.
    """
    out = out or f"{col}_te"
    g = global_mean(train, label) if g is None else g
    y = F.col(label).cast("double")
    t = train.withColumns({"__fold": fold_of(seed, key, n_folds), "__cat": _cat(col)})
    per = t.groupBy("__cat", "__fold").agg(F.sum(y).alias("__sy"), F.count(F.lit(1)).alias("__n"))
    tot = per.groupBy("__cat").agg(F.sum("__sy").alias("__ty"), F.sum("__n").alias("__tn"))
    stats = per.join(tot, "__cat").select(
        "__cat", "__fold", ((F.col("__ty") - F.col("__sy") + F.lit(smoothing) * F.lit(g)) /
                            (F.col("__tn") - F.col("__n") + F.lit(smoothing))).alias(out))
    return t.join(stats, ["__cat", "__fold"], "left").drop("__cat", "__fold")


def apply_encoder(df: DataFrame, enc: DataFrame, col: str, g: float, out: str | None = None) -> DataFrame:
    """Map join with the global mean as default."""
    out = out or f"{col}_te"
    e = enc.select(F.col("value").alias("__val"), F.col("te").alias("__te"))
    return (df.join(e, _cat(col) == F.col("__val"), "left")
            .withColumn(out, F.coalesce(F.col("__te"), F.lit(g))).drop("__val", "__te"))

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.session import scratch_path

# ASCII letters are the only ones that the contracts lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared scratch folder and read it back.

    Cuts the lineage and fixes anything that depends on how the input was
    partitioned (row ids, blocks), so a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128-bit digest of the whole text. What these operators find out about a
    document depends on its text alone, so rows are linked by it: null or
    repeated ids need no special care and copies share one entry."""
    return F.unhex(F.md5(text))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def exact_rank(df: DataFrame, group: list[str], key: Column, out: str, parts: int = 256) -> DataFrame:
    """Gapless rank from 0 within ``group`` without sorting a group in one task.

    Rows of a group are spread over ``parts`` buckets by a hash of ``key``;
    the bucket counts (a table of groups x parts rows) give each bucket its
    offset, and only rows of one bucket are numbered by a window.
    """
    from pyspark.sql import Window
    part = F.pmod(F.xxhash64(F.lit(out), key), F.lit(parts)).cast("int")
    df = df.withColumn("_part", part)
    counts = df.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_part").orderBy(key)
    ranked = df.withColumn("_r", F.row_number().over(inside))
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group] + [F.col("_part") == F.col("_p")]
    joined = ranked.join(offsets, on, "inner")
    return (joined.withColumn(out, (F.col("_r") - 1 + F.col("_before")).cast("long"))
            .drop("_part", "_p", "_n", "_r", "_before", *[f"_g_{c}" for c in group]))

"""Intake validation (F3, F4, F5): rule columns and a quarantine split.

Each rule is a boolean column; a row is valid when every rule holds. Allowed
category lists are the TRAIN vocabulary, checked with a semi-join-shaped left
join (so the check grows with the data, not with a driver-side list).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Intake domain of the incident form.
FORM_LAT = (12.80, 13.30)
FORM_LON = (77.38, 77.76)
CENTRALITY_RANGE = (0.0, 0.07)
SNAP_RANGE = (0.0, 500.0)


def rule_columns(df: DataFrame) -> dict:
    rules = {}
    if "hour_of_day" in df.columns:
        rules["ok_hour"] = F.col("hour_of_day").between(0, 23)
    if "day_of_week" in df.columns:
        rules["ok_dow"] = F.col("day_of_week").between(0, 6)
    if "month" in df.columns:
        rules["ok_month"] = F.col("month").between(1, 12)
    if "latitude" in df.columns:
        rules["ok_lat"] = F.col("latitude").between(*FORM_LAT)
    if "longitude" in df.columns:
        rules["ok_lon"] = F.col("longitude").between(*FORM_LON)
    if "centrality_score" in df.columns:
        rules["ok_centrality"] = F.col("centrality_score").between(*CENTRALITY_RANGE)
    if "snap_distance_m" in df.columns:
        rules["ok_snap"] = F.col("snap_distance_m").between(*SNAP_RANGE)
    return rules


def validate(df: DataFrame, vocab: DataFrame | None = None, vocab_cols: list[str] | None = None) -> DataFrame:
    """adds one ``ok_*`` column per rule, ``n_failed`` and ``is_valid``."""
    rules = rule_columns(df)
    out = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()})
    names = list(rules)
    for c in vocab_cols or []:
        v = vocab.where(F.col("feature") == c).select(F.col("value").alias(f"__ok_{c}"))
        out = (out.join(v, F.col(c).cast("string") == F.col(f"__ok_{c}"), "left")
               .withColumn(f"ok_{c}", F.col(f"__ok_{c}").isNotNull()).drop(f"__ok_{c}"))
        names.append(f"ok_{c}")
    failed = sum((F.when(F.col(n), 0).otherwise(1) for n in names), F.lit(0))
    return out.withColumn("n_failed", failed).withColumn("is_valid", F.col("n_failed") == 0)


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows without the rule columns, rejected rows with the
    names of the rules they broke in ``reasons``)."""
    rules = [c for c in validated.columns if c.startswith("ok_")]
    reasons = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c.removeprefix("ok_"))) for c in rules]))
    plain = [c for c in validated.columns if c not in (*rules, "n_failed", "is_valid")]
    return (validated.where("is_valid").select(*plain),
            validated.where("NOT is_valid").withColumn("reasons", reasons).select(*plain, "reasons"))

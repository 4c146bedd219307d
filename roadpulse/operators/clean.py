"""Step 1 operators: lifecycle, resolution window, flags, normalisation, fills.

All functions are ``DataFrame -> DataFrame`` and add no action; rejection
accounting is one aggregate over the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions import text, timefn

# Resolution window in minutes (inclusive both ends).
WINDOW_MIN = 0.0
WINDOW_MAX = 1440.0

# Categorical columns filled with a constant, and the fill.
CATEGORICAL_FILLS = {"veh_type": "unknown", "corridor": "unknown", "zone": "unknown", "junction": "unknown"}

# Columns removed before modelling (absent names are ignored).
DROP_COLUMNS = [
    "end_ts", "resolved_datetime", "closed_datetime", "end_datetime", "modified_datetime",
    "closed_by_id", "resolved_by_id", "resolved_at_address", "resolved_at_latitude",
    "resolved_at_longitude", "priority", "id", "veh_no", "kgid", "gba_identifier", "client_id",
    "created_by_id", "last_modified_by_id", "assigned_to_police_id", "citizen_accident_id",
    "closed_by_id", "map_file", "direction", "end_address", "cargo_material", "reason_breakdown",
    "age_of_truck", "route_path", "comment", "meta_data", "event_type", "start_datetime",
    "created_date", "status", "authenticated", "endlatitude", "endlongitude", "police_station",
]
NON_FEATURE_COLUMNS = ["split_timestamp"]


def parse_timestamps(df: DataFrame, cols=("start_datetime", "resolved_datetime",
                                          "closed_datetime", "created_date")) -> DataFrame:
    """Tolerant parse of the string timestamp columns that are present."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: timefn.parse_ts(c) for c in present})


def count_unparseable(df: DataFrame, col: str) -> int:
    """Missing or unparseable values of a timestamp column."""
    parsed = timefn.parse_ts(col) if dict(df.dtypes)[col] == "string" else F.col(col).cast("timestamp")
    return df.agg(F.count_if(parsed.isNull()).alias("n")).first()["n"]


def strict_parse(df: DataFrame, col: str) -> DataFrame:
    """Parse a column; any missing or unparseable value is an error that
    tells how many there are. One count over the column alone goes ahead."""
    bad = count_unparseable(df, col)
    if bad:
        raise ValueError(f"{bad} rows have an unparseable or missing {col!r}")
    parsed = timefn.parse_ts(col) if dict(df.dtypes)[col] == "string" else F.col(col).cast("timestamp")
    return df.withColumn(col, parsed)


def with_resolution_minutes(df: DataFrame) -> DataFrame:
    """P3 + P4: end = coalesce(resolved, closed); exact elapsed minutes."""
    end = timefn.first_non_null("resolved_datetime", "closed_datetime")
    return df.withColumns({
        "end_ts": end,
        "resolution_minutes": timefn.elapsed_minutes("start_datetime", end),
    })


def in_window(col: str = "resolution_minutes", lo: float = WINDOW_MIN, hi: float = WINDOW_MAX) -> Column:
    return F.col(col).isNotNull() & (F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi))


def filter_resolution_window(df: DataFrame, lo: float = WINDOW_MIN, hi: float = WINDOW_MAX) -> DataFrame:
    """keep rows with a non-null resolution time in [lo, hi]."""
    return df.where(in_window(lo=lo, hi=hi))


def rejection_counts(df: DataFrame, lo: float = WINDOW_MIN, hi: float = WINDOW_MAX) -> DataFrame:
    """one aggregate row — rows before, removed per reason, kept, retention %."""
    r = F.col("resolution_minutes")
    return (df.agg(F.count(F.lit(1)).alias("n_before_filter"),
                   F.count_if(r.isNull()).alias("removed_no_end"),
                   F.count_if(r < F.lit(lo)).alias("removed_negative"),
                   F.count_if(r > F.lit(hi)).alias("removed_over_window"),
                   F.count_if(in_window(lo=lo, hi=hi)).alias("n_after_filter"))
            .withColumn("retention_pct",
                        F.round(F.try_divide(F.col("n_after_filter") * 100.0, F.col("n_before_filter")), 6)))


def with_planned_flag(df: DataFrame) -> DataFrame:
    """event_type == 'planned' -> 1, anything else (incl. NULL) -> 0."""
    return df.withColumn("is_planned",
                         F.coalesce(F.col("event_type") == "planned", F.lit(False)).cast("int"))


def with_temporal_features(df: DataFrame, ts: str = "start_datetime") -> DataFrame:
    """Local wall clock, hour, Monday-0 weekday, month, split key."""
    local = timefn.to_local(ts)
    return df.withColumns({
        "hour_of_day": timefn.hour_of_day(local),
        "day_of_week": timefn.day_of_week_monday0(local),
        "month": timefn.month_of_year(local),
        "split_timestamp": local,
    })


def normalise_event_cause(df: DataFrame, col: str = "event_cause") -> DataFrame:
    """P10."""
    return df.withColumn(col, text.strip_lower(col))


def fill_categoricals(df: DataFrame, fills: dict | None = None) -> DataFrame:
    """Constant fill of the categoricals that are present."""
    fills = {k: v for k, v in (fills or CATEGORICAL_FILLS).items() if k in df.columns}
    return df.fillna(fills) if fills else df


def fill_counts(df: DataFrame, fills: dict | None = None) -> DataFrame:
    """P14 accounting: how many NULLs each fill replaces (one aggregate)."""
    cols = [c for c in (fills or CATEGORICAL_FILLS) if c in df.columns]
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def drop_unusable(df: DataFrame) -> DataFrame:
    """Drop-list projection, tolerant of absent names."""
    return df.drop(*DROP_COLUMNS)


def clean_pipeline(raw: DataFrame, lo: float = WINDOW_MIN, hi: float = WINDOW_MAX) -> DataFrame:
    """Step 1 end to end: resolution time -> window -> flags -> features -> fill.

    The window filter sits right after the derived column so Catalyst runs
    it before every later projection.
    """
    df = with_resolution_minutes(raw)
    df = filter_resolution_window(df, lo, hi)
    df = with_planned_flag(df)
    df = with_temporal_features(df)
    df = normalise_event_cause(df)
    df = drop_unusable(df)
    return fill_categoricals(df)


def filter_with_accounting(df: DataFrame, lo: float = WINDOW_MIN, hi: float = WINDOW_MAX):
    """F1 + F2 in one pass: the kept rows, plus an ``Observation`` whose
    metrics (rows before, removed per reason, kept) are filled by whichever
    action consumes the kept rows — no second scan for the accounting."""
    from pyspark.sql import Observation
    obs = Observation("resolution_window")
    r = F.col("resolution_minutes")
    observed = df.observe(obs,
                          F.count(F.lit(1)).alias("n_before_filter"),
                          F.count_if(r.isNull()).alias("removed_no_end"),
                          F.count_if(r < F.lit(lo)).alias("removed_negative"),
                          F.count_if(r > F.lit(hi)).alias("removed_over_window"),
                          F.count_if(in_window(lo=lo, hi=hi)).alias("n_after_filter"))
    return observed.where(in_window(lo=lo, hi=hi)), obs

"""Catalogue: chronological split, split audits, verified recovery."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roadpulse.functions import timefn
from roadpulse.operators import clean, split
from roadpulse.plans.adapters import X1_SQL, X2_SQL, x1_lifecycle, x2_incidents
from roadpulse.plans.registry import query
from roadpulse.session import scratch_path

W2 = f"WITH x2 AS ({X2_SQL})"


def split_sql(src_cte: str, ts: str, key: str) -> str:
    """Oracle form: a global row_number (fine for the oracle, not for Spark)."""
    return f"""{src_cte},
  numbered AS (SELECT *, row_number() OVER (ORDER BY {ts}, {key}) AS rn, count(*) OVER () AS n FROM src),
  cuts AS (SELECT *, CAST(round_even(n * 0.7e0, 0) AS BIGINT) AS n_train,
                  CAST(round_even(n * 0.15e0, 0) AS BIGINT) AS n_val FROM numbered),
  split_rows AS (SELECT *, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'val'
                            ELSE 'test' END AS split FROM cuts)"""


X2_SPLIT_SQL = split_sql(f"WITH src AS ({X2_SQL})", "split_timestamp", "incident_id")


def x2_split(spark, sf_dir):
    return split.chronological_split(x2_incidents(spark, sf_dir))


@query("chronological_split", f"{X2_SPLIT_SQL} SELECT incident_id, split FROM split_rows")
def q_chronological_split(spark, sf_dir):
    return x2_split(spark, sf_dir).select("incident_id", "split")


@query("chronological_split_ties",
       f"{split_sql(f'WITH src AS ({X1_SQL})', 'start_datetime', 'incident_id')} SELECT incident_id, split FROM split_rows")
def q_chronological_split_ties(spark, sf_dir):
    """Order dates repeat heavily: the cuts fall inside groups of equal timestamps."""
    df = split.chronological_split(x1_lifecycle(spark, sf_dir), ts="start_datetime")
    return df.select("incident_id", "split")


@query("split_ranges", f"""{X2_SPLIT_SQL}
SELECT split, count(*) AS n, strftime(min(split_timestamp), '%Y-%m-%d %H:%M:%S.%f') AS ts_min,
       strftime(max(split_timestamp), '%Y-%m-%d %H:%M:%S.%f') AS ts_max,
       round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM split_rows GROUP BY split""")
def q_split_ranges(spark, sf_dir):
    r = split.split_ranges(x2_split(spark, sf_dir))
    return r.select("split", "n", timefn.ts_text("ts_min").alias("ts_min"),
                    timefn.ts_text("ts_max").alias("ts_max"), "share")


@query("split_order_check", f"""{X2_SPLIT_SQL}
SELECT (max(CASE WHEN split = 'train' THEN split_timestamp END) <= min(CASE WHEN split = 'val' THEN split_timestamp END))
   AND (max(CASE WHEN split = 'val' THEN split_timestamp END) <= min(CASE WHEN split = 'test' THEN split_timestamp END))
   AS ordered FROM split_rows""")
def q_split_order_check(spark, sf_dir):
    return split.straddle_ok(split.split_ranges(x2_split(spark, sf_dir)))


@query("class_balance", f"""{X2_SPLIT_SQL}
SELECT split, count(*) AS n, CAST(count_if(requires_road_closure) AS BIGINT) AS positive,
       CAST(count_if(NOT requires_road_closure) AS BIGINT) AS negative,
       round(count_if(requires_road_closure) / count(*)::DOUBLE, 6) AS positive_rate,
       count_if(requires_road_closure) < 10 AS few_positives
FROM split_rows GROUP BY split""")
def q_class_balance(spark, sf_dir):
    return split.class_balance(x2_split(spark, sf_dir))


@query("verified_recovery", f"""{W2}
SELECT incident_id, strftime(split_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS split_timestamp FROM x2""")
def q_verified_recovery(spark, sf_dir):
    """The enriched table lost its split key; recover it from the clean table by id after the gate."""
    ready = x2_incidents(spark, sf_dir)
    enriched = ready.drop("split_timestamp")
    rec = split.recover_column(enriched, ready, "incident_id", "split_timestamp")
    return rec.select("incident_id", timefn.ts_text("split_timestamp").alias("split_timestamp"))


def _perturbed(ready):
    """A copy with data-driven damage: tiny float noise (tolerated), real
    float drift, a NULL where a value was, and lost rows."""
    lat = (F.when(F.col("event_cause") == "click", F.col("latitude") + F.lit(1e-7))
           .when(F.col("event_cause") == "error", F.col("latitude") + F.lit(1e-3))
           .otherwise(F.col("latitude")))
    lon = F.when(F.col("event_cause") == "view", F.lit(None).cast("double")).otherwise(F.col("longitude"))
    return (ready.where(F.col("event_cause") != "purchase")
            .withColumns({"latitude": lat, "longitude": lon}))


@query("recovery_audit", f"""{W2}, dmg AS (
  SELECT * REPLACE (
    CASE WHEN event_cause = 'click' THEN latitude + 1e-7 WHEN event_cause = 'error' THEN latitude + 1e-3
         ELSE latitude END AS latitude,
    CASE WHEN event_cause = 'view' THEN NULL ELSE longitude END AS longitude)
  FROM x2 WHERE event_cause <> 'purchase'),
 j AS (SELECT r.incident_id AS rid, l.incident_id AS lid, l.latitude AS la, r.latitude AS ra,
              l.longitude AS lo, r.longitude AS ro, l.resolution_minutes AS lm, r.resolution_minutes AS rm,
              l.corridor AS lc, r.corridor AS rc
       FROM dmg l FULL OUTER JOIN x2 r ON l.incident_id = r.incident_id)
SELECT CAST(count_if(lid IS NULL OR rid IS NULL) AS BIGINT) AS __missing_key,
       CAST(count_if(lid IS NOT NULL AND rid IS NOT NULL AND NOT (la IS NULL AND ra IS NULL) AND
                ((la IS NULL) <> (ra IS NULL) OR coalesce(abs(la - ra) > 1e-6 + 1e-6 * abs(ra), false))) AS BIGINT) AS latitude,
       CAST(count_if(lid IS NOT NULL AND rid IS NOT NULL AND NOT (lo IS NULL AND ro IS NULL) AND
                ((lo IS NULL) <> (ro IS NULL) OR coalesce(abs(lo - ro) > 1e-6 + 1e-6 * abs(ro), false))) AS BIGINT) AS longitude,
       CAST(count_if(lid IS NOT NULL AND rid IS NOT NULL AND NOT (lm IS NULL AND rm IS NULL) AND
                ((lm IS NULL) <> (rm IS NULL) OR coalesce(abs(lm - rm) > 1e-6 + 1e-6 * abs(rm), false))) AS BIGINT) AS resolution_minutes,
       CAST(count_if(lid IS NOT NULL AND rid IS NOT NULL AND NOT (lc IS NULL AND rc IS NULL) AND
                ((lc IS NULL) <> (rc IS NULL) OR coalesce(lc <> rc, false))) AS BIGINT) AS corridor
FROM j""")
def q_recovery_audit(spark, sf_dir):
    ready = x2_incidents(spark, sf_dir).select("incident_id", "latitude", "longitude", "resolution_minutes",
                                               "corridor", "event_cause")
    dmg = _perturbed(ready).drop("event_cause")
    return split.alignment_mismatches(dmg, ready.drop("event_cause"), "incident_id")


_EXPORT = ["latitude", "longitude", "resolution_minutes", "corridor", "event_cause"]


def _exports(spark, sf_dir, drop_first=False):
    """Two CSV exports without id, in id order and over different numbers of
    files: one with the split key, one without; read back with row numbers."""
    from roadpulse.sources import incidents as src
    ready = x2_incidents(spark, sf_dir).withColumn("split_timestamp", timefn.ts_text("split_timestamp"))
    frames = []
    for files, columns, rows in ((3, _EXPORT, ready), (5, [*_EXPORT, "split_timestamp"], ready.where("incident_id <> 0") if drop_first else ready)):
        path = scratch_path(spark, f"export-{uuid.uuid4().hex}")
        src.write_table(rows.repartitionByRange(files, "incident_id").sortWithinPartitions("incident_id").select(*columns), path, "csv")
        ddl = ", ".join(f"{c} {'string' if c in ('corridor', 'event_cause', 'split_timestamp') else 'double'}" for c in columns)
        scan = spark.read.schema(ddl).option("header", True).csv(path)
        frames.append(src.with_row_numbers(scan, split.POSITION))
    return frames


@query("positional_recovery", f"""{W2}
SELECT latitude, longitude, resolution_minutes, corridor, event_cause, strftime(split_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS split_timestamp FROM x2""")
def q_positional_recovery(spark, sf_dir):
    """J1 without a key: the lost column comes back by row position, after every
    shared column of every row has been compared."""
    target, source = _exports(spark, sf_dir)
    return split.recover_by_position(target, source, "split_timestamp").select(*_EXPORT, "split_timestamp")


@query("positional_recovery_gate", f"""{W2},
  l AS (SELECT *, row_number() OVER (ORDER BY incident_id) AS i FROM x2),
  r AS (SELECT *, row_number() OVER (ORDER BY incident_id) AS i FROM x2 WHERE incident_id <> (SELECT min(incident_id) FROM x2 WHERE incident_id = 0)),
  j AS (SELECT l.i AS li, r.i AS ri, l.latitude AS la, r.latitude AS ra, l.longitude AS lo, r.longitude AS ro,
               l.resolution_minutes AS lm, r.resolution_minutes AS rm, l.corridor AS lc, r.corridor AS rc, l.event_cause AS le, r.event_cause AS re
        FROM l FULL OUTER JOIN r ON l.i = r.i)
SELECT count_if(li IS NULL OR ri IS NULL)::BIGINT AS missing_rows,
       count_if(abs(la - ra) > 1e-6 + 1e-6 * abs(ra))::BIGINT AS latitude, count_if(abs(lo - ro) > 1e-6 + 1e-6 * abs(ro))::BIGINT AS longitude,
       count_if((lm IS NULL) <> (rm IS NULL) AND li IS NOT NULL AND ri IS NOT NULL OR abs(lm - rm) > 1e-6 + 1e-6 * abs(rm))::BIGINT AS resolution_minutes,
       count_if(lc <> rc)::BIGINT AS corridor, count_if(le <> re)::BIGINT AS event_cause, true AS refused FROM j""")
def q_positional_recovery_gate(spark, sf_dir):
    """One file lost its first row, so all rows moved up; the gate counts
    what disagrees and the recovery refuses."""
    target, source = _exports(spark, sf_dir, drop_first=True)
    try:
        split.recover_by_position(target, source, "split_timestamp")
        refused = False
    except ValueError:
        refused = True
    found = split.positional_mismatches(target, source, exclude=("split_timestamp",))
    return found.withColumnRenamed("__missing_key", "missing_rows").withColumn("refused", F.lit(refused))


@query("strict_timestamp_gate", f"""{W2}
SELECT count(*) AS n, CAST(count_if(split_timestamp IS NULL) AS BIGINT) AS n_unparseable,
       CAST(count_if(incident_id % 23 = 0 OR incident_id % 29 = 0) AS BIGINT) AS n_damaged FROM x2""")
def q_strict_timestamp_gate(spark, sf_dir):
    """Text timestamps re-parsed strictly; in a copy with bad and missing
    texts the gate counts each of them."""
    df = x2_incidents(spark, sf_dir).select("incident_id", timefn.ts_text("split_timestamp").alias("split_timestamp"))
    parsed = clean.strict_parse(df, "split_timestamp")
    i = F.col("incident_id")
    bad = clean.count_unparseable(df.withColumn("split_timestamp", F.when(i % 23 == 0, "no time").when(
        i % 29 != 0, F.col("split_timestamp"))), "split_timestamp")
    return parsed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split_timestamp").isNull()).alias("n_unparseable"),
                      F.lit(bad).cast("long").alias("n_damaged"))

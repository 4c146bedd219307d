"""Catalogue: vocabularies, target encoding, sampling, geo flags, validation
(A18, P25, J7, W8, M1, M2, P26, M3, W7, P17, F3-F5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse.functions import geo
from roadpulse.functions.hashing import fold_of, seeded_hash_sql, seeded_order_sql
from roadpulse.functions import timefn
from roadpulse.operators import encode, sampling, validate
from roadpulse.plans.catalog_split import X2_SPLIT_SQL, x2_split
from roadpulse.plans.registry import query

CATS = ["event_cause", "corridor", "zone", "junction"]
LABEL = "requires_road_closure"


def _train(spark, sf_dir):
    return x2_split(spark, sf_dir).where(F.col("split") == "train")


_VOCAB_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM split_rows WHERE split = 'train' AND {c} IS NOT NULL"
    for c in CATS)
VOCAB_SQL = f"""{X2_SPLIT_SQL},
  vocab AS (SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS idx
            FROM ({_VOCAB_SQL}))"""


@query("vocabulary", f"{VOCAB_SQL} SELECT feature, value, idx FROM vocab")
def q_vocabulary(spark, sf_dir):
    return encode.vocabulary(_train(spark, sf_dir), CATS)


@query("category_index", f"""{VOCAB_SQL}
SELECT incident_id, ve.idx AS event_cause_idx, vz.idx AS zone_idx FROM split_rows s
LEFT JOIN (SELECT * FROM vocab WHERE feature = 'event_cause') ve ON s.event_cause = ve.value
LEFT JOIN (SELECT * FROM vocab WHERE feature = 'zone') vz ON s.zone = vz.value""")
def q_category_index(spark, sf_dir):
    df = x2_split(spark, sf_dir)
    vocab = encode.vocabulary(df.where(F.col("split") == "train"), ["event_cause", "zone"])
    return encode.apply_vocabulary(df, vocab, ["event_cause", "zone"]).select(
        "incident_id", "event_cause_idx", "zone_idx")


# some junctions that occur once and so, outside TRAIN, were never seen; some without any
_ODD_JUNCTION_SQL = """CASE WHEN incident_id % 17 = 0 THEN NULL WHEN incident_id % 13 = 0
  THEN 'N' || CAST(incident_id AS VARCHAR) ELSE junction END"""
_UNSEEN_SQL = " UNION ALL ".join(
    f"""SELECT split, '{c}' AS feature, count(*) AS n_unseen FROM odd s
        WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM odd v WHERE v.split = 'train' AND v.{c} = s.{c})
        GROUP BY split""" for c in CATS)


def odd_junctions(df):
    i = F.col("incident_id")
    return df.withColumn("junction", F.when(i % 17 == 0, F.lit(None).cast("string")).when(
        i % 13 == 0, F.concat(F.lit("N"), i.cast("string"))).otherwise(F.col("junction")))


@query("unseen_categories", f"""{X2_SPLIT_SQL},
  odd AS (SELECT * REPLACE ({_ODD_JUNCTION_SQL} AS junction) FROM split_rows) {_UNSEEN_SQL}""")
def q_unseen_categories(spark, sf_dir):
    df = odd_junctions(x2_split(spark, sf_dir))
    vocab = encode.vocabulary(df.where(F.col("split") == "train"), CATS)
    return encode.unseen_counts(df, vocab, CATS).select("split", "feature", "n_unseen")


def _te_sql(col):
    fold = f"({seeded_hash_sql(42, 'incident_id')}) % 5"
    return f"""
  t_{col} AS (SELECT *, {fold} AS fold, coalesce(CAST({col} AS VARCHAR), 'nan') AS cat FROM tr),
  per_{col} AS (SELECT cat, fold, sum(CASE WHEN {LABEL} THEN 1e0 ELSE 0e0 END) AS sy, count(*) AS n FROM t_{col} GROUP BY 1, 2),
  tot_{col} AS (SELECT cat, sum(sy) AS ty, sum(n) AS tn FROM per_{col} GROUP BY 1),
  enc_{col} AS (SELECT p.cat, p.fold, (ty - sy + 20e0 * g) / (tn - n + 20e0) AS te
                FROM per_{col} p JOIN tot_{col} USING (cat), gm),
  oof_{col} AS (SELECT t.incident_id, coalesce(e.te, g) AS {col}_te FROM t_{col} t, gm
                LEFT JOIN enc_{col} e ON e.cat = t.cat AND e.fold = t.fold)"""


TE_BASE = f"""{X2_SPLIT_SQL},
  tr AS (SELECT * FROM split_rows WHERE split = 'train'),
  gm AS (SELECT avg(CASE WHEN {LABEL} THEN 1e0 ELSE 0e0 END) AS g FROM tr)"""


@query("target_encode_oof", f"""{TE_BASE}, {_te_sql('junction')}, {_te_sql('zone')}
SELECT j.incident_id, round(junction_te, 6) AS junction_te, round(zone_te, 6) AS zone_te
FROM oof_junction j JOIN oof_zone z USING (incident_id)""")
def q_target_encode_oof(spark, sf_dir):
    tr = _train(spark, sf_dir)
    g = encode.global_mean(tr, LABEL)
    j = encode.target_encode_oof(tr, "junction", LABEL, g=g)
    both = encode.target_encode_oof(j, "zone", LABEL, g=g)
    return both.select("incident_id", F.round("junction_te", 6).alias("junction_te"),
                       F.round("zone_te", 6).alias("zone_te"))


@query("target_encode_full", f"""{TE_BASE}
SELECT 'junction' AS feature, coalesce(CAST(junction AS VARCHAR), 'nan') AS value,
       round((sum(CASE WHEN {LABEL} THEN 1e0 ELSE 0e0 END) + 20e0 * any_value(g)) / (count(*) + 20e0), 6) AS te
FROM tr, gm GROUP BY 2""")
def q_target_encode_full(spark, sf_dir):
    tr = _train(spark, sf_dir)
    g = encode.global_mean(tr, LABEL)
    e = encode.encoder_table(tr, "junction", LABEL, g)
    return e.select(F.lit("junction").alias("feature"), "value", F.round("te", 6).alias("te"))


@query("target_encode_apply", f"""{TE_BASE},
  enc AS (SELECT coalesce(CAST(zone AS VARCHAR), 'nan') AS value,
                 (sum(CASE WHEN {LABEL} THEN 1e0 ELSE 0e0 END) + 20e0 * any_value(g)) / (count(*) + 20e0) AS te
          FROM tr, gm GROUP BY 1)
SELECT incident_id, round(coalesce(e.te, g), 6) AS zone_te FROM split_rows s CROSS JOIN gm
LEFT JOIN enc e ON e.value = coalesce(CAST(s.zone AS VARCHAR), 'nan') WHERE split <> 'train'""")
def q_target_encode_apply(spark, sf_dir):
    df = x2_split(spark, sf_dir)
    tr = df.where(F.col("split") == "train")
    g = encode.global_mean(tr, LABEL)
    e = encode.encoder_table(tr, "zone", LABEL, g)
    out = encode.apply_encoder(df.where(F.col("split") != "train"), e, "zone", g)
    return out.select("incident_id", F.round("zone_te", 6).alias("zone_te"))


@query("fold_assignment", f"""{X2_SPLIT_SQL}
SELECT ({seeded_hash_sql(42, 'incident_id')}) % 5 AS fold, count(*) AS n FROM split_rows WHERE split = 'train' GROUP BY 1""")
def q_fold_assignment(spark, sf_dir):
    tr = _train(spark, sf_dir)
    return tr.groupBy(fold_of(42, "incident_id", 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


_H60 = "('0x' || substr(md5('42:' || CAST(incident_id AS VARCHAR)), 1, 15))::BIGINT"


@query("oversample", f"""{X2_SPLIT_SQL},
  tr AS (SELECT * FROM split_rows WHERE split = 'train'),
  c AS (SELECT count_if({LABEL}) AS pos, count_if(NOT {LABEL}) AS neg FROM tr),
  plan AS (SELECT pos, greatest(CAST(round_even(neg * 0.5e0, 0) AS BIGINT) - pos, 0) AS extra FROM c),
  ranked AS (SELECT incident_id, row_number() OVER (ORDER BY {_H60}, incident_id) AS rn FROM tr WHERE {LABEL})
SELECT t.incident_id, CAST(1 + CASE WHEN t.{LABEL} THEN extra // pos + CASE WHEN r.rn <= extra % pos THEN 1 ELSE 0 END
                          ELSE 0 END AS BIGINT) AS copies
FROM tr t CROSS JOIN plan LEFT JOIN ranked r USING (incident_id)""")
def q_oversample(spark, sf_dir):
    o = sampling.oversample(_train(spark, sf_dir), LABEL)
    return o.groupBy("incident_id").agg(F.count(F.lit(1)).alias("copies"))


@query("oversample_draw", f"""{X2_SPLIT_SQL},
  tr AS (SELECT * FROM split_rows WHERE split = 'train'),
  c AS (SELECT count_if({LABEL}) AS pos, count_if(NOT {LABEL}) AS neg FROM tr),
  plan AS (SELECT pos, greatest(CAST(round_even(neg * 0.5e0, 0) AS BIGINT) - pos, 0) AS extra FROM c),
  d AS (SELECT unnest(range(extra::BIGINT)) AS i, pos FROM plan),
  drawn AS (SELECT ('0x' || substr(md5('42:draw:' || CAST(i AS VARCHAR)), 1, 15))::BIGINT % pos AS rank, count(*) AS times FROM d GROUP BY 1),
  ranked AS (SELECT incident_id, row_number() OVER (ORDER BY incident_id) - 1 AS rank FROM tr WHERE {LABEL}),
  n AS (SELECT t.incident_id, CAST(coalesce(times, 0) AS BIGINT) AS times FROM tr t LEFT JOIN ranked USING (incident_id) LEFT JOIN drawn USING (rank))
SELECT incident_id, draw, ('0x' || substr(md5('42:' || CAST(incident_id AS VARCHAR) || ':' || CAST(draw AS VARCHAR)), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT incident_id, unnest(range(times + 1))::INT AS draw FROM n)""")
def q_oversample_draw(spark, sf_dir):
    """M3 as drawn with replacement: some positives never, some several times, the total exact."""
    return sampling.oversample_with_replacement(_train(spark, sf_dir), LABEL).select("incident_id", "draw", "shuffle_key")


@query("seeded_sample", f"""{X2_SPLIT_SQL}
SELECT incident_id FROM split_rows WHERE split = 'val' ORDER BY {seeded_order_sql(42, 'incident_id')}, incident_id LIMIT 14""")
def q_seeded_sample(spark, sf_dir):
    val = x2_split(spark, sf_dir).where(F.col("split") == "val")
    return sampling.seeded_sample(val, 14).select("incident_id")


@query("dist_from_center", f"""{X2_SPLIT_SQL}
SELECT incident_id, round(sqrt((latitude - 12.9716e0) * (latitude - 12.9716e0) +
                               (longitude - 77.5946e0) * (longitude - 77.5946e0)), 9) AS dist_from_center FROM split_rows""")
def q_dist_from_center(spark, sf_dir):
    return x2_split(spark, sf_dir).select("incident_id", F.round(geo.dist_from_center(), 9).alias("dist_from_center"))


@query("bbox_flags", f"""{X2_SPLIT_SQL}
SELECT CAST(count_if(latitude IS NULL OR longitude IS NULL) AS BIGINT) AS n_missing_coords,
       CAST(count_if(latitude IS NOT NULL AND longitude IS NOT NULL AND
                NOT (latitude BETWEEN 12.7e0 AND 13.3e0 AND longitude BETWEEN 77.3e0 AND 77.9e0)) AS BIGINT) AS n_outside_bbox
FROM (SELECT * REPLACE (CASE WHEN incident_id % 19 <> 0 THEN latitude END AS latitude,
                        CASE WHEN incident_id % 23 <> 0 THEN longitude END AS longitude) FROM split_rows)""")
def q_bbox_flags(spark, sf_dir):
    """F3 + F4 on rows of which some lack a coordinate."""
    i = F.col("incident_id")
    df = x2_split(spark, sf_dir).withColumns({"latitude": F.when(i % 19 != 0, F.col("latitude")),
                                              "longitude": F.when(i % 23 != 0, F.col("longitude"))})
    return df.agg(F.count_if(geo.missing_coords()).alias("n_missing_coords"),
                  F.count_if(geo.outside_bbox()).alias("n_outside_bbox"))


@query("domain_validation", f"""{VOCAB_SQL},
  feats AS (SELECT incident_id, event_cause, latitude, longitude,
                   hour(split_timestamp + INTERVAL 330 MINUTE) AS hour_of_day,
                   isodow(split_timestamp + INTERVAL 330 MINUTE) - 1 AS day_of_week,
                   month(split_timestamp + INTERVAL 330 MINUTE) AS month FROM split_rows WHERE split <> 'train'),
  flags AS (SELECT incident_id,
     (CASE WHEN coalesce(hour_of_day BETWEEN 0 AND 23, false) THEN 0 ELSE 1 END) +
     (CASE WHEN coalesce(day_of_week BETWEEN 0 AND 6, false) THEN 0 ELSE 1 END) +
     (CASE WHEN coalesce(month BETWEEN 1 AND 12, false) THEN 0 ELSE 1 END) +
     (CASE WHEN coalesce(latitude BETWEEN 12.8e0 AND 13.3e0, false) THEN 0 ELSE 1 END) +
     (CASE WHEN coalesce(longitude BETWEEN 77.38e0 AND 77.76e0, false) THEN 0 ELSE 1 END) +
     (CASE WHEN EXISTS (SELECT 1 FROM vocab v WHERE v.feature = 'event_cause' AND v.value = feats.event_cause)
           THEN 0 ELSE 1 END) AS n_failed FROM feats)
SELECT incident_id, n_failed, n_failed = 0 AS is_valid FROM flags""")
def q_domain_validation(spark, sf_dir):
    df = x2_split(spark, sf_dir)
    vocab = encode.vocabulary(df.where(F.col("split") == "train"), ["event_cause"])
    local = timefn.to_local("split_timestamp")
    feats = df.where(F.col("split") != "train").select(
        "incident_id", "event_cause", "latitude", "longitude",
        timefn.hour_of_day(local).alias("hour_of_day"), timefn.day_of_week_monday0(local).alias("day_of_week"),
        timefn.month_of_year(local).alias("month"))
    v = validate.validate(feats, vocab, ["event_cause"])
    return v.select("incident_id", "n_failed", "is_valid")

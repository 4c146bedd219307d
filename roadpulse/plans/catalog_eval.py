"""Catalogue: evaluation on the deterministic X5 scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse.operators import evaluate as ev
from roadpulse.plans.catalog_risk import X5_SPLIT_SQL, x5_with_split
from roadpulse.plans.registry import query

Y, P = "requires_road_closure", "closure_probability"
YR, PR = "resolution_minutes", "predicted_resolution_minutes"
_GRID = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(ev.THRESHOLDS))

SWEEP_SQL = f"""{X5_SPLIT_SQL},
  val AS (SELECT * FROM split_rows WHERE split = 'val'),
  grid AS (SELECT * FROM (VALUES {_GRID}) g(i, threshold)),
  cnt AS (SELECT i, threshold, count_if({Y} AND {P} >= threshold) AS tp, count_if(NOT {Y} AND {P} >= threshold) AS fp,
                 count_if({Y} AND NOT ({P} >= threshold)) AS fn FROM grid, val GROUP BY i, threshold),
  sweep AS (SELECT i, threshold,
                   coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0) AS f1,
                   coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0e0) AS precision,
                   coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0e0) AS recall FROM cnt),
  best AS (SELECT * FROM sweep ORDER BY f1 DESC, i LIMIT 1),
  test AS (SELECT s.*, {P} >= (SELECT threshold FROM best) AS pred FROM split_rows s WHERE split = 'test')"""


def _val_test(spark, sf_dir):
    df = x5_with_split(spark, sf_dir)
    return df.where(F.col("split") == "val"), df.where(F.col("split") == "test"), df


def _best(spark, sf_dir):
    val, test, df = _val_test(spark, sf_dir)
    best = ev.best_threshold(ev.threshold_sweep(val, Y, P)).first()
    return best, test, df


@query("threshold_sweep", f"""{SWEEP_SQL}
SELECT i, threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sweep""")
def q_threshold_sweep(spark, sf_dir):
    val, _, _ = _val_test(spark, sf_dir)
    s = ev.threshold_sweep(val, Y, P)
    return s.select("i", "threshold", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")])


@query("best_threshold", f"""{SWEEP_SQL}
SELECT threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM best""")
def q_best_threshold(spark, sf_dir):
    val, _, _ = _val_test(spark, sf_dir)
    b = ev.best_threshold(ev.threshold_sweep(val, Y, P))
    return b.select("threshold", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")])


@query("classification_metrics", f"""{SWEEP_SQL},
  c AS (SELECT count_if({Y} AND pred) AS tp, count_if(NOT {Y} AND pred) AS fp, count_if({Y} AND NOT pred) AS fn,
               count_if(NOT {Y} AND NOT pred) AS tn FROM test)
SELECT round(coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0e0), 6) AS accuracy,
       round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0e0), 6) AS precision,
       round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0e0), 6) AS recall,
       round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0), 6) AS f1 FROM c""")
def q_classification_metrics(spark, sf_dir):
    best, test, _ = _best(spark, sf_dir)
    m = ev.classification_metrics(test.withColumn("pred", F.col(P) >= F.lit(best["threshold"])), Y, "pred")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("confusion_matrix", f"""{SWEEP_SQL}
SELECT d.actual, d.predicted, coalesce(n, 0)::BIGINT AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(actual, predicted)
LEFT JOIN (SELECT CAST({Y} AS INTEGER) AS actual, CAST(pred AS INTEGER) AS predicted, count(*) AS n FROM test GROUP BY 1, 2) c
  USING (actual, predicted)""")
def q_confusion_matrix(spark, sf_dir):
    best, test, _ = _best(spark, sf_dir)
    return ev.confusion_counts(test.withColumn("pred", F.col(P) >= F.lit(best["threshold"])), Y, "pred")


@query("roc_auc", f"""{X5_SPLIT_SQL},
  test AS (SELECT * FROM split_rows WHERE split = 'test'),
  pos AS (SELECT {P} AS s FROM test WHERE {Y}), neg AS (SELECT {P} AS s FROM test WHERE NOT {Y})
SELECT round(CASE WHEN (SELECT count(*) FROM pos) > 0 AND (SELECT count(*) FROM neg) > 0 THEN
  (SELECT sum(CASE WHEN p.s > n.s THEN 1e0 WHEN p.s = n.s THEN 0.5e0 ELSE 0e0 END) FROM pos p, neg n)
  / ((SELECT count(*) FROM pos) * (SELECT count(*) FROM neg)) END, 9) AS roc_auc""")
def q_roc_auc(spark, sf_dir):
    _, test, _ = _val_test(spark, sf_dir)
    return ev.roc_auc(test, Y, P).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("regression_metrics", f"""{X5_SPLIT_SQL},
  tr AS (SELECT * FROM split_rows WHERE split = 'train'),
  b AS (SELECT quantile_cont({YR}, 0.5) AS med, avg({YR}) AS mean FROM tr),
  test AS (SELECT s.*, b.med, b.mean FROM split_rows s, b WHERE split = 'test'),
  preds AS (SELECT 'model' AS model, {YR} AS y, {PR} AS p FROM test UNION ALL
            SELECT 'median_baseline', {YR}, med FROM test UNION ALL SELECT 'mean_baseline', {YR}, mean FROM test)
SELECT model, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
       round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)), 6) AS r2,
       round(quantile_cont(abs(p - y), 0.5), 6) AS medae FROM preds GROUP BY model""")
def q_regression_metrics(spark, sf_dir):
    df = x5_with_split(spark, sf_dir)
    b = ev.baselines(df.where(F.col("split") == "train"), YR, Y).first()
    test = df.where(F.col("split") == "test")
    out = ev.regression_metrics(test, YR, {"model": PR, "median_baseline": F.lit(b["train_median"]),
                                           "mean_baseline": F.lit(b["train_mean"])})
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2", "medae")])


@query("baselines", f"""{X5_SPLIT_SQL}, tr AS (SELECT * FROM split_rows WHERE split = 'train')
SELECT round(quantile_cont({YR}, 0.5), 6) AS train_median, round(avg({YR}), 6) AS train_mean,
       mode(CAST({Y} AS INTEGER) ORDER BY CAST({Y} AS INTEGER)) AS majority_class FROM tr""")
def q_baselines(spark, sf_dir):
    df = x5_with_split(spark, sf_dir)
    b = ev.baselines(df.where(F.col("split") == "train"), YR, Y)
    return b.select(F.round("train_median", 6).alias("train_median"), F.round("train_mean", 6).alias("train_mean"),
                    "majority_class")


@query("majority_baseline_metrics", f"""{X5_SPLIT_SQL},
  tr AS (SELECT * FROM split_rows WHERE split = 'train'),
  maj AS (SELECT mode(CAST({Y} AS INTEGER) ORDER BY CAST({Y} AS INTEGER)) AS m FROM tr),
  c AS (SELECT count_if({Y} AND m = 1) AS tp, count_if(NOT {Y} AND m = 1) AS fp, count_if({Y} AND m = 0) AS fn,
               count_if(NOT {Y} AND m = 0) AS tn FROM split_rows, maj WHERE split = 'test')
SELECT round(coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0e0), 6) AS accuracy,
       round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0e0), 6) AS precision,
       round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0e0), 6) AS recall,
       round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0), 6) AS f1 FROM c""")
def q_majority_baseline_metrics(spark, sf_dir):
    df = x5_with_split(spark, sf_dir)
    maj = ev.baselines(df.where(F.col("split") == "train"), YR, Y).first()["majority_class"]
    test = df.where(F.col("split") == "test").withColumn("pred", F.lit(maj == 1))
    m = ev.classification_metrics(test, Y, "pred")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("diagnostic_flags", f"""{SWEEP_SQL},
  reg AS (SELECT 1 - sum(({PR} - {YR}) * ({PR} - {YR})) / (var_pop({YR}) * count({YR})) AS r2 FROM test),
  pos AS (SELECT {P} AS s FROM test WHERE {Y}), neg AS (SELECT {P} AS s FROM test WHERE NOT {Y}),
  auc AS (SELECT sum(CASE WHEN p.s > n.s THEN 1e0 WHEN p.s = n.s THEN 0.5e0 ELSE 0e0 END)
                 / ((SELECT count(*) FROM pos) * (SELECT count(*) FROM neg)) AS roc_auc FROM pos p, neg n),
  bal AS (SELECT min(c) AS min_pos FROM (SELECT split, count_if({Y}) AS c FROM split_rows GROUP BY split))
SELECT r2 < 0.3e0 AS weak_regression, coalesce(roc_auc < 0.75e0 AND NOT isnan(roc_auc), false) AS weak_classifier,
       min_pos < 10 AS few_positives FROM reg, auc, bal""")
def q_diagnostic_flags(spark, sf_dir):
    df = x5_with_split(spark, sf_dir)
    test = df.where(F.col("split") == "test")
    reg = ev.regression_metrics(test, YR, {"model": PR}).select("r2")
    auc = ev.roc_auc(test, Y, P)
    bal = (df.groupBy("split").agg(F.count_if(F.col(Y)).alias("c")).agg(F.min("c").alias("min_pos")))
    # three one-row frames side by side: union into one row instead of a join
    both = (reg.select("r2", F.lit(None).cast("double").alias("roc_auc"), F.lit(None).cast("long").alias("min_pos"))
            .unionByName(auc.select(F.lit(None).cast("double").alias("r2"), "roc_auc",
                                    F.lit(None).cast("long").alias("min_pos")))
            .unionByName(bal.select(F.lit(None).cast("double").alias("r2"), F.lit(None).cast("double").alias("roc_auc"),
                                    "min_pos")))
    row = both.agg(F.max("r2").alias("r2"), F.max("roc_auc").alias("roc_auc"), F.max("min_pos").alias("min_pos"))
    return row.select(*ev.diagnostics("r2", "roc_auc", "min_pos"))

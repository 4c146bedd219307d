"""Catalogue: boosted-tree models.

A tree ensemble has no SQL form; what the oracle checks is what must hold
whatever the trees are: the row set, the ranges of the predictions, the
feature list."""

from __future__ import annotations

import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadpulse.functions import geo, timefn
from roadpulse.operators import encode, learn, sampling
from roadpulse.operators.risk import RiskScorer
from roadpulse.plans.catalog_eval import SWEEP_SQL
from roadpulse.plans.catalog_features import _ODD_JUNCTION_SQL, odd_junctions
from roadpulse.plans.catalog_risk import FIT_SQL, X5_SPLIT_SQL, x5_with_split
from roadpulse.plans.registry import query
from roadpulse.session import scratch_path, stored

NUMERIC = ["latitude", "longitude", "hour_of_day", "day_of_week", "month", "is_planned", "centrality_score", "snap_distance_m",
           "low_confidence_snap"]
REG_SPEC = learn.FeatureSpec(numeric=[*NUMERIC, "junction_te"], categorical=["event_cause", "veh_type", "corridor", "zone"])
CLF_SPEC = learn.FeatureSpec(numeric=[*NUMERIC, "junction_te", "zone_te", "dist_from_center"],
                             categorical=["event_cause", "veh_type", "corridor"])
Y_REG, Y_CLF = "resolution_minutes", "requires_road_closure"
VEHICLES = ["car", "truck", "bus", "two_wheeler"]


def incidents(spark, sf_dir):
    """The feature row of every labelled incident. What the events table
    lacks (planned flag, snap distance, vehicle) is derived from the id."""
    df = x5_with_split(spark, sf_dir)
    local = timefn.to_local("split_timestamp")
    i = F.col("incident_id")
    df = df.withColumns({"hour_of_day": timefn.hour_of_day(local), "day_of_week": timefn.day_of_week_monday0(local),
                         "month": timefn.month_of_year(local), "dist_from_center": geo.dist_from_center(),
                         "is_planned": (i % 7 == 0).cast("int"), "snap_distance_m": ((i * 31) % 1000).cast("double"),
                         "veh_type": F.get(F.array(*map(F.lit, VEHICLES)), (i % 5).cast("int")),  # every fifth has none
                         "is_val": F.col("split") == "val"})
    return df.withColumn("low_confidence_snap", geo.low_confidence("snap_distance_m").cast("int"))


def _for_fit(df, spec, label):
    """What a fit reads of ``df``, which has other columns as well."""
    return df.select("incident_id", "is_val", label, *[c for c in spec.columns if c in df.columns])


def _encoded(df, cols, label, spec):
    """(what a fit reads of TRAIN rows, with out-of-fold encodings, other rows with TRAIN's encodings)."""
    tr, rest = df.where(F.col("split") == "train"), df.where(F.col("split") != "train")
    raw = [c for c in cols if c not in spec.columns]
    tr = tr.select("incident_id", "is_val", label, *raw, *[c for c in spec.columns if c in df.columns])
    g = tr.agg(F.avg(F.col(label).cast("double"))).first()[0]
    fitted = tr
    for c in cols:
        fitted = encode.target_encode_oof(fitted, c, label, g=g)
        rest = encode.apply_encoder(rest, encode.encoder_table(tr, c, label, g), c, g)
    return _for_fit(fitted, spec, label), rest


# Models fitted in this session: queries on the same tables share one fit.
_FITTED: dict = {}
_LOCKS: defaultdict = defaultdict(Lock)


def _once(kind, spark, sf_dir, fit):
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    with _LOCKS[key]:
        if key not in _FITTED:
            _FITTED[key] = fit()
    return _FITTED[key]


def _incidents(spark, sf_dir):
    """``incidents`` written once for all that reads them: both models, the scorer, the artefacts."""
    return _once("incidents", spark, sf_dir, lambda: stored(incidents(spark, sf_dir)))


def _regressor(spark, sf_dir):
    """(TEST rows as encoded for the regressor, fitted model)."""
    def fit():
        learn.assert_no_leak(REG_SPEC, Y_CLF)
        tr, rest = _encoded(_incidents(spark, sf_dir), ["junction"], Y_REG, REG_SPEC)
        rows = stored(tr.unionByName(_for_fit(rest.where(F.col("split") == "val"), REG_SPEC, Y_REG)))
        return stored(rest.where(F.col("split") == "test")), learn.fit_regressor(rows, REG_SPEC, Y_REG)
    return _once("regressor", spark, sf_dir, fit)


def _classifier(spark, sf_dir):
    """(VAL and TEST rows as encoded for the classifier, fitted model); TRAIN is oversampled."""
    def fit():
        learn.assert_no_leak(CLF_SPEC, Y_REG)
        tr, rest = _encoded(_incidents(spark, sf_dir), ["junction", "zone"], Y_CLF, CLF_SPEC)
        rest = stored(rest)
        val = _for_fit(rest.where(F.col("split") == "val"), CLF_SPEC, Y_CLF)
        rows = stored(sampling.oversample_with_replacement(tr, Y_CLF).drop("draw", "shuffle_key").unionByName(val))
        return rest, learn.fit_classifier(rows, CLF_SPEC, Y_CLF)
    return _once("classifier", spark, sf_dir, fit)


def _together(spark, *fits) -> list:
    """The results of fits that do not need each other, run at the same time: each
    one is a long row of short jobs, which alone leaves most cores idle."""
    with ThreadPoolExecutor(len(fits)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(fit)) for fit in fits]]


def _models(spark, sf_dir):
    """What ``_regressor`` and ``_classifier`` return."""
    return _together(spark, lambda: _regressor(spark, sf_dir), lambda: _classifier(spark, sf_dir))


_LISTS = ["event_cause", "veh_type", "corridor", "zone", "junction"]


def _artifacts(spark, sf_dir):
    """Folder with all that inference needs, written once a session and table set."""
    def fit():
        from roadpulse.operators import artifacts
        from roadpulse.operators import evaluate as ev
        train = _incidents(spark, sf_dir).where(F.col("split") == "train")
        (_, reg), (rest, clf) = _models(spark, sf_dir)
        encoders = {}
        for model, cols, label in (("regressor", ["junction"], Y_REG), ("classifier", ["junction", "zone"], Y_CLF)):
            g = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
            encoders |= {(model, c): (encode.encoder_table(train, c, label, g), g) for c in cols}
        val = rest.where(F.col("split") == "val").drop("closure_probability")
        best = ev.best_threshold(ev.threshold_sweep(learn.predict_probability(clf.model, val, CLF_SPEC), Y_CLF, "closure_probability")).first()
        folder = scratch_path(spark, f"artifacts-{uuid.uuid4().hex}")
        artifacts.save(spark, folder, {"regressor": reg.model, "classifier": clf.model}, {"regressor": REG_SPEC, "classifier": CLF_SPEC}, encoders,
                       RiskScorer().fit(train), encode.vocabulary(train, _LISTS), _LISTS, best["threshold"])
        return folder
    return _once("artifacts", spark, sf_dir, fit)


_TEST = f"{X5_SPLIT_SQL} SELECT incident_id, true AS valid FROM split_rows WHERE split = 'test'"


@query("gbt_regressor", _TEST)
def q_gbt_regressor(spark, sf_dir):
    """M6 + M8: every TEST row gets minutes, none of them negative."""
    test, fitted = _regressor(spark, sf_dir)
    p = learn.predict_minutes(fitted.model, test, REG_SPEC)
    return p.select("incident_id", F.coalesce(F.col("predicted_resolution_minutes") >= 0, F.lit(False)).alias("valid"))


@query("gbt_classifier", _TEST)
def q_gbt_classifier(spark, sf_dir):
    """M7 + M8: every TEST row gets a probability."""
    rest, fitted = _classifier(spark, sf_dir)
    p = learn.predict_probability(fitted.model, rest.where(F.col("split") == "test"), CLF_SPEC)
    return p.select("incident_id", F.coalesce(F.col("closure_probability").between(0.0, 1.0), F.lit(False)).alias("valid"))


_FEATURES = ", ".join(f"('{c}')" for c in REG_SPEC.columns)


@query("feature_importance", f"SELECT feature, true AS valid FROM (VALUES {_FEATURES}) f(feature)")
def q_feature_importance(spark, sf_dir):
    """M10 + W6 + S10: all features of the regressor, the useful ones with positive
    gain, written as CSV and read back; ranks are gapless and follow the gain."""
    _, fitted = _regressor(spark, sf_dir)
    imp = learn.feature_importance(fitted.model, REG_SPEC, scratch_path(spark, f"trees-{uuid.uuid4().hex}"), top=15)
    path = scratch_path(spark, f"importance-{uuid.uuid4().hex}")
    learn.write_importance(imp, path)
    better = Window.orderBy("rank")  # one row per feature
    read = learn.read_importance(spark, path).withColumns({
        "before": F.lag("gain_importance").over(better), "nth": F.row_number().over(better)})
    return read.select("feature", ((F.col("gain_importance") >= 0) & (
        (F.col("split_importance") > 0) | (F.col("gain_importance") == 0)) & (F.col("rank") == F.col("nth")) & F.coalesce(
            F.col("before") >= F.col("gain_importance"), F.lit(True))).alias("valid"))


@query("predict", f"""{X5_SPLIT_SQL}
SELECT incident_id, true AS valid, true AS scored FROM split_rows WHERE split = 'test'""")
def q_predict(spark, sf_dir):
    """M8 + M13: both models on TEST rows, then the TRAIN-fitted risk scorer."""
    (test, reg), (rest, clf) = _models(spark, sf_dir)
    ctest = rest.where(F.col("split") == "test")
    minutes = learn.predict_minutes(reg.model, test.drop("predicted_resolution_minutes"), REG_SPEC)
    prob = learn.predict_probability(clf.model, ctest.drop("closure_probability"), CLF_SPEC).select("incident_id", "closure_probability")
    p = minutes.drop("closure_probability").join(prob, "incident_id")
    train = _incidents(spark, sf_dir).where(F.col("split") == "train")
    s = RiskScorer().fit(train).score(p)
    ok = F.col("closure_probability").between(0.0, 1.0) & (F.col("predicted_resolution_minutes") >= 0)
    return s.select("incident_id", F.coalesce(ok, F.lit(False)).alias("valid"),
                    (F.col("cascade_risk_score").between(0.0, 100.0) & F.col("priority").isNotNull()).alias("scored"))


@query("model_evaluation", f"""{X5_SPLIT_SQL}
SELECT 'regression' AS part, count(*) AS n, true AS better, true AS in_range FROM split_rows WHERE split = 'test'
UNION ALL SELECT 'classification', count(*), true, true FROM split_rows WHERE split = 'test'""")
def q_model_evaluation(spark, sf_dir):
    """E1 E2 E5 on the fitted models' own predictions: the regressor is held
    against the TRAIN-mean baseline, the classifier is cut at the threshold
    tuned on the validation rows' predictions."""
    from roadpulse.operators import evaluate as ev
    (test, reg), (rest, clf) = _models(spark, sf_dir)
    minutes = learn.predict_minutes(reg.model, test.drop("predicted_resolution_minutes"), REG_SPEC)
    mean = ev.baselines(_incidents(spark, sf_dir).where(F.col("split") == "train"), Y_REG, Y_CLF).first()["train_mean"]
    m = {r["model"]: r for r in ev.regression_metrics(
        minutes, Y_REG, {"model": "predicted_resolution_minutes", "mean": F.lit(mean)}).collect()}
    val = rest.where(F.col("split") == "val")
    best = ev.best_threshold(ev.threshold_sweep(learn.predict_probability(clf.model, val.drop("closure_probability"), CLF_SPEC),
                                                Y_CLF, "closure_probability")).first()
    ctest = learn.predict_probability(clf.model, rest.where(F.col("split") == "test").drop("closure_probability"), CLF_SPEC)
    c = ev.classification_metrics(ctest.withColumn("pred", F.col("closure_probability") >= best["threshold"]), Y_CLF, "pred").first()
    n = test.count()
    # random targets: the model must at least not be far behind the mean
    rows = [("regression", n, m["model"]["rmse"] <= 1.25 * m["mean"]["rmse"], m["model"]["mae"] >= 0.0),
            ("classification", ctest.count(), 0.01 <= best["threshold"] <= 0.99, all(0.0 <= c[k] <= 1.0 for k in ("accuracy", "precision", "recall", "f1")))]
    return spark.createDataFrame(rows, "part string, n long, better boolean, in_range boolean")


# planted: minutes that add up from many features, plus the event's own value as noise; closures by their rule alone
_PLANTED_SQL = f"""{X5_SPLIT_SQL},
  f AS (SELECT incident_id, split, hour(split_timestamp + INTERVAL 330 MINUTE) AS h, isodow(split_timestamp + INTERVAL 330 MINUTE) - 1 AS d,
               resolution_minutes, latitude, longitude, CASE WHEN incident_id % 7 = 0 THEN 30e0 ELSE 0e0 END AS planned FROM split_rows),
  y AS (SELECT split, planned + 3e0 * h + 8e0 * d + 80e0 * (latitude - 12.65e0) + 80e0 * (longitude - 77.25e0)
               + 0.1e0 * resolution_minutes AS y FROM f),
  m AS (SELECT avg(y) AS mean FROM y WHERE split = 'train')
"""


def _planted(spark, sf_dir):
    """Rows with ``planted`` (minutes) and ``planted_class`` (over 130 minutes before the noise)."""
    df = incidents(spark, sf_dir)
    rule = (F.when(F.col("is_planned") == 1, 30.0).otherwise(0.0) + 3.0 * F.col("hour_of_day") + 8.0 * F.col("day_of_week")
            + 80.0 * (F.col("latitude") - 12.65) + 80.0 * (F.col("longitude") - 77.25))
    df = (df.withColumn("junction_te", F.lit(0.0)).withColumn("zone_te", F.lit(0.0))
          .withColumn("planted", rule + 0.1 * F.col("resolution_minutes")).withColumn("planted_class", rule > 130))
    return stored(df.select("split", "is_val", "planted", "planted_class", *dict.fromkeys(REG_SPEC.columns + CLF_SPEC.columns)))


@query("boosting_rounds", f"""{_PLANTED_SQL}
SELECT 'regressor' AS model, count(*) AS n, round(sqrt(avg((y - mean) * (y - mean))), 6) AS mean_rmse, true AS many_trees,
       true AS round_is_best, true AS patience_kept, true AS beats_one_tree FROM y, m WHERE split = 'test'
UNION ALL SELECT 'classifier', count(*), NULL, true, true, true, true FROM y WHERE split = 'test'""")
def q_boosting_rounds(spark, sf_dir):
    """M6 + M7 with patience on a planted rule: more trees than one, cut at the
    best round of the metric that ran out of patience, and TEST errors below a
    third of the mean's (closures: AUC over 0.97), which no single tree of that
    depth reaches. A larger step than the models' own keeps the rounds few."""
    from roadpulse.operators import boosting
    from roadpulse.operators import evaluate as ev
    df = _planted(spark, sf_dir)
    test = df.where(F.col("split") == "test")
    fit = df.where(F.col("split") != "test")
    limits = {"booster": {"stepSize": 0.3}, "max_rounds": 96, "first": 96}
    reg, clf = _together(spark, lambda: learn.fit_regressor(fit, REG_SPEC, "planted", **limits),
                         lambda: learn.fit_classifier(fit, CLF_SPEC, "planted_class", **limits))
    rows = []
    mean = df.where(F.col("split") == "train").agg(F.avg("planted")).first()[0]
    p = learn.predict_minutes(reg.model, test.drop("predicted_resolution_minutes"), REG_SPEC)
    m = {r["model"]: r["rmse"] for r in ev.regression_metrics(p, "planted", {"model": "predicted_resolution_minutes", "mean": F.lit(mean)}).collect()}
    c = learn.predict_probability(clf.model, test.drop("closure_probability"), CLF_SPEC)
    auc = ev.roc_auc(c, "planted_class", "closure_probability").first()["roc_auc"]
    n = test.count()
    for name, fitted, base, better in (("regressor", reg, round(m["mean"], 6), m["model"] < m["mean"] / 3), ("classifier", clf, None, auc > 0.97)):
        trees = fitted.model.stages[-1].getNumTrees
        bests = [x.best() for x in fitted.curves]
        waited = any(len(x.values) - x.best() >= boosting.PATIENCE for x in fitted.curves) or len(fitted.curves[0].values) == 96
        rows.append((name, n, base, trees > 1 and trees == fitted.rounds, fitted.rounds in bests or not waited, waited, better))
    return spark.createDataFrame(rows, "model string, n long, mean_rmse double, many_trees boolean, round_is_best boolean, "
                                       "patience_kept boolean, beats_one_tree boolean")


_RULES = {"hour": "h BETWEEN 0 AND 23", "dow": "d BETWEEN 0 AND 6", "month": "m BETWEEN 1 AND 12",
          "lat": "latitude BETWEEN 12.8e0 AND 13.3e0", "lon": "longitude BETWEEN 77.38e0 AND 77.76e0",
          "centrality": "centrality_score BETWEEN 0e0 AND 0.07e0", "snap": "snap BETWEEN 0e0 AND 500e0"}
_RULES |= {c: f"EXISTS (SELECT 1 FROM f v WHERE v.split = 'train' AND v.{c} = f.{c})" for c in _LISTS}
_VEHICLE_SQL = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VEHICLES))
_REASONS = ", ".join(f"CASE WHEN NOT coalesce({rule}, false) THEN '{name}' END" for name, rule in _RULES.items())


@query("intake_quarantine", f"""{X5_SPLIT_SQL},
  f AS (SELECT incident_id, split, latitude, longitude, hour(split_timestamp + INTERVAL 330 MINUTE) AS h,
               isodow(split_timestamp + INTERVAL 330 MINUTE) - 1 AS d, month(split_timestamp + INTERVAL 330 MINUTE) AS m,
               centrality_score, CAST(incident_id * 31 % 1000 AS DOUBLE) AS snap, event_cause, corridor, zone,
               CASE incident_id % 5 {_VEHICLE_SQL} END AS veh_type, {_ODD_JUNCTION_SQL} AS junction FROM split_rows)
SELECT incident_id, concat_ws(',', {_REASONS}) AS reasons FROM f WHERE split <> 'train'""")
def q_intake_quarantine(spark, sf_dir):
    """all bounds and all five allowed lists; accepted rows have no reason."""
    from roadpulse.operators import validate
    df = odd_junctions(incidents(spark, sf_dir))
    vocab = stored(encode.vocabulary(df.where(F.col("split") == "train"), _LISTS))
    checked = stored(validate.validate(df.where(F.col("split") != "train"), vocab, _LISTS))
    good, bad = validate.quarantine(checked)
    return good.select("incident_id", F.lit("").alias("reasons")).unionByName(
        bad.select("incident_id", F.array_join("reasons", ",").alias("reasons")))


@query("model_reload", f"{X5_SPLIT_SQL} SELECT incident_id, true AS same FROM split_rows WHERE split = 'test'")
def q_model_reload(spark, sf_dir):
    """The whole fitted pipeline (vocabularies, imputation, trees) saved,
    loaded and applied; its predictions equal the original's."""
    from pyspark.ml import PipelineModel
    test, fitted = _regressor(spark, sf_dir)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    fitted.model.save(path)
    a = learn.predict_minutes(fitted.model, test.drop("predicted_resolution_minutes"), REG_SPEC)
    b = learn.predict_minutes(PipelineModel.load(path), test.drop("predicted_resolution_minutes"), REG_SPEC)
    b = b.select(F.col("incident_id").alias("__id"), F.col("predicted_resolution_minutes").alias("__m"))
    return a.join(b, F.col("incident_id") == F.col("__id")).select(
        "incident_id", F.col("predicted_resolution_minutes").eqNullSafe(F.col("__m")).alias("same"))


_META_LISTS = " UNION ALL ".join(f"SELECT 'vocabulary', '{c}', {c}, NULL::BIGINT FROM (SELECT DISTINCT {c} FROM split_rows WHERE split = 'train' AND {c} IS NOT NULL)"
                                 for c in ("event_cause", "corridor", "zone", "junction"))
_META_NAMES = ", ".join([f"('numeric_feature', '{c}')" for c in REG_SPEC.numeric] + [f"('categorical_feature', '{c}')" for c in REG_SPEC.categorical])


@query("metadata_document", f"""{SWEEP_SQL}
SELECT section, name, NULL::VARCHAR AS value, NULL::BIGINT AS n, NULL::DOUBLE AS number FROM (VALUES {_META_NAMES}) f(section, name)
UNION ALL SELECT 'split_rows', split, NULL, count(*), NULL FROM split_rows GROUP BY split
UNION ALL SELECT 'threshold', 'closure_probability', NULL, NULL, threshold FROM best
UNION ALL SELECT *, NULL FROM ({_META_LISTS})""")
def q_metadata_document(spark, sf_dir):
    """S7 + S8: what inference needs besides the models (feature lists, TRAIN
    vocabularies, split sizes, the tuned threshold), one JSON document a part,
    written in parallel and read back."""
    from pyspark.sql import types as T

    from roadpulse.operators import evaluate as ev
    from roadpulse.sources import incidents as src
    schema = T.StructType.fromDDL("section string, name string, value string, n bigint, number double")
    df = stored(x5_with_split(spark, sf_dir))
    names = [("numeric_feature", c, None, None, None) for c in REG_SPEC.numeric]
    names += [("categorical_feature", c, None, None, None) for c in REG_SPEC.categorical]
    best = ev.best_threshold(ev.threshold_sweep(df.where(F.col("split") == "val"), Y_CLF, "closure_probability")).first()
    names.append(("threshold", "closure_probability", None, None, best["threshold"]))
    none = lambda kind: F.lit(None).cast(kind)
    sizes = df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("split_rows").alias("section"), F.col("split").alias("name"), none("string").alias("value"), "n", none("double").alias("number"))
    words = encode.vocabulary(df.where(F.col("split") == "train"), ["event_cause", "corridor", "zone", "junction"]).select(
        F.lit("vocabulary").alias("section"), F.col("feature").alias("name"), "value", none("bigint").alias("n"), none("double").alias("number"))
    path = scratch_path(spark, f"metadata-{uuid.uuid4().hex}")
    src.write_metadata(spark.createDataFrame(names, schema).unionByName(sizes).unionByName(words), path)
    return src.read_metadata(spark, path, schema)


@query("artifact_inference", f"""{X5_SPLIT_SQL}
SELECT incident_id, true AS same_minutes, true AS same_probability, true AS scored FROM split_rows WHERE split = 'test'""")
def q_artifact_inference(spark, sf_dir):
    """S7 + S8 + P26: another session loads the artefacts and scores TEST rows
    from their raw columns; its predictions are the fitting session's."""
    from roadpulse.operators import artifacts
    folder = _artifacts(spark, sf_dir)
    test, reg = _regressor(spark, sf_dir)
    rest, clf = _classifier(spark, sf_dir)
    a = learn.predict_minutes(reg.model, test.drop("predicted_resolution_minutes"), REG_SPEC).select(
        "incident_id", F.col("predicted_resolution_minutes").alias("minutes"))
    b = learn.predict_probability(clf.model, rest.where(F.col("split") == "test").drop("closure_probability"), CLF_SPEC).select(
        "incident_id", F.col("closure_probability").alias("probability"))
    other = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        other.conf.set(key, spark.conf.get(key))
    raw = scratch_path(spark, f"raw-{uuid.uuid4().hex}")
    test.drop("junction_te", "predicted_resolution_minutes", "closure_probability").write.parquet(raw)
    done = scratch_path(spark, f"scored-{uuid.uuid4().hex}")
    artifacts.Inference.load(other, folder).predict(other.read.parquet(raw)).write.parquet(done)
    s = spark.read.parquet(done)
    near = lambda x, y: F.coalesce(F.abs(F.col(x) - F.col(y)) < 1e-9, F.lit(False))
    return s.join(a, "incident_id").join(b, "incident_id").select(
        "incident_id", near("predicted_resolution_minutes", "minutes").alias("same_minutes"), near("closure_probability", "probability").alias("same_probability"),
        (F.col("cascade_risk_score").between(0.0, 100.0) & F.col("priority").isNotNull() & F.col("closure_expected").isNotNull()).alias("scored"))


def _fed(spark, rows, parts, batch_fn, name):
    """Runs a stream over a folder that grows by one of ``parts`` parts (by id)
    between runs: each run starts anew from the checkpoint. The folder of the sinks."""
    from roadpulse.streaming import jobs
    out = jobs.new_run_dir(spark, name)
    for k in range(parts):
        rows.where(F.col("incident_id") % parts == k).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{out}/in")
        jobs.run_available_now(stream, out, batch_fn=batch_fn)
    return out


@query("stream_intake", f"""{X5_SPLIT_SQL},
  f AS (SELECT incident_id, split, latitude, longitude, hour(split_timestamp + INTERVAL 330 MINUTE) AS h,
               isodow(split_timestamp + INTERVAL 330 MINUTE) - 1 AS d, month(split_timestamp + INTERVAL 330 MINUTE) AS m,
               centrality_score, CAST(incident_id * 31 % 1000 AS DOUBLE) AS snap, event_cause, corridor, zone,
               CASE incident_id % 5 {_VEHICLE_SQL} END AS veh_type, {_ODD_JUNCTION_SQL} AS junction FROM split_rows)
SELECT 'INC-' || CAST(incident_id AS VARCHAR) AS id, concat_ws(',', {_REASONS}) AS reasons, incident_id % 3 AS epoch, true AS same_as_batch
FROM f WHERE split <> 'train'""")
def q_stream_intake(spark, sf_dir):
    """ST1: the whole live intake as a stream that is started three times over a
    growing folder; queue and quarantine hold every row once, each in its epoch,
    and the queue's rows are those of the batch."""
    from roadpulse.operators import artifacts, validate
    from roadpulse.operators import queue as queue_ops
    from roadpulse.streaming import jobs
    df = odd_junctions(_incidents(spark, sf_dir)).where(F.col("split") != "train").drop("predicted_resolution_minutes", "closure_probability")
    df = stored(df)
    inf = artifacts.Inference.load(spark, _artifacts(spark, sf_dir))
    out = _fed(spark, df, 3, jobs.intake(inf), "intake")
    live = spark.read.parquet(f"{out}/queue")
    good, _ = validate.quarantine(stored(inf.validated(df)))
    batch = queue_ops.build_queue(inf.predict(good), is_new=True).drop("reported_at")
    values = [c for c in batch.columns if c != "id"]
    same = live.join(batch.select(F.col("id").alias("__id"), F.struct(*values).alias("__b")), F.col("id") == F.col("__id"), "left").select(
        "id", F.lit("").alias("reasons"), F.col("epoch").cast("long").alias("epoch"), F.col("__b").eqNullSafe(F.struct(*values)).alias("same_as_batch"))
    refused = spark.read.parquet(f"{out}/quarantine").select(
        F.concat(F.lit("INC-"), F.col("incident_id").cast("string")).alias("id"), F.array_join("reasons", ",").alias("reasons"),
        F.col("epoch").cast("long").alias("epoch"), F.lit(True).alias("same_as_batch"))
    return same.unionByName(refused)


_TIER_COUNTS = ", ".join(f"count_if(priority = '{t}' AND incident_id % 3 <= e)::BIGINT AS n_{t.lower()}"
                         for t in ("Critical", "High", "Elevated", "Moderate", "Low"))


@query("stream_kpis", f"""{FIT_SQL},
  k AS (SELECT e AS epoch, count_if(incident_id % 3 <= e)::BIGINT AS n_active, {_TIER_COUNTS}, avg(cascade_risk_score) FILTER (incident_id % 3 <= e) AS a
        FROM banded, range(3) r(e) GROUP BY e)
SELECT epoch, n_active, n_critical, n_high, n_elevated, n_moderate, n_low, round(a, 6) AS avg_crs,
       round(100e0 - least(95e0, coalesce(a, 0e0)), 6) AS readiness,
       CASE WHEN n_critical > 0 THEN 'Elevated Operations' WHEN n_high > 0 THEN 'Heightened Operations' ELSE 'Normal Operations' END AS ops_status FROM k""")
def q_stream_kpis(spark, sf_dir):
    """ST2, A9, A10: KPIs after each of three epochs, every run restarted from
    the checkpoint, from states that add up."""
    from roadpulse.operators import queue as queue_ops
    from roadpulse.streaming import jobs
    df = stored(x5_with_split(spark, sf_dir))
    scorer = RiskScorer().fit(df.where(F.col("split") == "train"))

    def batch(rows, epoch, path):
        jobs.queue_sinks(queue_ops.build_queue(scorer.score(rows), is_new=True).drop("reported_at"), path.removesuffix("/data"), epoch)
    out = _fed(spark, df, 3, batch, "kpis")
    return jobs.running_kpis(spark.read.parquet(f"{out}/kpis").withColumn("epoch", F.col("epoch").cast("long")))


@query("stream_top_corridors", f"""{FIT_SQL},
  t AS (SELECT corridor, sum(cascade_risk_score) AS total, count(*) AS n FROM banded GROUP BY corridor)
SELECT corridor, round(total, 6) AS total_crs, n AS count, row_number() OVER (ORDER BY total DESC, corridor)::INT AS rank FROM t
QUALIFY rank <= 5""")
def q_stream_top_corridors(spark, sf_dir):
    """ST2, W4, W9: the top five corridors from totals kept per epoch."""
    from roadpulse.operators import queue as queue_ops
    from roadpulse.streaming import jobs
    df = stored(x5_with_split(spark, sf_dir))
    scorer = RiskScorer().fit(df.where(F.col("split") == "train"))

    def batch(rows, epoch, path):
        jobs.queue_sinks(queue_ops.build_queue(scorer.score(rows), is_new=True).drop("reported_at"), path.removesuffix("/data"), epoch)
    out = _fed(spark, df, 3, batch, "corridor-totals")
    return jobs.running_top_corridors(spark.read.parquet(f"{out}/corridors")).withColumn("total_crs", F.round("total_crs", 6))

"""Exact quantiles over several ranges, with ties, a hot value and odd groups; scalar edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.operators import clean, evaluate, profile, snap
from roadpulse.operators.order_stats import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.501, 0.9, 1.0]


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_match_numpy(spark, parts):
    rng = np.random.default_rng(4)
    groups = {"many": rng.normal(size=3000).round(2), "hot": np.r_[np.full(2500, 7.0), rng.integers(0, 20, 400)],
              "one": np.array([5.0]), "two": np.array([1.0, 2.0]), None: np.array([3.0, -3.0, 0.5])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("many", None), ("many", float("nan")), ("empty", None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, x double")
        got = {(r["g"], r["name"]): r["q"] for r in exact_quantiles(df, {"x": "x", "neg": -F.col("x")}, PROBS, ["g"]).collect()}
        whole = exact_quantiles(df, {"x": "x"}, PROBS).first()["q"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got.keys() == {(g, n) for g in groups for n in ("x", "neg")}
    for g, x in groups.items():
        assert got[g, "x"] == pytest.approx(np.quantile(x, PROBS).tolist(), abs=1e-12)
        assert got[g, "neg"] == pytest.approx(np.quantile(-x, PROBS).tolist(), abs=1e-12)
    assert whole == pytest.approx(np.quantile(np.concatenate(list(groups.values())), PROBS).tolist(), abs=1e-12)


def test_summaries_of_empty_and_constant_tables(spark):
    df = spark.createDataFrame([(4.0, 4.0), (4.0, 5.0)], "y double, p double")
    m = evaluate.regression_metrics(df, "y", {"m": "p"}).first()
    assert (m["r2"], m["mae"], m["medae"]) == (None, 0.5, 0.5)
    assert df.agg(profile.skewness_corrected(df, "p")).first()[0] is None
    s = snap.snap_summary(spark.createDataFrame([], "snap_distance double")).first()
    assert s["n"] == 0 and s["share_low_confidence"] is None and s["p50"] is None
    r = clean.rejection_counts(spark.createDataFrame([], "resolution_minutes double")).first()
    assert r["n_before_filter"] == 0 and r["retention_pct"] is None
    d = profile.distribution_summary(spark.createDataFrame([], "x double"), "x").first()
    assert d["n"] == 0 and d["p50"] is None


def test_scores_that_are_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([(True, 0.9), (False, 0.1), (True, nan), (False, 0.2), (True, 0.15)], "y boolean, s double")
    assert evaluate.roc_auc(df, "y", "s").first()[0] == 0.75
    sweep = {round(r["threshold"], 2): r["recall"] for r in evaluate.threshold_sweep(df, "y", "s").collect()}
    assert sweep[0.5] == 0.5 and sweep[0.01] == 1.0

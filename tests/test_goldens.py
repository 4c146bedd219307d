"""Arithmetic goldens from the published reports (no raw data needed)."""

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import encode, evaluate, sampling, split


def _pairs(spark, cells):
    rows = []
    for (actual, pred), n in cells.items():
        rows += [(actual, pred)] * n
    return spark.createDataFrame(rows, "y int, p int")


def test_confusion_metrics(spark):
    df = _pairs(spark, {(0, 0): 279, (0, 1): 57, (1, 0): 16, (1, 1): 28})
    m = evaluate.classification_metrics(df, "y", "p").first()
    assert round(m["accuracy"], 4) == 0.8079
    assert round(m["precision"], 4) == 0.3294
    assert round(m["recall"], 4) == 0.6364
    assert round(m["f1"], 4) == 0.4341
    cm = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion_counts(df, "y", "p").collect()}
    assert cm == {(0, 0): 279, (0, 1): 57, (1, 0): 16, (1, 1): 28}


def test_majority_baseline_zero_division(spark):
    df = _pairs(spark, {(0, 0): 336, (1, 0): 44})
    m = evaluate.classification_metrics(df, "y", "p").first()
    assert round(m["accuracy"], 4) == 0.8842
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)
    cm = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion_counts(df, "y", "p").collect()}
    assert cm[(0, 1)] == 0 and cm[(1, 1)] == 0


def test_split_sizes():
    assert split.split_sizes(2533) == (1773, 380, 380)
    assert split.split_sizes(0) == (0, 0, 0)
    assert split.split_sizes(1) == (1, 0, 0)
    assert split.split_sizes(3) == (2, 0, 1)
    assert split.split_sizes(10) == (7, 2, 1)


def test_oversample_plan():
    # 1661 negatives * 0.5 = 830.5 -> half-even 830 wanted, 112 present
    assert sampling.oversample_plan(112, 1661) == 718
    assert sampling.oversample_plan(900, 1000) == 0


def test_target_encoding_smoothing(spark):
    # 1773 TRAIN rows with 112 positives; a category seen once with label 0
    rows = [("a", True)] * 112 + [("b", False)] * 1660 + [("single", False)]
    tr = spark.createDataFrame(rows, "junction string, requires_road_closure boolean")
    g = encode.global_mean(tr, "requires_road_closure")
    assert round(g, 8) == 0.06316977
    enc = {r["value"]: r["te"] for r in encode.encoder_table(tr, "junction", "requires_road_closure", g).collect()}
    assert round(enc["single"], 7) == 0.0601617


def test_rejection_arithmetic(spark):
    from roadpulse.operators import clean
    rows = [(None,)] * 4964 + [(-1.0,)] * 4 + [(2000.0,)] * 672 + [(30.0,)] * 2533
    df = spark.createDataFrame(rows, "resolution_minutes double")
    r = clean.rejection_counts(df).first()
    assert (r["n_before_filter"], r["removed_no_end"], r["removed_negative"], r["removed_over_window"],
            r["n_after_filter"]) == (8173, 4964, 4, 672, 2533)
    assert r["retention_pct"] == pytest.approx(30.99229, abs=1e-4)


def test_threshold_grid_literal():
    # the stored tuned threshold is the float-grid value, not 0.35
    assert evaluate.THRESHOLDS[34] == 0.35000000000000003
    assert len(evaluate.THRESHOLDS) == 99


def test_roc_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, y int")
    # pairs (pos, neg): (0.35: >0.1, <0.4) (0.8: both) (0.4: >0.1, tie 0.4) -> 1 + 2 + 1.5 = 4.5 of 6
    assert evaluate.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(0.75)
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert evaluate.roc_auc(one, "y", "s").first()["roc_auc"] is None


def test_threshold_sweep_lowest_wins(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 1), (0.2, 0)], "s double, y int")
    best = evaluate.best_threshold(evaluate.threshold_sweep(df, "y", "s")).first()
    # every threshold in (0.2, 0.5] gives F1 = 1; the lowest of them wins
    assert best["f1"] == 1.0
    assert best["threshold"] == min(t for t in evaluate.THRESHOLDS if t > 0.2)
    assert F is not None

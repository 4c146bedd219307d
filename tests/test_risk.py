import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import quantile_rank_ref
from roadpulse.functions import risk as rf
from roadpulse.operators.quantile import QuantileModel, add_quantile_ranks, fit_quantiles
from roadpulse.operators.risk import RiskScorer, band_by_range_join


@pytest.mark.parametrize("score,label", [(-1.0, "Critical"), (0.0, "Low"), (19.995, "Low"), (20.0, "Moderate"),
                                         (79.994, "High"), (79.996, "High"), (80.0, "Critical"),
                                         (100.0, "Critical"), (None, None)])
def test_band_edges(spark, score, label):
    df = spark.createDataFrame([(score,)], "cascade_risk_score double")
    assert df.select(rf.band_label("cascade_risk_score")).first()[0] == label
    assert band_by_range_join(df).first()["priority"] == label


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "x double")
    got = [r[0] for r in df.select(rf.round_half_even("x", 2)).collect()]
    assert got == [round(0.125, 2), round(0.375, 2), 2.5]


@pytest.mark.parametrize("values", [
    [5.0] * 20,                                   # constant column
    [1, 1, 1, 2, 2, 3, 3, 3, 3, 10, 10, 10],      # heavy ties
    list(np.linspace(0, 1, 37) ** 3),             # no ties
])
def test_quantile_rank_matches_reference(spark, values):
    train = spark.createDataFrame([(float(v),) for v in values], "x double")
    model = fit_quantiles(train, ["x"])["x"]
    probe = sorted(set(values)) + [min(values) - 1, max(values) + 1, np.mean(values), values[len(values) // 2] + 1e-9]
    df = spark.createDataFrame([(float(v),) for v in probe], "x double")
    got = [r["r"] for r in add_quantile_ranks(df, [("x", model, "r")]).orderBy("x").collect()]
    exp = quantile_rank_ref(sorted(probe), model.quantiles)
    assert np.allclose(got, exp, atol=1e-12)


def test_quantile_rank_null(spark):
    model = QuantileModel("x", [0.0, 1.0, 2.0])
    df = spark.createDataFrame([(None,), (1.5,)], "x double")
    got = [r["r"] for r in add_quantile_ranks(df, [("x", model, "r")]).collect()]
    assert got[0] is None and got[1] == pytest.approx(0.75)


def test_scorer_refuses_before_fit(spark):
    df = spark.createDataFrame([(0.5, 10.0, 0.01)], "closure_probability double, "
                               "predicted_resolution_minutes double, centrality_score double")
    with pytest.raises(RuntimeError):
        RiskScorer().score(df)


def test_scorer_worked_example(spark):
    train = spark.createDataFrame([(float(i), i / 1000.0) for i in range(1, 101)],
                                  "resolution_minutes double, centrality_score double")
    sc = RiskScorer().fit(train)
    df = spark.createDataFrame([(0.93, 92.0, 0.095), (0.22, 20.0, 0.01), (1.7, 500.0, 1.0)],
                               "closure_probability double, predicted_resolution_minutes double, "
                               "centrality_score double")
    rows = sc.score(df).orderBy(F.desc("cascade_risk_score")).collect()
    top = rows[0]
    assert top["p_norm"] == 1.0 and top["t_norm"] == 1.0 and top["c_norm"] == 1.0
    assert top["cascade_risk_score"] == 100.0 and top["priority"] == "Critical"
    t = quantile_rank_ref([92.0], sc.time_model.quantiles)[0]
    c = quantile_rank_ref([0.095], sc.centrality_model.quantiles)[0]
    crs = 100 * np.sqrt(0.93 * (0.5 * t + 0.5 * c))
    assert rows[1]["cascade_risk_score"] == pytest.approx(np.round(crs, 2))


def test_quantile_fit_rejects_empty_and_skips_nan(spark):
    train = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert fit_quantiles(train, ["x"])["x"].quantiles == pytest.approx([1.0, 5 / 3, 7 / 3, 3.0])  # as many points as rows
    ranked = add_quantile_ranks(train, [("x", fit_quantiles(train, ["x"])["x"], "r")]).collect()
    assert [r["r"] for r in ranked] == [0.0, None, None, 1.0]
    with pytest.raises(ValueError):
        fit_quantiles(train.limit(0), ["x"])

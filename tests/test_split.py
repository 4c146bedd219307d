"""Chronological split: the exact refinement path against a global row_number."""

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import split
from roadpulse.plans.adapters import X1_SQL, x1_lifecycle
from roadpulse.plans.catalog_split import split_sql


@pytest.fixture
def tiny_buckets(monkeypatch):
    # force several refinement rounds (and the id-tie stage) on small data
    monkeypatch.setattr(split, "SMALL_RANGE", 40)
    monkeypatch.setattr(split, "BUCKETS", 4)


def test_refinement_matches_row_number(spark, duck, tiny_buckets):
    from conftest import SF01
    got = {r["incident_id"]: r["split"] for r in
           split.chronological_split(x1_lifecycle(spark, SF01), ts="start_datetime").select("incident_id", "split")
           .collect()}
    sql = split_sql(f"WITH src AS ({X1_SQL})", "start_datetime", "incident_id") + " SELECT incident_id, split FROM split_rows"
    exp = dict(duck.sql(sql).fetchall())
    assert got == exp


@pytest.mark.parametrize("n", [0, 1, 3, 10])
def test_small_sizes(spark, n):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "incident_id long, split_timestamp timestamp")
    out = split.chronological_split(df).groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in out}
    n_train, n_val, n_test = split.split_sizes(n)
    assert counts.get("train", 0) == n_train
    assert counts.get("val", 0) == n_val
    assert counts.get("test", 0) == n_test


def test_equal_timestamps_across_cut(spark, tiny_buckets):
    import datetime as dt
    # all 100 rows share one timestamp: the cut falls inside the tie and is decided by id
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1)) for i in range(100)],
                               "incident_id long, split_timestamp timestamp")
    out = split.chronological_split(df).collect()
    assert sorted(r["incident_id"] for r in out if r["split"] == "train") == list(range(70))
    assert sorted(r["incident_id"] for r in out if r["split"] == "val") == list(range(70, 85))


def test_null_timestamp_rejected(spark):
    df = spark.createDataFrame([(1, None)], "incident_id long, split_timestamp timestamp")
    with pytest.raises(ValueError):
        split.chronological_split(df).collect()


def test_recovery_gate(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "id long, v double, c string")
    ok = spark.createDataFrame([(1, 1.0 + 1e-7, "x", 10), (2, 2.0, "y", 20)], "id long, v double, c string, t int")
    assert sorted(r["t"] for r in split.recover_column(a, ok, "id", "t").collect()) == [10, 20]
    bad = spark.createDataFrame([(1, 1.001, "x", 10), (2, 2.0, "y", 20)], "id long, v double, c string, t int")
    with pytest.raises(ValueError):
        split.recover_column(a, bad, "id", "t")
    nul = spark.createDataFrame([(1, None, "x", 10), (2, 2.0, "y", 20)], "id long, v double, c string, t int")
    zero = spark.createDataFrame([(1, 0.0, "x"), (2, 2.0, "y")], "id long, v double, c string")
    with pytest.raises(ValueError):  # NULL is not 0.0
        split.recover_column(zero, nul, "id", "t")
    short = spark.createDataFrame([(1, 1.0, "x", 10)], "id long, v double, c string, t int")
    with pytest.raises(ValueError):
        split.recover_column(a, short, "id", "t")
    assert F is not None

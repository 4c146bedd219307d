"""Step 2 as one run, by hand on a small network in degrees."""

import pytest
from pyspark.sql import functions as F

from roadpulse.functions import risk
from roadpulse.operators import graph, learn
from roadpulse.operators.enrich import enrich_incidents

NODES = [(1, 77.50, 12.90), (2, 77.51, 12.90), (3, 77.52, 12.90)]
# between 1 and 2: a straight road and a shorter one back that bends far south; 2-3 has no length
EDGES = [(1, 2, 0, 1100.0, None), (2, 1, 5, 900.0, "LINESTRING (77.51 12.90, 77.505 12.88, 77.50 12.90)"), (2, 3, 0, None, None)]


@pytest.fixture(scope="module")
def network(spark):
    return (spark.createDataFrame(NODES, "node_id long, x double, y double"),
            spark.createDataFrame(EDGES, "u long, v long, key int, length double, geometry string"))


def test_step_two(spark, network):
    inc = spark.createDataFrame([(1, 12.901, 77.505, "a"), (2, 12.8805, 77.505, "b"), (3, 12.9, 77.515, "c"), (4, None, 77.5, "d"),
                                 (5, 12.95, 77.515, None)], "incident_id long, latitude double, longitude double, key string")
    got = {r["incident_id"]: r for r in enrich_incidents(inc, *network).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[2]["key"] == "b"
    assert (got[1]["nearest_u"], got[1]["nearest_v"], got[1]["nearest_key"]) == (1, 2, 0)
    assert (got[2]["nearest_u"], got[2]["nearest_v"], got[2]["nearest_key"]) == (2, 1, 5)
    # the shortest of the parallel edges carries the paths, whichever one the incident lies on
    assert got[1]["kept_key"] == got[2]["kept_key"] == 5 and got[3]["kept_key"] == 0
    assert 100 < got[1]["snap_distance"] < 120 and got[3]["snap_distance"] < 1 and got[5]["snap_distance"] > 5000
    assert [got[i]["low_confidence_snap"] for i in (1, 2, 3, 4, 5)] == [False, False, False, False, True]
    # three nodes in a row: each edge lies on two of three pairs, both ways
    assert all(got[i]["centrality_score"] == pytest.approx(2 / 3) for i in (1, 2, 3, 5))
    assert got[4]["nearest_u"] is None and got[4]["centrality_score"] is None


def test_step_two_counts_every_source_at_any_size(spark, network, monkeypatch):
    """No size of the network from which some nodes only are sources."""
    monkeypatch.setattr(graph, "EXACT_THRESHOLD_NODES", 2)
    monkeypatch.setattr(graph, "K_PIVOTS", 1)
    inc = spark.createDataFrame([(1, 12.901, 77.505), (3, 12.9, 77.515)], "incident_id long, latitude double, longitude double")
    got = [r["centrality_score"] for r in enrich_incidents(inc, *network).collect()]
    assert got == pytest.approx([2 / 3, 2 / 3])
    one = [r["centrality_score"] for r in enrich_incidents(inc, *network, k=1).collect()]
    assert one != pytest.approx([2 / 3, 2 / 3])  # pivots only where asked for


def test_step_two_without_rows(network):
    inc = network[0].limit(0).select(F.col("node_id").alias("incident_id"), F.col("y").alias("latitude"), F.col("x").alias("longitude"))
    assert enrich_incidents(inc, *network).count() == 0


def test_collapse_carries_the_shortest_edge(spark):
    arcs = spark.createDataFrame([(1, 2, 7, 5.0), (2, 1, 3, 5.0), (1, 2, 9, 4.0), (3, 2, 8, None), (2, 3, 1, 1.5)],
                                 "u long, v long, key int, length double")
    got = {(r["u"], r["v"]): (r["length"], r["n_parallel"], r["key"]) for r in graph.collapse_simple(arcs, carry=("key",)).collect()}
    assert got == {(1, 2): (4.0, 3, 9), (2, 3): (1.0, 2, 8)}
    plain = {(r["u"], r["v"]): (r["length"], r["n_parallel"]) for r in graph.collapse_simple(arcs).collect()}
    assert plain == {k: v[:2] for k, v in got.items()}


def test_weights_and_features_are_checked():
    with pytest.raises(ValueError):
        risk.impact(F.lit(1.0), F.lit(1.0), 0.7, 0.7)
    with pytest.raises(AssertionError):
        learn.assert_no_leak(learn.FeatureSpec(["x", "split_timestamp"]), "y")
    learn.assert_no_leak(learn.FeatureSpec(["x"]), "y")


def test_importance_table_as_csv(spark, tmp_path):
    rows = [("b", 1.5, 3), ("a", 1.5, 2), ("c, d", 0.0, 0), ("e", 9.25, 1)]
    table = spark.createDataFrame(rows, "feature string, gain_importance double, split_importance long")
    learn.write_importance(table, str(tmp_path / "imp"))
    assert len(list((tmp_path / "imp").glob("*.csv"))) == 1
    got = [tuple(r) for r in learn.read_importance(spark, str(tmp_path / "imp")).collect()]
    assert got == [(1, "e", 9.25, 1), (2, "a", 1.5, 2), (3, "b", 1.5, 3), (4, "c, d", 0.0, 0)]

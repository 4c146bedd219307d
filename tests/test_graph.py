"""Edge betweenness against a plain-Python Brandes on tie-heavy fixtures."""

import pytest
from pyspark.sql import functions as F

from brute import brandes_edges
from roadpulse.operators import graph


def _grid():
    """5x5 grid, integer weights (mostly 1, so many equal paths) + a shortcut,
    a second component, a self-loop."""
    edges = []
    for r in range(5):
        for c in range(5):
            n = r * 5 + c
            if c < 4:
                edges.append((n, n + 1, 1 + (r == 2)))
            if r < 4:
                edges.append((n, n + 5, 1))
    edges.append((0, 24, 7))           # shortcut
    edges += [(100, 101, 3), (101, 102, 3), (100, 102, 6)]   # second component with a tie
    edges.append((7, 7, 1))            # self-loop
    return edges


def _run(spark, edges, k=None):
    df = spark.createDataFrame([(min(u, v), max(u, v), w) for u, v, w in edges], "u long, v long, w long")
    got = graph.edge_betweenness(df, k=k).collect()
    return {(r["u"], r["v"]): r["centrality"] for r in got}


def test_exact_matches_brandes(spark):
    edges = _grid()
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    ref = brandes_edges(nodes, edges)
    n = len(nodes)
    got = _run(spark, edges)
    for u, v, _ in edges:
        key = (min(u, v), max(u, v))
        assert got[key] == pytest.approx(ref.get(key, 0.0) / (n * (n - 1)), abs=1e-12)
    assert got[(7, 7)] == 0.0


def test_pivots_match_brandes(spark):
    edges = _grid()
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    k = 5
    nd = spark.createDataFrame([(x,) for x in nodes], "node_id long")
    pivots = [r["s"] for r in graph.pivot_sources(nd, k).collect()]
    ref = brandes_edges(nodes, edges, sources=pivots)
    n = len(nodes)
    got = _run(spark, edges, k=k)
    for key, val in got.items():
        assert val == pytest.approx(ref.get(key, 0.0) * n / k / (n * (n - 1)), abs=1e-12)


def test_collapse_keeps_shortest_and_defaults(spark):
    arcs = spark.createDataFrame([(1, 2, 5.0), (2, 1, 3.0), (1, 2, None), (3, 3, 2.0), (4, 5, None)],
                                 "u long, v long, length double")
    got = {(r["u"], r["v"]): (r["length"], r["n_parallel"]) for r in graph.collapse_simple(arcs).collect()}
    assert got == {(1, 2): (1.0, 3), (3, 3): (2.0, 1), (4, 5): (1.0, 1)}


def test_assign_unordered_lookup(spark):
    cent = spark.createDataFrame([(1, 2, 0.5)], "u long, v long, centrality double")
    pts = spark.createDataFrame([(10, 2, 1), (11, 1, 2), (12, 1, 3), (13, None, 1)],
                                "incident_id long, nearest_u long, nearest_v long")
    got = {r["incident_id"]: r["centrality_score"] for r in graph.assign_centrality(pts, cent).collect()}
    assert got == {10: 0.5, 11: 0.5, 12: None, 13: None}
    assert F is not None


def test_fractional_lengths_and_gate(spark):
    """Lengths of 1.6, 1.6 and 3.1 are told apart; none below a millimetre passes."""
    tri = [(1, 2, 1.6), (2, 3, 1.6), (1, 3, 3.1)]
    df = spark.createDataFrame(tri, "u long, v long, w double")
    got = {(r["u"], r["v"]): r["centrality"] for r in graph.edge_betweenness(df).collect()}
    assert got == pytest.approx({(1, 2): 1 / 3, (2, 3): 1 / 3, (1, 3): 1 / 3})
    short = spark.createDataFrame([(1, 2, 0.4), (2, 3, 0.4), (1, 3, 0.9)], "u long, v long, w double")
    got = {(r["u"], r["v"]): r["centrality"] for r in graph.edge_betweenness(short).collect()}
    assert got == pytest.approx({(1, 2): 2 / 3, (2, 3): 2 / 3, (1, 3): 0.0})
    for bad in (0.0, -1.0, 0.0001, None):
        with pytest.raises(ValueError, match="1 edges"):
            graph.edge_betweenness(spark.createDataFrame([(1, 2, bad), (2, 3, 1.0)], "u long, v long, w double"))


def test_pivot_rule():
    assert graph.n_sources(25) is None and graph.n_sources(3000) is None
    assert graph.n_sources(3001) == 500 and graph.n_sources(10, 4) == 4


def _chained(seed):
    """Random networks of chains: parallel chains, rings on a junction, closed
    rings, dead ends, short lengths so that many ways are equally long."""
    import random
    rnd = random.Random(seed)
    edges, nxt = [], [20]

    def chain(a, b, k):
        at = a
        for _ in range(k):
            edges.append((at, nxt[0], rnd.choice((1, 1, 2))))
            at = nxt[0]
            nxt[0] += 1
        edges.append((at, b, rnd.choice((1, 2))))

    for _ in range(9):
        a, b = rnd.sample(range(6), 2)
        chain(a, b, rnd.randint(1, 5))
    chain(2, 2, 4)                       # a ring on a junction
    chain(10, 10, 5)                     # a closed ring
    chain(11, 12, 6)                     # a road of its own
    chain(0, 13, 3)                      # a dead end
    edges.append((0, 4, 3))
    return edges


@pytest.mark.parametrize("seed", [1, 2])
def test_contracted_chains_match_brandes(spark, seed):
    edges = _chained(seed)
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    n = len(nodes)
    got = _run(spark, edges)
    ref = brandes_edges(nodes, edges)
    assert got == pytest.approx({(min(u, v), max(u, v)): ref.get((min(u, v), max(u, v)), 0.0) / (n * (n - 1)) for u, v, _ in edges}, abs=1e-12)
    k = 7
    pivots = [r["s"] for r in graph.pivot_sources(spark.createDataFrame([(x,) for x in nodes], "node_id long"), k).collect()]
    ref = brandes_edges(nodes, edges, pivots)
    got = _run(spark, edges, k)
    assert got == pytest.approx({(min(u, v), max(u, v)): ref.get((min(u, v), max(u, v)), 0.0) * n / k / (n * (n - 1)) for u, v, _ in edges}, abs=1e-12)


def test_rounds_are_merged(spark, monkeypatch):
    """A ladder (no node of two neighbours but its corners, which are joined) is deep
    enough for several merges; with and without them the results are the same."""
    rungs = 14
    edges = [(2 * i, 2 * i + 1, 3) for i in range(rungs)] + [(2 * i + s, 2 * i + 2 + s, 2 + i % 3) for i in range(rungs - 1) for s in (0, 1)]
    edges += [(0, 2 * rungs - 1, 50), (1, 2 * rungs - 2, 50)]  # no chains: the frontier job runs
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    ref, n = brandes_edges(nodes, edges), len(nodes)
    for merge in (2, 1000):
        monkeypatch.setattr(graph, "MERGE_ROUNDS", merge)
        got = _run(spark, edges)
        for u, v, _ in edges:
            key = (min(u, v), max(u, v))
            assert got[key] == pytest.approx(ref.get(key, 0.0) / (n * (n - 1)), abs=1e-12)


def test_line_items_are_joined_once(spark, monkeypatch):
    from conftest import SF001

    from roadpulse.plans import adapters, catalog_graph
    read = []
    scan = adapters.table

    def seen(session, folder, name):
        read.append(name)
        return scan(session, folder, name)
    monkeypatch.setattr(adapters, "table", seen)
    monkeypatch.setattr(catalog_graph, "table", seen)
    rows = catalog_graph.q_assign_centrality(spark, SF001).count()
    assert read.count("lineitem") == 1
    assert rows == scan(spark, SF001, "lineitem").count()

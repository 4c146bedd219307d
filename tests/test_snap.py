import random

import pytest

from brute import seg_dist
from roadpulse.functions import geo
from roadpulse.operators import snap


def test_snap_matches_brute_force(spark):
    rnd = random.Random(7)
    segs = []
    for i in range(60):
        ax, ay = rnd.uniform(-5000, 5000), rnd.uniform(-5000, 5000)
        segs.append((i, i + 1, 0, ax, ay, ax + rnd.uniform(-800, 800), ay + rnd.uniform(-800, 800)))
    pts = [(j, rnd.uniform(-9000, 9000), rnd.uniform(-9000, 9000)) for j in range(150)]
    pts.append((999, None, 1.0))
    sdf = spark.createDataFrame(segs, "u long, v long, key int, ax double, ay double, bx double, by double")
    pdf = spark.createDataFrame(pts, "incident_id long, x double, y double")
    got = {r["incident_id"]: r for r in snap.snap_to_edges(pdf, sdf, cell=300.0).collect()}
    assert 999 not in got
    for j, px, py in pts[:-1]:
        best = min((seg_dist(px, py, *s[3:]), s[0], s[1], s[2]) for s in segs)
        assert got[j]["snap_distance"] == pytest.approx(best[0], rel=1e-12)
        assert (got[j]["nearest_u"], got[j]["nearest_v"]) == (best[1], best[2])


def test_shared_vertex_tie_picks_smallest_edge(spark):
    sdf = spark.createDataFrame([(2, 3, 0, 10.0, 0.0, 20.0, 0.0), (1, 2, 0, 0.0, 0.0, 10.0, 0.0)],
                                "u long, v long, key int, ax double, ay double, bx double, by double")
    pdf = spark.createDataFrame([(1, 10.0, 5.0)], "incident_id long, x double, y double")
    r = snap.snap_to_edges(pdf, sdf, cell=4.0).first()
    assert (r["nearest_u"], r["nearest_v"], r["snap_distance"]) == (1, 2, 5.0)


def test_attach_and_flags(spark):
    sdf = spark.createDataFrame([(1, 2, 0, 0.0, 0.0, 10.0, 0.0)],
                                "u long, v long, key int, ax double, ay double, bx double, by double")
    pdf = spark.createDataFrame([(1, 5.0, 1000.0), (2, None, None)], "incident_id long, x double, y double")
    out = {r["incident_id"]: r for r in snap.attach_snaps(pdf, snap.snap_to_edges(pdf, sdf, cell=50.0)).collect()}
    assert out[1]["low_confidence_snap"] is True and out[1]["snap_distance"] == 1000.0
    assert out[2]["snap_distance"] is None and out[2]["low_confidence_snap"] is False


def test_hot_cell_is_salted_and_exact(spark, monkeypatch):
    rnd = random.Random(11)
    segs = [(i, i + 1, 0, rnd.uniform(0, 900), rnd.uniform(0, 900), rnd.uniform(0, 900), rnd.uniform(0, 900))
            for i in range(40)]
    # a third of the points fall in one cell
    pts = [(j, rnd.uniform(400, 420), rnd.uniform(400, 420)) for j in range(100)]
    pts += [(100 + j, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for j in range(200)]
    sdf = spark.createDataFrame(segs, "u long, v long, key int, ax double, ay double, bx double, by double")
    pdf = spark.createDataFrame(pts, "incident_id long, x double, y double")
    got = {r["incident_id"]: r for r in snap.snap_to_edges(pdf, sdf, cell=100.0).collect()}
    for j, px, py in pts:
        best = min((seg_dist(px, py, *s[3:]), s[0], s[1], s[2]) for s in segs)
        assert got[j]["snap_distance"] == pytest.approx(best[0], rel=1e-12)
        assert (got[j]["nearest_u"], got[j]["nearest_v"]) == (best[1], best[2])


def test_far_points_and_chords_meet_few_candidates(spark, monkeypatch):
    """Points far from the network keep the cells that face them, and chords are
    keyed to the cells they cross alone: the rows of the joins stay far below all pairs."""
    rnd = random.Random(3)
    segs = [(i, i + 1, 0, rnd.uniform(0, 900), rnd.uniform(0, 900), rnd.uniform(0, 900), rnd.uniform(0, 900)) for i in range(150)]
    segs += [(1000 + i, 1001 + i, 0, 30.0 * i, 950.0, 30.0 * i, 950.0 + 5 * i) for i in range(30)]  # upright ones
    segs += [(3000, 3001, 0, None, 1.0, 2.0, 2.0), (3002, 3003, 0, 450.0, 450.0, 450.0, 450.0)]
    pts = [(j, rnd.uniform(0, 900), rnd.uniform(0, 900)) for j in range(200)]
    pts += [(1000 + j, 60000 + rnd.uniform(0, 900), -40000 + rnd.uniform(0, 900)) for j in range(300)]
    pts += [(2000, 450.0, 450.0), (2001, 90.0, 950.0), (2001, 90.0, 950.0)]
    sdf = spark.createDataFrame(segs, "u long, v long, key int, ax double, ay double, bx double, by double")
    pdf = spark.createDataFrame(pts, "incident_id long, x double, y double")
    rows = []
    join = snap._salted_join

    def counted(pc, sc, n_rows):
        out = join(pc, sc, n_rows)
        rows.append(out.count())
        return out
    monkeypatch.setattr(snap, "_salted_join", counted)
    found = snap.snap_to_edges(pdf, sdf).collect()
    assert len(found) == len(pts)
    got = {r["incident_id"]: r for r in found}
    for j, px, py in pts:
        best = min((seg_dist(px, py, *s[3:]), s[0], s[1]) for s in segs if s[3] is not None)
        assert got[j]["snap_distance"] == pytest.approx(best[0], rel=1e-12, abs=1e-9)
        assert (got[j]["nearest_u"], got[j]["nearest_v"]) == (best[1], best[2])
    assert all(n < len(pts) * len(segs) / 3 for n in rows)


def test_projection_binds_its_values_once():
    """Written out, the series is code too long to compile and was interpreted."""
    for c in geo.utm_project():
        assert len(str(c)) < 20_000

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadpulse.functions import text, timefn
from roadpulse.operators import clean
from roadpulse.sources import incidents as src


def test_timestamp_subformats(spark):
    vals = ["2024-03-07 17:01:48.111+00", "2024-01-30 04:17:46.828979+00", "2024-02-12 02:05:46+00",
            "2024-02-12 07:35:46+05:30", "", "junk", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(timefn.parse_ts("s")).collect()]
    assert got[0] == dt.datetime(2024, 3, 7, 17, 1, 48, 111000)
    assert got[1] == dt.datetime(2024, 1, 30, 4, 17, 46, 828979)
    assert got[2] == dt.datetime(2024, 2, 12, 2, 5, 46)
    assert got[3] == dt.datetime(2024, 2, 12, 2, 5, 46)   # +05:30 normalised to UTC
    assert got[4:] == [None, None, None]


def test_strict_parse_counts_and_fails(spark):
    df = spark.createDataFrame([("2024-02-12 02:05:46+00",), ("bad",), (None,)], "t string")
    assert clean.count_unparseable(df, "t") == 2
    with pytest.raises(ValueError, match="2 rows"):
        clean.strict_parse(df, "t")
    assert clean.strict_parse(df.limit(1), "t").first()["t"] == dt.datetime(2024, 2, 12, 2, 5, 46)


def test_strip_lower_and_blank(spark):
    df = spark.createDataFrame([(" Debris ",), ("debris",), ("\tDebris\n",), (None,), ("  ",)], "c string")
    got = [r[0] for r in df.select(text.strip_lower("c")).collect()]
    assert got == ["debris", "debris", "debris", None, ""]
    got = [r[0] for r in df.select(text.blank_to("c")).collect()]
    assert got[3:] == ["unknown", "unknown"]


def test_temporal_features_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 20, 0),)], "start_datetime timestamp")  # Sun 20:00 UTC
    r = clean.with_temporal_features(df).first()
    # 20:00 UTC is 01:30 Monday in India
    assert (r["hour_of_day"], r["day_of_week"], r["month"]) == (1, 0, 1)


def test_planned_flag_and_fill(spark):
    df = spark.createDataFrame([("planned", None), ("unplanned", "lcv"), (None, None)], "event_type string, veh_type string")
    out = clean.fill_categoricals(clean.with_planned_flag(df)).collect()
    assert [r["is_planned"] for r in out] == [1, 0, 0]
    assert [r["veh_type"] for r in out] == ["unknown", "lcv", "unknown"]


def test_csv_required_columns(spark, tmp_path):
    p = tmp_path / "inc.csv"
    p.write_text('id,start_datetime,latitude\n1,"2024-02-12 02:05:46+00",12.9\n')
    with pytest.raises(KeyError):
        src.load_incidents_csv(spark, str(p))
    with pytest.raises(FileNotFoundError):
        src.load_incidents_csv(spark, str(tmp_path / "missing.csv"))
    p.write_text('id,latitude,longitude,description\n1,12.9,77.6,"two\nlines"\n')
    rows = src.load_incidents_csv(spark, str(p)).collect()
    assert len(rows) == 1 and rows[0]["description"] == "two\nlines"


def test_graphml_reader(spark, tmp_path):
    p = tmp_path / "g.graphml"
    p.write_text("""<?xml version='1.0' encoding='utf-8'?>
<graphml><graph edgedefault="directed">
<node id="1"><data key="x">77.5</data><data key="y">12.9</data></node>
<node id="2"><data key="x">77.6</data><data key="y">13.0</data></node>
<edge source="1" target="2" id="0"><data key="length">12.5</data><data key="name">A</data></edge>
<edge source="2" target="1" id="0"><data key="name">B</data></edge>
</graph></graphml>""")
    nodes, edges = src.read_graphml(spark, str(p))
    assert sorted((r["node_id"], r["x"], r["y"]) for r in nodes.collect()) == [(1, 77.5, 12.9), (2, 77.6, 13.0)]
    e = sorted((r["u"], r["v"], r["key"], r["length"]) for r in edges.collect())
    assert e == [(1, 2, 0, 12.5), (2, 1, 0, None)]


def test_graphml_numbered_keys_and_geometry(spark, tmp_path):
    head = """<?xml version='1.0' encoding='utf-8'?><graphml>
<key id="d4" for="node" attr.name="x" attr.type="double"/><key id="d5" for="node" attr.name="y" attr.type="double"/>
<key id="d7" for="edge" attr.name="name" attr.type="string"/>%s<key id="d12" for="edge" attr.name="geometry" attr.type="string"/>
<graph edgedefault="directed"><node id="1"><data key="d4">0.5</data><data key="d5">1</data></node>
<node id="2"><data key="d4">3</data><data key="d5">4</data></node>
<edge source="1" target="2" id="0"><data key="d9">12.5</data><data key="d12">LINESTRING (0.5 1, 2 2, 3 4)</data></edge>
<edge source="2" target="1" id="1"><data key="d7">length</data></edge></graph></graphml>"""
    p = tmp_path / "g.graphml"
    p.write_text(head % '<key id="d9" for="edge" attr.name="length" attr.type="double"/>')
    nodes, edges = src.read_graphml(spark, str(p))
    assert sorted((r["u"], r["key"], r["length"]) for r in edges.collect()) == [(1, 0, 12.5), (2, 1, None)]
    assert sorted((r["node_id"], r["x"], r["y"]) for r in nodes.collect()) == [(1, 0.5, 1.0), (2, 3.0, 4.0)]
    assert sorted(tuple(r) for r in src.edge_segments(nodes, edges).collect()) == [
        (1, 2, 0, 0.5, 1.0, 2.0, 2.0), (1, 2, 0, 2.0, 2.0, 3.0, 4.0), (2, 1, 1, 3.0, 4.0, 0.5, 1.0)]
    p.write_text(head % "")
    with pytest.raises(ValueError, match="no 'length'"):
        src.read_graphml(spark, str(p))


def test_header_peek(spark):
    from conftest import SF001
    from roadpulse.sources.tables import schema_only
    assert schema_only(spark, f"{SF001}/events.parquet").fieldNames()[:2] == ["event_id", "ts"]
    assert F is not None


def test_filter_with_accounting_single_pass(spark):
    from conftest import SF01
    from roadpulse.plans.adapters import x1_lifecycle
    df = clean.with_resolution_minutes(x1_lifecycle(spark, SF01))
    kept, obs = clean.filter_with_accounting(df, hi=525600.0)
    n_kept = kept.count()
    m = obs.get
    ref = clean.rejection_counts(df, hi=525600.0).first()
    assert m["n_after_filter"] == n_kept == ref["n_after_filter"] == 1886
    for k in ("n_before_filter", "removed_no_end", "removed_negative", "removed_over_window"):
        assert m[k] == ref[k]

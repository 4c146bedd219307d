import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["event_cause", "n", "min", "p25", "p50", "mean", "p75", "max", "std"]


def test_catalogue_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70
    # every query of the library itself has an oracle
    from roadpulse.plans import registry
    assert not (set(q) - set(o)) & set(registry.QUERIES)


def test_queries_pin_utc_on_foreign_session(spark):
    from conftest import SF001
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = entry.queries()["temporal_features"](spark, SF001).orderBy("incident_id").first()
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
        # first event 2024-01-01 00:09:58 UTC -> 05:39:58 in India, a Monday
        assert (row["hour_of_day"], row["day_of_week"], row["month"]) == (5, 0, 1)
        assert row["local_time"].startswith("2024-01-01 05:39:58")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

"""Structured Streaming behaviour that the batch twins cannot show."""

import datetime as dt
import time

from pyspark.sql import functions as F

from roadpulse.streaming import jobs


def test_late_row_dropped_behind_watermark(spark, tmp_path):
    src = tmp_path / "in"
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    batches = [
        [(i, t0 + dt.timedelta(hours=h, minutes=10)) for i, h in enumerate(range(4))],
        [(11, t0 + dt.timedelta(hours=5, minutes=10))],   # advances the watermark, closes hours 0-1
        [(10, t0 + dt.timedelta(minutes=20))],            # late: hour 0 is already closed
    ]
    schema = "incident_id long, event_time timestamp"
    for name, rows in zip("abc", batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))
        time.sleep(1.1)

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(str(src)))
    out = str(tmp_path / "out")
    jobs.run_available_now(jobs.hourly_counts(stream), out, mode="append")
    got = {r["window_start"].hour: r["n"] for r in spark.read.parquet(f"{out}/data").collect()}
    # the late row never joins hour 0; windows still open at the end are not emitted
    assert got.get(0) == 1
    assert 5 not in got
    assert set(got) <= {0, 1, 2, 3}


def test_dedup_within_watermark(spark, tmp_path):
    src = tmp_path / "in"
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    rows = [(1, t0), (2, t0 + dt.timedelta(minutes=5)), (1, t0 + dt.timedelta(minutes=1))]
    schema = "incident_id long, event_time timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    out = str(tmp_path / "out")
    jobs.run_available_now(jobs.dedup(stream, "incident_id"), out)
    assert sorted(r["incident_id"] for r in spark.read.parquet(f"{out}/data").collect()) == [1, 2]


def test_stream_reads_files_and_folders(spark, tmp_path):
    """A table that is one file and one that is a folder of parts, in several micro-batches."""
    rows = spark.range(100).selectExpr("id AS incident_id", "timestamp_seconds(id * 600) AS event_time")
    rows.repartition(4).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "parts"))
    part = next((tmp_path / "parts").glob("part-*.parquet"))
    (tmp_path / "single").mkdir()
    (tmp_path / "single" / "events.parquet").write_bytes(part.read_bytes())
    want = {r["h"]: r["n"] for r in rows.groupBy(F.date_trunc("hour", "event_time").alias("h")).agg(F.count("*").alias("n")).collect()}
    for shape in ("folder", "single"):
        stream = jobs.file_stream(spark, str(tmp_path / shape), "events.parquet", files_per_batch=1)
        out = str(tmp_path / f"out-{shape}")
        jobs.run_available_now(stream.select("incident_id"), out)
        assert spark.read.parquet(f"{out}/data").count() == 100
        out = str(tmp_path / f"hours-{shape}")
        stream = jobs.file_stream(spark, str(tmp_path / shape), "events.parquet")
        jobs.run_available_now(jobs.hourly_counts(stream), out, mode="update", batch_fn=jobs.upsert_batch)
        got = jobs.latest(spark.read.parquet(f"{out}/data"), ["window_start"], ["n"])
        assert {r["window_start"]: r["n"] for r in got.collect()} == want


def test_resumed_run_knows_state_and_watermark(spark, tmp_path):
    """Two runs over a growing folder: an open hour goes on counting, a repeated
    row is known again, a late row counts nowhere."""
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    first = [(1, t0), (2, t0 + dt.timedelta(hours=4)), (3, t0 + dt.timedelta(hours=4, minutes=10))]
    second = [(4, t0 + dt.timedelta(hours=4, minutes=50)), (5, t0 + dt.timedelta(hours=6)),
              (2, t0 + dt.timedelta(hours=4)),        # again, inside the watermark
              (9, t0 + dt.timedelta(minutes=30))]     # late: its hour is closed
    schema = "incident_id long, event_time timestamp"
    folder = str(tmp_path / "in")
    ids, hours = str(tmp_path / "ids"), str(tmp_path / "hours")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.resume(spark, folder, schema, lambda s: jobs.dedup(s, "incident_id"), ids)
        jobs.resume(spark, folder, schema, jobs.hourly_counts, hours, "update", jobs.upsert_batch)
    assert sorted(r["incident_id"] for r in spark.read.parquet(f"{ids}/data").collect()) == [1, 2, 3, 4, 5]
    got = jobs.latest(spark.read.parquet(f"{hours}/data"), ["window_start"], ["n"])
    assert {r["window_start"].hour: r["n"] for r in got.collect()} == {0: 1, 4: 4, 6: 1}
    jobs.resume(spark, folder, schema, lambda s: jobs.dedup(s, "incident_id"), ids)  # nothing new
    assert spark.read.parquet(f"{ids}/data").count() == 5

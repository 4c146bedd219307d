"""Structured Streaming jobs (ST1-ST4): intake -> validate -> features -> models
-> score -> queue with a quarantine and running KPIs, scoring of rows that
carry their predictions, running roll-ups, windowed hour counts,
duplicate-submission guard.

Every job reads a file stream with a declared schema, keeps its state and
offsets in a checkpoint folder under the session's reliable checkpoint
directory (so a restarted job resumes exactly), and writes to a file sink —
never to the driver's memory. ``run_available_now`` drains what is there and
stops, which lets the same job be checked against its batch twin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.operators import queue as queue_ops
from roadpulse.operators.risk import RiskScorer
from roadpulse.session import scratch_path, stored


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that Spark itself uses for the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def file_stream(spark: SparkSession, folder: str, table: str, schema=None, files_per_batch: int = 1000) -> DataFrame:
    """A parquet stream over ``folder/table``, which may be one file or (as
    Spark itself writes tables) a folder of part files."""
    path = f"{folder.rstrip('/')}/{table}"
    if schema is None:
        schema = spark.read.parquet(path).schema  # footer only (S4)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", table).parquet(folder)


def new_run_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream/{name}/{uuid.uuid4().hex}")


def run_available_now(stream: DataFrame, out: str, mode: str = "append", fmt: str = "parquet",
                      batch_fn=None) -> None:
    """Drain the source once and stop. ``batch_fn`` switches to foreachBatch."""
    w = stream.writeStream.option("checkpointLocation", f"{out}/_checkpoint").outputMode(mode)
    if batch_fn is not None:
        q = w.foreachBatch(lambda df, epoch: batch_fn(df, epoch, f"{out}/data")).trigger(availableNow=True).start()
    else:
        q = w.format(fmt).option("path", f"{out}/data").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover
        raise RuntimeError(str(q.exception()))


def resume(spark: SparkSession, folder: str, schema, job, out: str, mode: str = "append", batch_fn=None) -> None:
    """One more run of ``job`` over a folder that files keep arriving in.

    Which files were read, the watermark and the state come from the checkpoint
    under ``out`` alone, so runs may be days and sessions apart: a row of an
    earlier run is known again, and one behind its watermark is late."""
    run_available_now(job(spark.readStream.schema(schema).parquet(folder)), out, mode, batch_fn=batch_fn)


def upsert_batch(df: DataFrame, epoch: int, path: str) -> None:
    """Update-mode rows, kept per epoch (a repeated epoch replaces itself)."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def latest(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last update of every key."""
    new = F.max_by(F.struct(*values), "epoch").alias("new")
    return df.groupBy(*keys).agg(new).select(*keys, "new.*")


def overwrite_batch(df: DataFrame, epoch: int, path: str) -> None:
    """Complete-mode state written as a table; the last epoch wins (idempotent)."""
    df.write.mode("overwrite").parquet(path)


def score_stream(events: DataFrame, scorer: RiskScorer) -> DataFrame:
    """ST1: stateless intake -> score -> queue rows (new incidents)."""
    scored = scorer.score(events)
    return queue_ops.build_queue(scored, is_new=True).drop("reported_at")


def corridor_totals(q: DataFrame) -> DataFrame:
    """ST2: running total and count of CRS per corridor (stateful aggregate)."""
    return q.groupBy("corridor").agg(F.sum("crs").alias("total_crs"), F.count(F.lit(1)).alias("count"))


def hourly_counts(events: DataFrame, ts: str = "event_time", watermark: str = "1 hour") -> DataFrame:
    """ST3: 1-hour tumbling windows on event time behind a watermark."""
    return (events.withWatermark(ts, watermark).groupBy(F.window(ts, "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "n"))


def dedup(events: DataFrame, key: str, ts: str = "event_time", watermark: str = "1 hour") -> DataFrame:
    """ST4: drop re-submissions of the same id that arrive within the watermark."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def _epoch_sink(df: DataFrame, out: str, name: str, epoch: int) -> None:
    """A repeated epoch (after a failure) replaces what it wrote before."""
    df.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")


def kpi_state(q: DataFrame) -> DataFrame:
    """A9 in a form that adds up over epochs: counts per tier and the sum of scores."""
    return q.agg(F.count(F.lit(1)).alias("n_active"), *[F.count_if(F.col("priority") == t).alias(f"n_{t.lower()}") for t in queue_ops.TIERS],
                 F.sum("crs").alias("sum_crs"), F.count("crs").alias("n_crs"))


def running_kpis(states: DataFrame) -> DataFrame:
    """A9 + A10 after every epoch, from the epochs' states (one row each)."""
    from pyspark.sql import Window
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    counts = ["n_active", *[f"n_{t.lower()}" for t in queue_ops.TIERS]]
    upto = states.select("epoch", *[F.sum(c).over(w).alias(c) for c in counts],
                         F.try_divide(F.sum("sum_crs").over(w), F.sum("n_crs").over(w)).alias("avg"))
    return upto.select("epoch", *counts, F.round("avg", 6).alias("avg_crs"), F.round(
        F.lit(100.0) - F.least(F.lit(95.0), F.coalesce("avg", F.lit(0.0))), 6).alias("readiness"), queue_ops.status_of().alias("ops_status"))


def running_top_corridors(totals: DataFrame, n: int = 5) -> DataFrame:
    """W4 + W9 over the epochs' corridor totals (corridor, total_crs, count)."""
    from pyspark.sql import Window
    top = totals.groupBy("corridor").agg(F.sum("total_crs").alias("total_crs"), F.sum("count").alias("count")).orderBy(
        F.desc("total_crs"), F.asc("corridor")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_crs"), F.asc("corridor"))))  # n rows


def queue_sinks(q: DataFrame, out: str, epoch: int) -> None:
    """Queue rows of an epoch, its KPI state and its corridor totals."""
    q = stored(q)
    _epoch_sink(q, out, "queue", epoch)
    _epoch_sink(kpi_state(q), out, "kpis", epoch)
    _epoch_sink(corridor_totals(q), out, "corridors", epoch)


def intake(inference):
    """ST1 (F5, P26, M8, M13, U2): a batch function for ``run_available_now``.

    Rows of a micro-batch are checked against the stored lists and bounds;
    accepted ones get features, both models' predictions and a risk score and
    join the queue, the others go to the quarantine with the rules they broke.
    Both sinks, the KPIs and the corridor totals are written per epoch."""
    from roadpulse.operators import validate

    def run(df: DataFrame, epoch: int, path: str) -> None:
        out = path.removesuffix("/data")
        accepted, refused = validate.quarantine(stored(inference.validated(df)))
        _epoch_sink(refused, out, "quarantine", epoch)
        queue_sinks(queue_ops.build_queue(inference.predict(accepted), is_new=True).drop("reported_at"), out, epoch)
    return run

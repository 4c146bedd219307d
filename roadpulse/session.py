"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC session clock (timestamps are compared
# wall-clock against the SQL oracle), AQE for runtime re-planning (partition
# coalescing, skew-join splitting, broadcast conversion from real sizes).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "roadpulse", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster the launcher owns master and sizing."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings the operators' semantics depend on, applied to any session
    (e.g. one the caller built): a UTC session clock and a checkpoint folder."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext.master.startswith("local")
    except Exception:  # pragma: no cover - connect sessions have no context
        return False


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory for this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is used
    as is. Only a local session (tests) without the setting gets its own
    scratch folder; a cluster session without it is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="roadpulse-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables, next to the reliable checkpoints."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage,
    survives the loss of executors, and (unlike an eager checkpoint) runs the
    plan once."""
    path = scratch_path(df.sparkSession, f"t-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with_metrics(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """``stored``, whose one job also returns aggregate metrics
    (``DataFrame.observe``): a round's size or progress costs no extra job."""
    from pyspark.sql import Observation
    obs = Observation()
    out = stored(df.observe(obs, *[m.alias(k) for k, m in metrics.items()]))
    return out, obs.get


class RoundState:
    """Iteration state for loops of DataFrame jobs.

    Every round's frame is written to the shared folder: that truncates
    its logical plan (a chain of persisted frames still re-plans the whole
    chain each round, which was measured to grow the round time linearly)
    and a lost executor costs a re-read, not a recompute. ``step`` also
    returns the row count, observed by the writing job itself, which the
    driver uses to decide whether to go on.
    """

    def __init__(self):
        self.rounds = 0

    def step(self, df: DataFrame) -> tuple[DataFrame, int]:
        from pyspark.sql import functions as F
        self.rounds += 1
        df, m = stored_with_metrics(df, n=F.count(F.lit(1)))
        return df, m["n"]

    def keep(self, df: DataFrame) -> DataFrame:
        return stored(df)

"""Cascade risk score (M13, P19-P23, J6) and its fitted scorer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions import risk as rf
from roadpulse.operators.quantile import (QuantileModel, add_quantile_ranks, fit_quantiles,
                                          model_frame, models_from_frame)


@dataclass
class RiskScorer:
    """Fitted on TRAIN only; never refit on later rows."""

    time_model: QuantileModel | None = None
    centrality_model: QuantileModel | None = None

    def fit(self, train: DataFrame, minutes: str = "resolution_minutes",
            centrality: str = "centrality_score") -> "RiskScorer":
        models = fit_quantiles(train.select(F.col(minutes).alias("t"), F.col(centrality).alias("c")), ["t", "c"])
        self.time_model, self.centrality_model = models["t"], models["c"]
        return self

    def score(self, df: DataFrame, p: str = "closure_probability", t: str = "predicted_resolution_minutes",
              c: str = "centrality_score", keep_raw: bool = True) -> DataFrame:
        """Adds p/t/c norms, impact, score (half-even 4 dp / 2 dp), priority and action."""
        if self.time_model is None or self.centrality_model is None:
            raise RuntimeError("fit the scorer on TRAIN before scoring")
        out = add_quantile_ranks(df.withColumn("__p", rf.clip01(p)),
                                 [(t, self.time_model, "__t"), (c, self.centrality_model, "__c")])
        out = out.withColumn("__i", rf.impact("__t", "__c"))
        out = out.withColumn("__s", rf.geometric_score("__p", "__i"))
        score = rf.round_half_even("__s", 2)
        out = out.withColumns({
            "p_norm": rf.round_half_even("__p", 4),
            "t_norm": rf.round_half_even("__t", 4),
            "c_norm": rf.round_half_even("__c", 4),
            "impact": rf.round_half_even("__i", 4),
            "cascade_risk_score": score,
        })
        out = out.withColumns({"priority": rf.band_label("cascade_risk_score"),
                               "recommended_action": rf.band_action("cascade_risk_score")})
        return out.drop("__p", "__t", "__c", "__i", "__s")

    # S11 persistence: a one-row parquet of the two cut-point arrays
    def save(self, spark: SparkSession, path: str) -> None:
        model_frame(spark, {"time": self.time_model, "centrality": self.centrality_model}) \
            .write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "RiskScorer":
        m = models_from_frame(spark.read.parquet(path))
        return RiskScorer(m["time"], m["centrality"])


def bands_frame(spark: SparkSession) -> DataFrame:
    """The five bands as a dimension table (lo, hi, priority, action)."""
    return spark.createDataFrame([(float(lo), float(hi), lab, act) for lo, hi, lab, act in rf.RISK_BANDS],
                                 "lo double, hi double, priority string, recommended_action string")


def band_by_range_join(df: DataFrame, score: str = "cascade_risk_score") -> DataFrame:
    """The band lookup as a broadcast range join (five fixed rows).

    Out-of-range non-null scores fall back to the last band, as the CASE form
    does; the broadcast side is the fixed five-row table, so its size is known.
    """
    bands = F.broadcast(bands_frame(df.sparkSession))
    j = df.join(bands, (F.col(score) >= bands.lo) & (F.col(score) < bands.hi), "left")
    last = rf.RISK_BANDS[-1]
    return j.select(*df.columns,
                    F.when(F.col(score).isNull(), F.lit(None)).otherwise(
                        F.coalesce("priority", F.lit(last[2]))).alias("priority"),
                    F.when(F.col(score).isNull(), F.lit(None)).otherwise(
                        F.coalesce("recommended_action", F.lit(last[3]))).alias("recommended_action"))

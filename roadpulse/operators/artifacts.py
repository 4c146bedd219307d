"""Inference from stored artefacts alone.

``save`` writes one folder: the two fitted pipelines, the risk scorer's cut
points and a document of rows (section, name, value, n, number), one JSON object
a line, written in parallel, since vocabularies and encoders grow with the
data. ``Inference.load`` builds every transform from that folder; TRAIN rows
are not needed, nor anything fitted in the session. Only the document's short
sections (feature lists, defaults, threshold) come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.operators import encode, learn, validate
from roadpulse.operators.risk import RiskScorer
from roadpulse.session import stored
from roadpulse.sources import incidents as src

DOCUMENT = T.StructType.fromDDL("section string, name string, value string, n bigint, number double")
MODELS = ("regressor", "classifier")
SHORT = ("numeric_feature", "categorical_feature", "encoder_default", "threshold", "allowed_list")


def save(spark: SparkSession, folder: str, models: dict[str, PipelineModel], specs: dict[str, learn.FeatureSpec],
         encoders: dict[tuple[str, str], tuple[DataFrame, float]], scorer: RiskScorer, vocab: DataFrame, allowed: list[str],
         threshold: float) -> None:
    """``encoders`` maps (model, column) to its table (value, te) and default;
    ``allowed`` are the columns whose values must be in ``vocab`` (feature, value)."""
    for name in MODELS:
        models[name].write().overwrite().save(f"{folder}/{name}")
    scorer.save(spark, f"{folder}/scorer")
    rows = [("threshold", "closure_probability", None, None, float(threshold))]
    rows += [("allowed_list", "intake", c, i, None) for i, c in enumerate(allowed)]
    for name in MODELS:
        rows += [("numeric_feature", name, c, i, None) for i, c in enumerate(specs[name].numeric)]
        rows += [("categorical_feature", name, c, i, None) for i, c in enumerate(specs[name].categorical)]
    rows += [("encoder_default", model, c, None, float(g)) for (model, c), (_, g) in encoders.items()]
    document = spark.createDataFrame(rows, DOCUMENT)
    none = F.lit(None).cast("bigint")
    for (model, c), (table, _) in encoders.items():
        document = document.unionByName(table.select(F.lit("encoder").alias("section"), F.lit(f"{model}:{c}").alias("name"), "value",
                                                     none.alias("n"), F.col("te").alias("number")))
    document = document.unionByName(vocab.select(F.lit("vocabulary").alias("section"), F.col("feature").alias("name"), "value",
                                                 none.alias("n"), F.lit(None).cast("double").alias("number")))
    src.write_metadata(document, f"{folder}/document")


@dataclass
class Inference:
    models: dict[str, PipelineModel]
    specs: dict[str, learn.FeatureSpec]
    encoders: dict[tuple[str, str], tuple[DataFrame, float]]
    scorer: RiskScorer
    vocab: DataFrame
    allowed: list[str]
    threshold: float

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Inference:
        document = src.read_metadata(spark, f"{folder}/document", DOCUMENT)
        short = document.where(F.col("section").isin(*SHORT)).collect()
        of = lambda section, name: [r["value"] for r in sorted((r for r in short if (r["section"], r["name"]) == (section, name)),
                                                                key=lambda r: r["n"])]
        tables = stored(document.where("section = 'encoder'").select("name", "value", F.col("number").alias("te")))
        vocab = stored(document.where("section = 'vocabulary'").select(F.col("name").alias("feature"), "value"))
        encoders = {(r["name"], r["value"]): (tables.where(F.col("name") == f"{r['name']}:{r['value']}").select("value", "te"), r["number"])
                    for r in short if r["section"] == "encoder_default"}
        return Inference({m: PipelineModel.load(f"{folder}/{m}") for m in MODELS},
                         {m: learn.FeatureSpec(of("numeric_feature", m), of("categorical_feature", m)) for m in MODELS}, encoders,
                         RiskScorer.load(spark, f"{folder}/scorer"), vocab, of("allowed_list", "intake"),
                         next(r["number"] for r in short if r["section"] == "threshold"))

    def encoded(self, df: DataFrame, model: str) -> DataFrame:
        """``df`` with the model's target encodings; unknown values take the default."""
        for (name, c), (table, default) in self.encoders.items():
            if name == model:
                df = encode.apply_encoder(df, table, c, default)
        return df

    def validated(self, df: DataFrame) -> DataFrame:
        """F5 by the stored lists."""
        return validate.validate(df, self.vocab, self.allowed)

    def predict(self, df: DataFrame) -> DataFrame:
        """M8 + M13: ``predicted_resolution_minutes``, ``closure_probability``,
        ``closure_expected`` (by the stored threshold) and the risk score's columns."""
        names = [c for c in df.columns if c not in ("predicted_resolution_minutes", "closure_probability")]
        df = df.select(*names)
        p = learn.predict_minutes(self.models["regressor"], self.encoded(df, "regressor"), self.specs["regressor"])
        p = p.select(*names, "predicted_resolution_minutes")
        p = learn.predict_probability(self.models["classifier"], self.encoded(p, "classifier"), self.specs["classifier"])
        p = p.select(*names, "predicted_resolution_minutes", "closure_probability")
        return self.scorer.score(p).withColumn("closure_expected", F.col("closure_probability") >= F.lit(self.threshold))

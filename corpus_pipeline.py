"""A corpus cleaning pipeline from five operators of ``roadpulse.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read back as the next
stage's docs. All but the last return the columns of ``documents``.

Defined results, of every stage: null and empty texts are texts without words
(quality rules reject them; alone in a stage, they stay or are packed as one
end token); repeated rows are judged alike, near-dedup keeps one of them; null
ids are allowed; an empty table gives an empty result; columns besides doc_id,
text and source pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadpulse.llm.common import materialize, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or whose host does, go."""
    from roadpulse.llm.quality import kept_documents
    return kept_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    from roadpulse.llm.golay import one_of_each
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one are cut out of the texts."""
    from roadpulse.llm.lines import deduplicated_documents
    return deduplicated_documents(docs, length_column="n_chars" if "n_chars" in docs.columns else None)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a span of words with the benchmark go."""
    from roadpulse.llm.winnowing import clean_documents
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised and packed into sequences."""
    from roadpulse.llm.packing import pack
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

# XXH64 fingerprints, their components and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

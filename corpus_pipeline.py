"""The corpus pipeline: quality rules, quality classifier, line dedup, near-dedup and packing, one after another.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but the last return
the columns of documents. run() writes every stage's result to the shared folder of the cluster and reads it again.

Documents without words are rejected by the rules. Null ids have no label; of rows with equal texts, one stays. Extra
columns, whatever their names, pass through all stages but the last. An empty table gives an empty result; repeated rows
are judged alike and one of them stays; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import line_dedup, minhash, packing, quality_classifier, quality_rules
from tallyforge.llm.common import has_path, scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or the n-gram ratio."""
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored under 0.5 by a model of all labelled documents, not only of those that the rules left.
    Where sf_dir has no documents table (the stage is used by itself), the model is of docs."""
    path = f"{sf_dir}/documents.parquet"
    known = spark.read.parquet(path) if has_path(spark, path) else docs
    return quality_classifier.keep_good(docs, _labels(spark, sf_dir), known=known)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts each source's boilerplate lines out of its texts."""
    return line_dedup.drop_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return minhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The length bucket, batch and slot of every document that is left."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: SQL has neither the rules' hash nor the classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as room:
        for _, stage in STAGES:
            docs = room.keep(stage(spark, docs, sf_dir))
        return docs.checkpoint()

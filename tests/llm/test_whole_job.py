"""Operators on inputs on which a part of the job used to be left out."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import packing, quality_classifier


def test_classifier_stage_learns_from_documents_that_are_gone(spark, tmp_path):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    text = lambda good: " ".join(rng.choice(words) + ("" if good or rng.random() < 0.5 else rng.choice(["###", "$$$"])) for _ in range(60))
    rows = [(i, text(i % 4 > 0), int(i % 4 > 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs.where(quality_classifier.held_out() | (F.col("doc_id") % 4 > 0))  # every bad one that training may see is gone
    out = {r.doc_id for r in corpus_pipeline.quality_classifier_stage(spark, left, str(tmp_path)).collect()}
    bad = {r.doc_id for r in left.where("doc_id % 4 = 0").collect()}
    assert len(bad) > 30 and len(out & bad) <= 0.03 * len(bad) and len(out) > 0.97 * 450


def test_training_bound_is_not_spent_on_labels_without_document(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "MAX_LABELLED", 200)
    docs = spark.createDataFrame([(i, "good words all the way" if i % 2 else "### bad ### words $$$") for i in range(200)], "doc_id long, text string")
    labels = spark.range(2_000_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic")
    out = quality_classifier.keep_good(docs, labels).toPandas()
    assert sorted(out.doc_id) == list(range(1, 200, 2))


@pytest.mark.parametrize("longest", [1_000, 1_000_000])
def test_one_long_text_does_not_coarsen_the_boundaries(spark, longest):
    rng = random.Random(8)
    lengths = [rng.randint(1, 400) for _ in range(500)] + [longest]
    n, least = sorted(lengths), [0.0] + [float("inf")] * len(lengths)
    for _ in range(4):  # the least padded total of the first j lengths, by trying every cut
        least = [0.0] + [min(least[i] + (j - i) * n[j - 1] for i in range(j)) for j in range(1, len(n) + 1)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n int")
    out = packing.pack(rows, "n", buckets=4).toPandas()
    assert out.padding.sum() == least[-1] - sum(lengths) and (out.padding >= 0).all() and set(out.bucket_len) <= set(lengths)

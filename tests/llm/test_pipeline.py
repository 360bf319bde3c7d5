"""The pipeline as a whole against plain Python over the same documents."""

import re
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from test_edges import brute_components

from tallyforge.llm import line_dedup, packing, quality_classifier, quality_rules

DIR = "/root/testdata/sf0.001"


def lines_out(docs):
    pages = Counter(source for _, _, source in docs)
    has = Counter((source, x) for _, text, source in docs for x in set(text.split("\n")) if x.strip(" \t\n\x0b\x0c\r"))
    bad = {k for k, n in has.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    return [(i, "\n".join(x for x in text.split("\n") if (source, x) not in bad), source) for i, text, source in docs]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = {r.doc_id for r in quality_rules.with_rules(docs, labels).where("quality.kept").collect()}  # held against brute force in test_edges
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good)
    model = quality_classifier.train(docs, quality_classifier.quality_labels(labels))
    score = quality_classifier.scores(pa.array([t for _, t, _ in rows]), model)
    rows = lines_out([r for r, s in zip(rows, score, strict=True) if s >= 0.5])
    _, root = brute_components([t for _, t, _ in rows], 5, 80)
    kept = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for k, r in enumerate(rows) if root[k] == k}
    out = corpus_pipeline.run(spark, DIR).toPandas()
    assert dict(zip(out.doc_id, out.length, strict=True)) == kept
    tops = sorted(max(1, n) for n in kept.values())
    least = [0.0] + [float("inf")] * len(tops)
    for _ in range(packing.BUCKETS):  # the least padded total of the shortest j documents, by trying every cut
        least = [0.0] + [min(least[i] + (j - i) * tops[j - 1] for i in range(j)) for j in range(1, len(tops) + 1)]
    assert out.padding.sum() == least[-1] - sum(kept.values()) and (out.padding == out.bucket_len - out.length).all()
    batches = out.groupby(["bucket", "batch"]).agg(n=("slot", "size"), top=("slot", "max"), wide=("bucket_len", "first"))
    assert ((batches.n * batches.wide <= packing.BUDGET) | (batches.n == 1)).all() and (batches.top == batches.n - 1).all()


def test_sql_of_the_operators(spark):
    import os

    import duckdb

    from tallyforge.llm import queries

    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, DIR).toPandas(), c.sql(sql).df()
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        key = next(k for k in ("doc_id", "page_id", "conv_id") if k in columns)
        assert got[columns].sort_values(key).values.tolist() == want[columns].sort_values(key).values.tolist(), name

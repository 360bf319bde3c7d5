"""The quality classifier's scores against FTRL in plain Python: features counted by regular expressions, weights in dicts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries
from tallyforge.llm import quality_classifier as qc
from tallyforge.llm.bytesops import hashed_pieces, mix

DIR = "/root/testdata/sf0.001"
RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")
KNOWN: dict[bytes, int] = {}


def number(run):
    """A run's hash, taken of the run alone."""
    if run not in KNOWN:
        KNOWN[run] = int(hashed_pieces(np.frombuffer(run, np.uint8), np.array([0, len(run)]), qc.KIND)[0][0])
    return KNOWN[run]


def grams(text):
    runs = [number(r) for r in RUN.findall((text or "").encode())]
    out = list(runs)
    for a, b in zip(runs, runs[1:], strict=False):
        out.append(int(mix(np.array([(a * 0xD6E8FEB86659FD93 + b) % 2**64], np.uint64))[0]))
        if a == b:
            out.append(int(qc.TWICE))
    out += [int(qc.AROUND) for a, b in zip(runs, runs[2:], strict=False) if a == b]
    return Counter(h >> (64 - qc.BITS) for h in out)


def values(text):
    n = grams(text)
    all_ = max(1, sum(n.values()))
    return {**{k: float(np.float32(qc.SCALE * c / all_)) for k, c in n.items()}, "bias": 1.0}


def learned(rows):
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= qc.L1:
            return 0.0
        return -(z[k] - math.copysign(qc.L1, z[k])) / ((qc.BETA + math.sqrt(n[k])) / qc.ALPHA + qc.L2)

    for _ in range(qc.EPOCHS):
        for x, label in rows:
            w = {k: weight(k) for k in x}
            miss = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items()))) - label
            for k, v in x.items():
                g = miss * v
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / qc.ALPHA * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


@pytest.mark.parametrize("shard_rows", [2_500, 30])
def test_every_score(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(qc, "SHARD_ROWS", shard_rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    labels: dict[int, int] = {}
    for r in spark.read.parquet(f"{DIR}/labels.parquet").collect():
        if r.doc_id in texts and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, 1))
    turns = {r.doc_id: r.t for r in spark.createDataFrame([(k,) for k in labels], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit("train")).alias("t")).collect()}
    shards = -(-len(labels) // shard_rows)
    weights: Counter = Counter()
    for s in range(shards):
        mine = sorted((k for k in labels if turns[k] % shards == s), key=turns.get)
        for k, w in learned([(values(texts[k]), labels[k]) for k in mine]).items():
            weights[k] += w / shards
    got = {r.doc_id: r.score for r in queries.QUERIES["op2_quality_classifier"](spark, DIR).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        want = 1 / (1 + math.exp(-sum(weights.get(f, 0.0) * v for f, v in values(t).items())))
        assert got[k] == pytest.approx(want, abs=1e-4)

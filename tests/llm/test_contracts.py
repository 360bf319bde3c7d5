"""The ten queries over a whole table against plain Python, column by column."""

import hashlib
import html
import os
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import media, packing, queries, quality_rules, sharding

os.environ["TOKENIZERS_PARALLELISM"] = "false"
DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def rows(spark, name):
    out = queries.QUERIES[name](spark, DIR)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == out.count()
    return got


def test_op1(spark, texts):
    got = rows(spark, "op1_length_buckets")
    length = {k: len(WORD.findall(t or "")) for k, t in texts.items()}
    assert {k: r.length for k, r in got.items()} == length
    tops = sorted(max(1, n) for n in length.values())
    least = [0.0] + [float("inf")] * len(tops)
    for _ in range(packing.BUCKETS):
        least = [0.0] + [min(least[i] + (j - i) * tops[j - 1] for i in range(j)) for j in range(1, len(tops) + 1)]
    assert sum(r.padding for r in got.values()) == least[-1] - sum(length.values())
    batches = Counter((r.bucket, r.batch, r.bucket_len) for r in got.values())
    assert all(n * width <= packing.BUDGET or n == 1 for (_, _, width), n in batches.items())
    assert sorted((r.bucket, r.batch, r.slot) for r in got.values()) == sorted((b, k, s) for (b, k, _), n in batches.items() for s in range(n))


def test_op2(spark, texts):
    got = rows(spark, "op2_quality_classifier")
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    held = [(r.predicted, labels[k]) for k, r in got.items() if r.held_out and labels.get(k) is not None]
    assert np.mean([p == y for p, y in held]) >= 0.9


def test_op4_op5_op9(spark, texts, tokenizer):
    four, five, nine = (rows(spark, n) for n in ("op4_token_counts", "op5_token_files", "op9_bpe_round_trip"))
    start = 0
    raw = lambda x: np.array(x, "<u4").tobytes()
    for k in sorted(texts):
        t = texts[k] or ""
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert (four[k].n_bytes, four[k].n_tokens, four[k].over_limit) == (len(t.encode()), len(ids), len(ids) > 1024)
        assert (five[k].start, five[k].n_tokens, five[k].ids_crc32) == (start, len(ids) + 1, zlib.crc32(raw([*ids, 2])))
        start += len(ids) + 1
        back = tokenizer.decode(ids, skip_special_tokens=False).encode()
        assert (nine[k].n_tokens, nine[k].ids_sha256, nine[k].decoded_sha256) == (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(back).hexdigest())
    assert set(four) == set(five) == set(nine) == set(texts)


def test_op6(spark, texts):
    got = rows(spark, "op6_balanced_shards")
    size, shards = Counter(), {}
    for k, t in texts.items():
        raw = (t or "").encode()
        r = got[k]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 24
        size[r.shard] += r["size"]
        assert shards.setdefault(t or "", r.shard) == r.shard
    assert all(sorted(r.slot for r in got.values() if r.shard == s) == list(range(n)) for s, n in Counter(r.shard for r in got.values()).items())
    groups = Counter()
    for t in texts.values():
        groups[t or ""] += len((t or "").encode()) + 8
    fair = sum(size.values()) / 24
    assert max(size[s] for s in range(24)) <= max(1.02 * fair, max(groups.values()))


def test_differencing_is_near_the_optimum_and_beats_round_robin():
    rng = np.random.default_rng(5)
    near = []
    for _ in range(20):
        sizes = rng.integers(1, 60, 9).tolist()
        spread = lambda part, k, sizes=sizes: np.ptp(np.bincount(part, weights=sizes, minlength=k))
        part = sharding.difference(sizes, 3)
        best = min(spread(np.array(p), 3) for p in product(range(3), repeat=9) if p[0] == 0)
        near.append(spread(part, 3) - best)
    assert np.mean(near) <= 4
    for _ in range(10):
        sizes = (rng.lognormal(3, 1, 400).astype(int) + 1).tolist()
        deal = np.argsort(np.argsort(sizes)) % 24
        spread = lambda part, sizes=sizes: np.ptp(np.bincount(part, weights=sizes, minlength=24))
        assert spread(sharding.difference(sizes, 24)) < 0.2 * spread(deal)


def test_op7(spark, texts):
    got = rows(spark, "op7_media_columns")
    assert set(got) == set(texts)
    features = {}
    for k, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        png = media.to_png(payload)
        assert media.from_png(png).tobytes() == payload
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert features.setdefault(raw, r.feature) == r.feature and r.caption == f"Document {k} of {len(t or '')} signs"
        lines = html.escape(t or "", quote=False).split("\n")
        before = lines[: -(-len(lines) // 2)]  # the figure stands behind these paragraphs; those without a word are no items
        assert r.position == sum(bool(html.unescape(x).split()) for x in before)


def test_op10(spark, texts):
    got = rows(spark, "op10_quality_rules")
    for k, t in texts.items():
        words = WORD.findall(t or "")
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(tri)
        hit = {j for i, x in enumerate(tri) if seen[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD - 1e-9)

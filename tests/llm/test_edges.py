"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import os
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import bpe, line_dedup, media, minhash, packing, quality_classifier, quality_rules, sharding, token_counts, token_files
from tallyforge.llm.common import scratch

os.environ["TOKENIZERS_PARALLELISM"] = "false"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, bucket int, shard int, id long, n long, root string, tf_key int, tf_run int, lines string, digest string, quality int, media string, n_bytes int, items string, stored string, payload int, tf_number int, component int, block int, position int"
random.seed(3)
LONG = " ".join(random.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(random.randint(0, 9999)) for _ in range(60_000))
TEXTS = [None, "", " \n\t", "one", "one two three", LONG, LONG + " end", "same words in this text here", "same words in this text here", "été <|endoftext|> 中文 🙂\nline  two \n x", "a b c d e f g h i j\n" * 30, "x" * 3000]


def edge_rows():
    rest = ("a", "b", 1, 2, 3, 4, "r", 5, 6, "l", "d", 7, "m", 8, "i", "s", 9, 10, 11, 12, 13)
    rows = [(k, t, "en", None if k == 3 else "src", 1, *rest) for k, t in enumerate(TEXTS)]
    return [*rows, rows[7], (None, "no id at all", None, "src", None, *rest)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r[:5] + (r[5], 1, *r[7:]) for r in edge_rows()], SCHEMA).checkpoint()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 0, 1), (7, 1, 1), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")


def folder(docs_, tmp_path):
    parts = token_files.write_tokens(docs_, f"file://{tmp_path}/ids", VOCAB, 2)
    return token_files.read_tokens(docs_.sparkSession, parts)


def pages(docs_):
    with scratch(docs_.sparkSession) as room:
        stored = media.store(room, docs_)
        found = room.keep(media.look_at(stored))
        rest = docs_.withColumn("html", media.page_of(F.col("text"), F.lit("a caption")))
        return media.resolve(media.references(media.parse(rest, "html")), found).checkpoint()


OPERATORS = {
    "pack": lambda d, lb, tmp: packing.pack_documents(d),
    "rules": lambda d, lb, tmp: quality_rules.with_rules(d, lb),
    "score": lambda d, lb, tmp: quality_classifier.score(d, quality_classifier.train(d, quality_classifier.quality_labels(lb))),
    "lines": lambda d, lb, tmp: line_dedup.with_dedup(d),
    "near": lambda d, lb, tmp: minhash.near_duplicates(d),
    "counts": lambda d, lb, tmp: token_counts.count_tokens(d, VOCAB),
    "files": lambda d, lb, tmp: folder(d, tmp),
    "shards": lambda d, lb, tmp: sharding.shard_by_bytes(d),
    "bpe": lambda d, lb, tmp: bpe.round_trip_digests(d, VOCAB),
    "parse": lambda d, lb, tmp: media.parse(d, "text"),
    "pages": lambda d, lb, tmp: pages(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_per_row(name, docs, empty, labels, tmp_path):
    out = OPERATORS[name](docs, labels, tmp_path / "a")
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = [r.asDict() for r in out.collect()]
    assert len(rows) == docs.count()
    if set(docs.columns) <= set(out.columns):  # what docs has under the same names stays what it was
        same = lambda r: str(sorted((c, str(r[c])) for c in docs.columns))
        assert sorted(map(same, rows)) == sorted(same(r.asDict()) for r in docs.collect())
    assert OPERATORS[name](empty, labels, tmp_path / "b").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_take_edges_and_empty_tables(spark, docs, empty, labels, tmp_path, k):
    labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, str(tmp_path))
    assert k == 4 or out.columns == docs.columns
    assert out.count() <= docs.count()
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_rules_count_as_plain_python(docs, labels):
    import re

    for r in quality_rules.with_rules(docs, labels).select("text", "quality_.*").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = {}
        for t in tri:
            seen[t] = seen.get(t, 0) + 1
        hit = {j for i, t in enumerate(tri) if seen[t] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), len(hit), len(lines) - len(set(lines)))
        assert (r.word_chars, r.n_symbols) == (sum(map(len, words)), sum(c in "#*$%&|<>" for c in r.text or ""))
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (r.kept and r.base_failed)


def test_rules_ratio_against_brute_force(spark):
    import math
    import re

    import xxhash

    rows = [(1, "good words here and good words there", 1), (2, "bad ### bad ### words", 0), (3, "plain words and more", None), (4, None, 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows if r[2] is not None], "doc_id long, quality int, toxic int")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), seed=42))
    as_bytes = lambda v: (v & (2**64 - 1)).to_bytes(8, "little")
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(as_bytes(b), seed=xxhash.xxh64_intdigest(as_bytes(a), seed=42)))

    def cells(text):
        h = [word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return [x % quality_rules.BUCKETS for x in h + [pair(a, b) for a, b in zip(h, h[1:], strict=False)]]

    raw, good = {}, {}
    for k, text, q in rows:
        for c in cells(text):
            raw[c] = raw.get(c, 0) + 1
            good[c] = good.get(c, 0) + (q == 1)
    n, g, b = sum(raw.values()), sum(good.values()), quality_rules.BUCKETS
    table = {c: round(1e6 * (math.log((good.get(c, 0) + 1) / (g + b)) - math.log((raw.get(c, 0) + 1) / (n + b)))) for c in raw}
    for r in quality_rules.with_rules(docs, labels).select("text", "quality.*").collect():
        found = cells(r.text)
        assert r.score == pytest.approx(sum(table[c] for c in found) / max(len(found), 1) / 1e6)


def test_tokens_equal_the_library(docs, tmp_path):
    t = Tokenizer.from_file(VOCAB)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {k: t.encode(x, add_special_tokens=False).ids for k, x in rows.items()}
    raw = lambda x: np.array(x, "<u4").tobytes()
    for r in token_counts.count_tokens(docs, VOCAB).collect():
        assert (r.n_tokens, r.n_bytes) == (len(ids[r.doc_id]), len(rows[r.doc_id].encode()))
    for r in bpe.round_trip_digests(docs, VOCAB).collect():
        back = t.decode(ids[r.doc_id], skip_special_tokens=False).encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), hashlib.sha256(raw(ids[r.doc_id])).hexdigest(), hashlib.sha256(back).hexdigest())
    start = 0
    for r in folder(docs, tmp_path).orderBy(F.asc_nulls_first("doc_id"), "start").collect():
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]) + 1, zlib.crc32(raw([*ids[r.doc_id], 2])))
        start += r.n_tokens


@pytest.mark.parametrize("segment", [1 << 19, 2])
def test_tokens_of_random_strings(monkeypatch, segment):
    from tallyforge.llm import vocab

    monkeypatch.setattr(vocab, "SEGMENT", segment)  # texts of more than two segments are looked up in parts
    t = Tokenizer.from_file(VOCAB)
    signs = ["a", "b", "the", " ", "  ", "\n", "\t", " ", "é", "1", "22", "²", "Ⅷ", "'s", "'", "!", "<|endoftext|>", "\x1c", "\x85", "中文", "🙂", " x"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 24))) for _ in range(5000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts, VOCAB)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files._table(VOCAB).look_up(texts)] == want
    assert list(token_counts._table(VOCAB).look_up(texts)) == [len(x) for x in want]


def test_media_round_trip_and_order(spark):
    for raw in (b"", b"x", b"ab" * 700, bytes(range(256)) * 9):
        payload = media.padded(raw)
        assert len(payload) % 576 == 0 and payload and media.from_png(media.to_png(payload)).tobytes() == payload
    html = "<p>First</p><script>no</script><figure><img src='media:aa' alt='x'><figcaption>A  cap</figcaption></figure><p>Last <b>one</b><img src='media:bb' alt='y'><img data-src='http://h/i.png'><video srcset='/a.png 2x, /b.png' poster='p'></p>"
    pages = spark.createDataFrame([(1, html, "k"), (2, None, "aa"), (3, "", "bb")], "page long, html string, digest string")
    items = {r.page: r["items"] for r in media.parse(pages, "html").collect()}
    assert [(i.kind, i.text or i.url, i.digest, i.caption) for i in items[1]] == [
        ("text", "First", None, None), ("media", "media:aa", "aa", "A cap"), ("text", "Last one", None, None), ("media", "media:bb", "bb", "y"),
        ("media", "http://h/i.png", None, None), ("media", "/a.png", None, None),
    ]
    assert items[2] == items[3] == [] and [i.position for i in items[1]] == list(range(6))
    found = spark.createDataFrame([("aa", 7)], "digest string, size int").checkpoint()
    got = {(r["items"].url, r["items"].position, r.digest): r.payload and r.payload.size for r in media.resolve(media.references(media.parse(pages, "html")), found).collect()}
    assert got == {("media:aa", 1, "k"): 7, ("media:bb", 3, "k"): None, ("http://h/i.png", 4, "k"): None, ("/a.png", 5, "k"): None}


def test_sequences_of_real_pages(spark):
    """The texts of a page come in its order, whatever the page, and a figure put into it keeps its place and caption."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.text, self.off = [], False

        def handle_starttag(self, tag, attrs):
            self.off = tag in ("script", "style")

        def handle_endtag(self, tag):
            self.off = False

        def handle_data(self, data):
            self.text.append("" if self.off else data)

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    put = "<figure><img src='media:{0}' alt='no'><figcaption>Figure of {0}</figcaption></figure>"
    cut = [(r.page_id, r.html.replace("</article>", put.format(r.page_id) + "</article>", 1), r.html.split("</article>", 1)[0], "</article>" in r.html) for r in rows.collect()]
    made = spark.createDataFrame([c[:2] for c in cut], "page_id long, html string")
    seen = {r.page_id: r["items"] for r in media.parse(made, "html").collect()}
    squeeze = lambda t: "".join(t.split())
    for page, html, before, has in cut:
        plain = Plain()
        plain.feed(html.replace(put.format(page), ""))
        plain.close()
        assert squeeze("".join(i.text for i in seen[page] if i.kind == "text")) == squeeze("".join(plain.text))
        found = [i for i in seen[page] if i.kind == "media"]
        assert [(i.digest, i.caption) for i in found] == [(str(page), f"Figure of {page}")] * has
        if has:
            plain = Plain()
            plain.feed(before)
            plain.close()
            assert squeeze("".join(i.text for i in seen[page][: found[0].position])) == squeeze("".join(plain.text))


def test_store_and_look_at(spark, docs):
    with scratch(spark) as room:
        stored = media.store(room, docs.select("doc_id", "text", "digest"))
        found = {r.digest: r for r in media.look_at(stored).collect()}
        for r in stored.collect():
            assert r.digest == "d" and found[r.stored.digest].payload_sha256 == r.stored.digest and found[r.stored.digest].media_bytes == len(r.stored.media)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(30):
        hist = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(8)}
        for k in (1, 2, 3, 10):
            cost = lambda bounds, hist=hist: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())
            top, rest = max(hist), [x for x in hist if x != max(hist)]
            least = min(cost([*c, top]) for m in range(min(k, len(hist))) for c in combinations(rest, m))
            assert cost(packing.boundaries(hist, k)) == least


def test_batches_keep_the_budget(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 97 + 1 AS INT) AS n")
    out = packing.pack(rows, "n", budget=500).toPandas()
    batches = out.groupby(["bucket", "batch"]).agg(n=("slot", "size"), top=("slot", "max"), wide=("bucket_len", "first"))
    assert len(out) == 5000 and (batches.n * batches.wide <= 500).all() and (batches.top == batches.n - 1).all() and (out.padding >= 0).all()


def test_differencing_beats_round_robin_and_keeps_groups(spark):
    rng = random.Random(2)
    sizes = [int(rng.lognormvariate(3, 1)) + 1 for _ in range(300)]
    part = sharding.difference(sizes, 7)
    totals = np.bincount(part, weights=sizes, minlength=7)
    assert totals.max() - totals.min() <= max(sizes) * 0.05 + 1
    docs = spark.createDataFrame([(i, "t" * (i % 37) + str(i % 50)) for i in range(2000)], "doc_id long, text string")
    out = sharding.shard_by_bytes(docs).join(docs, "doc_id").toPandas()
    assert (out.groupby("text")["shard"].nunique() == 1).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def brute_components(texts, size, percent):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_duplicates_against_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "STREAM", 4)
    monkeypatch.setattr(minhash, "AT_ONCE", 64)
    monkeypatch.setattr(minhash, "MATCHES", 500)
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 300))
    texts = [None, "", " ", "one two", "ONE two", "one two three"]
    for _ in range(6):
        base = [word() for _ in range(80)]
        for _ in range(20):
            copy = [word() if rng.random() < rng.choice([0, 0.02, 0.05]) else w for w in base]
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = minhash.near_duplicates(docs, size=4).orderBy("doc_id").collect()
    n, root = brute_components(texts, 4, 80)
    assert [r.n_shingles for r in out] == n and [r.component_id for r in out] == root and all(r.kept == (r.component_id == r.doc_id) for r in out)


def test_pruning_rule_keeps_similar_pairs():
    need = minhash.least_matches(80)
    assert need[32] < need[64] < need[128] < 0.8 * 128


def test_line_dedup_rewrites_text(spark):
    rows = [(i, f"own line {i}\nmenu home about\n\nmore {i}", "h") for i in range(40)] + [(99, "menu home about", "other"), (100, None, "h")]
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[3] == "own line 3\n\nmore 3" and out[99] == "menu home about" and out[100] is None


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    text = lambda good: " ".join(rng.choice(words) + ("" if good or rng.random() < 0.5 else rng.choice(["###", "$$$"])) for _ in range(60))
    rows = [(i, text(i % 4 > 0), int(i % 4 > 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, quality_classifier.quality_labels(labels))
    out = quality_classifier.score(docs, model).join(labels, "doc_id").where(quality_classifier.held_out()).toPandas()
    assert len(out) > 100 and ((out.score >= 0.5) == (out.quality == 1)).mean() > 0.97

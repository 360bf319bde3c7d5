"""Ids that repeat or are missing in many rows, and very long words and texts."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import bpe, common, line_dedup, minhash, packing, sharding, token_counts, token_files

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def flood(spark, n=4000):
    """A third of the rows without an id, a third with one id, and all texts different."""
    ids = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id"))
    return spark.range(n).select(ids.cast("long").alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"), F.lit("h").alias("source"))


def test_numbers_of_a_hot_id_come_from_many_runs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "RUN_ROWS", 100)
    docs = flood(spark)
    out = packing.pack_documents(docs).toPandas()
    assert len(out) == 4000 and not out.duplicated(["bucket", "batch", "slot"]).any()
    shards = sharding.shard_by_bytes(docs).toPandas()
    assert all(sorted(t.slot) == list(range(len(t))) for _, t in shards.groupby("shard"))
    rows = docs.withColumn("no", F.monotonically_increasing_id()).withColumn("g", F.lit(1))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    runs = rows.groupBy(F.pmod(F.xxhash64("doc_id", "no"), F.lit(40))).count().toPandas()["count"]
    assert runs.max() < 200  # what gapless() deals by
    numbered = common.gapless(rows, "g", ["doc_id", "no"], "place").toPandas()
    assert sorted(numbered.place) == list(range(4000))


def test_token_files_split_a_hot_id(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together
    try:
        parts = token_files.write_tokens(flood(spark), f"file://{tmp_path}/ids", VOCAB, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(p["docs"] for p in parts) < 0.6 * 4000
    back = token_files.read_tokens(spark, parts).toPandas().sort_values("start")
    assert len(back) == 4000 and back.start.tolist() == [0, *back.n_tokens.cumsum().tolist()[:-1]]
    keys = back.doc_id.fillna(-1).tolist()
    assert keys == sorted(keys)


def test_a_word_of_a_million_letters(spark):
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    ids = Tokenizer.from_file(VOCAB).encode(word, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, word), (2, "short"), (3, "é" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, VOCAB).collect()}
    assert got[1] == len(ids) and got[3] == len(Tokenizer.from_file(VOCAB).encode("é" * 5000, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in bpe.round_trip_digests(docs, VOCAB).collect()} == got


def test_texts_of_megabytes(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99_999)) for _ in range(700_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long.replace("a", "z")), (4, "short text")], "doc_id long, text string")
    assert [r.component_id for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1, 3, 4]


def test_lines_joined_by_parts_of_a_host(spark, monkeypatch):
    rows = [(i, f"own line {i}\nmenu home about\n\nmore {i}", "h") for i in range(200)] + [(900, "menu home about", "other"), (901, None, "h"), (902, "x\nmenu home about", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((tuple(r) for r in line_dedup.drop_lines(docs).collect()), key=str)
    monkeypatch.setattr(line_dedup, "HASHES", 0)
    assert sorted((tuple(r) for r in line_dedup.drop_lines(docs).collect()), key=str) == want


def test_hashes_of_a_long_text_in_parts(monkeypatch):
    import numpy as np

    from tallyforge.llm import bytesops

    rng = random.Random(3)
    text = "".join(rng.choice(["word", "x" * 90, " ", "\n\n", "é", "a" * 300]) for _ in range(3000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = bytesops.hashed_pieces(data, offsets, bytesops.IS_WORD)
    monkeypatch.setattr(bytesops, "CHUNK", 64)
    parts = bytesops.hashed_pieces(data, offsets, bytesops.IS_WORD)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(whole[0]) == len(text.split())


def test_word_table_is_bounded_by_bytes(monkeypatch):
    """Words of 20,000 signs, texts without blanks and many short words: what is kept stays under the bound, and is right."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from tallyforge.llm import token_files, vocab

    monkeypatch.setattr(vocab, "BYTES", 300_000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    r, tokenizer, table = random.Random(2), Tokenizer.from_file(path), token_files._table.__wrapped__(path)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    most = 0
    for _ in range(12):
        texts = [f"{word(20_000)} {word(5)} {word(20_000)}" for _ in range(10)] + [" ".join(word(6) for _ in range(300)) for _ in range(4)] + ["中文没有空格" * 3_000, ""]
        for t, found in zip(texts, table.look_up(texts), strict=True):
            assert found == b"".join(x.to_bytes(4, "little") for x in tokenizer.encode(t, add_special_tokens=False).ids)
        kept = {**table.known, **{f" {w}": x for w, x in table.first.items()}}
        assert all(len(w) <= vocab.KEEP + 1 for w in kept)
        most = max(most, sum(len(w.encode()) + len(x) for w, x in kept.items()))
    assert most < 2 * vocab.BYTES

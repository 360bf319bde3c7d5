"""Token ids in flat binary files with 64-bit document offsets, and their reader.

Documents are dealt by ranges of their id and sorted; each task writes one part of three files: .ids (all ids one after
another, unsigned little-endian, 16 bits where the vocabulary and the end id fit and else 32), .off (64-bit offsets of the
documents inside the part, one more than documents) and .key (64-bit document ids). A part is written under a name of its
own attempt and then renamed, so a repeated task replaces equal files. Prefix sums over the parts' totals give each part's
base, so base + offset is a document's place among all ids. The reader maps files of a local or mounted folder into memory
and reads others through their file system.

Null texts are empty: such a document has its end id only. Rows that repeat an id are all written, by hash of their text; many of them, and many
null ids, are split over parts. A null id
is written before all others as the least 64-bit number and read as null. An empty table gives no part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import small_batches
from tallyforge.llm.vocab import Table, vocabulary

NULL_KEY = -(1 << 63)


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    uri = uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri.removeprefix("file:")
    return (pyarrow.fs.LocalFileSystem(), uri) if uri.startswith("/") else pyarrow.fs.FileSystem.from_uri(uri)


@lru_cache(maxsize=2)
def _table(path: str) -> Table:
    """Ids by the tokenizers library, once for each word that a worker's table holds."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    vocab = vocabulary(path)
    size = np.array([len(t) for t in vocab.tokens])

    def whole(strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def find(strings: list[str]) -> list[bytes]:
        if any(x[:1] != " " for x in strings) or len(strings) < 2:
            return [x.tobytes() for x in whole(strings)]
        out = []
        for at in range(0, len(strings), 500):  # words with their blanks are a text; its ids are cut at the words' ends
            words = strings[at : at + 500]
            ids = whole(["".join(words)])[0]
            ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(w.encode()) for w in words])) + 1
            flat = ids.tobytes()
            out += [flat[4 * i : 4 * j] for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        return out

    return Table(vocab, find, b"".join)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> list[dict]:
    """Write all documents' ids to the shared folder; return the parts in order: file, docs, tokens, base, wide."""
    small_batches(docs.sparkSession)
    wide = max(vocabulary(path).size, end_id + 1) > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task, table, kind = TaskContext.get(), _table(path), "<u4" if wide else "<u2"
        fs, root = _place(folder)
        fs.create_dir(root, recursive=True)
        name, own = f"{root}/part-{task.partitionId():06d}", f".{task.taskAttemptId()}"
        end, at, docs_, total = np.array([end_id], "<u4").tobytes(), 0, 0, 0
        with fs.open_output_stream(f"{name}.ids{own}") as ids, fs.open_output_stream(f"{name}.off{own}") as off, fs.open_output_stream(f"{name}.key{own}") as keys:
            off.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                lengths = []
                for found in table.look_up([t or "" for t in batch.column(1).to_pylist()]):
                    flat = np.frombuffer(found + end, "<u4")
                    ids.write(flat.astype(kind).tobytes())
                    lengths.append(len(flat))
                off.write((total + np.cumsum(lengths)).astype("<i8").tobytes())
                keys.write(np.array([NULL_KEY if x is None else x for x in batch.column(0).to_pylist()], "<i8").tobytes())
                total, docs_ = total + sum(lengths), docs_ + len(lengths)
        for x in ("ids", "off", "key"):
            fs.move(f"{name}.{x}{own}", f"{name}.{x}")
        if docs_:
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([os.path.basename(name)]), pa.array([docs_]), pa.array([total])], names=["part", "file", "docs", "tokens"])

    order = ("key", "code", "number")  # the last ones split rows that repeat an id over parts
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("code"), F.monotonically_increasing_id().alias("number"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    parts = sorted(rows.mapInArrow(run, "part long, file string, docs long, tokens long").collect())
    bases = accumulate((p["tokens"] for p in parts), initial=0)
    return [{"file": f"{folder}/{p['file']}", "docs": p["docs"], "tokens": p["tokens"], "base": base, "wide": wide} for p, base in zip(parts, bases, strict=False)]


def _mapped(name: str, kind: str, start: int, stop: int) -> np.ndarray:
    """Numbers start to stop of a file: memory-mapped, or only that range read where the storage can't be mapped."""
    fs, path = _place(name)
    if stop <= start:
        return np.zeros(0, kind)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, kind, "r")[start:stop]
    width = np.dtype(kind).itemsize
    with fs.open_input_file(path) as f:
        f.seek(start * width)
        return np.frombuffer(f.read((stop - start) * width), kind)


def read_tokens(spark: SparkSession, parts: list[dict], key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids_crc32 of every document in the files."""

    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (row for batch in batches for row in batch.to_pylist()):
            for at in range(0, p["docs"], 1_000):
                end = min(at + 1_000, p["docs"])
                k, o = np.array(_mapped(f"{p['file']}.key", "<i8", at, end)), np.array(_mapped(f"{p['file']}.off", "<i8", at, end + 1))
                ids = _mapped(f"{p['file']}.ids", "<u4" if p["wide"] else "<u2", o[0], o[-1])
                crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(o - o[0], o[1:] - o[0], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(k, mask=k == NULL_KEY), pa.array(o[:-1] + p["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    schema = "file string, docs long, tokens long, base long, wide boolean"
    rows = spark.createDataFrame([tuple(p.values()) for p in parts], schema)
    rows = rows.repartitionByRange(max(1, len(parts)), "file")
    return rows.mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")

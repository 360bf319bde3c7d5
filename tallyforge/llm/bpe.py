"""BPE encoding and decoding with a contiguous array of part boundaries and ranks per word.

A word's parts lie side by side in one list of [start, rank of this part joined with the next]. The lowest rank is
searched for, the boundary behind it is deleted and the two ranks beside it are renewed, until no pair has a rank. Words
of more than LONG bytes take the same steps from a heap over linked parts, whose time doesn't grow with the square.

Null texts are empty. Special strings inside a text become their ids and come back as they were. Repeated rows get equal
results, ties of rank go from the left, an empty table gives an empty result, and columns other than the id and the text
aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import small_batches
from tallyforge.llm.vocab import Table, Vocabulary, vocabulary

NONE = 1 << 40
LONG = 400


def boundaries(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The starts of the word's tokens, and its end."""
    n = len(word)
    if n > LONG:
        return long_boundaries(word, ranks)
    get = ranks.get
    starts = list(range(n + 1))
    near = [get(word[i : i + 2], NONE) for i in range(n - 1)]
    while near:
        least = min(near)
        if least == NONE:
            break
        i = near.index(least)
        del starts[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[starts[i] : starts[i + 2]], NONE)
        if i:
            near[i - 1] = get(word[starts[i - 1] : starts[i + 1]], NONE)
    return starts


def long_boundaries(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """boundaries() from a heap of pairs over linked parts."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return [i for i in range(n) if alive[i]] + [n]


def encode_word(word: bytes, vocab: Vocabulary) -> bytes:
    """The word's ids as little-endian unsigned 32-bit integers."""
    at = boundaries(word, vocab.ranks)
    return np.array([vocab.ids[word[i:j]] for i, j in zip(at, at[1:], strict=False)], dtype="<u4").tobytes()


def decode(ids: bytes, vocab: Vocabulary) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(vocab.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _table(path: str) -> Table:
    vocab = vocabulary(path)

    def find(strings: list[str]) -> list[bytes]:
        parts = [vocab.parts(x) for x in strings]
        ids = {w: encode_word(w.encode(), vocab) if isinstance(w, str) else np.array([w], "<u4").tobytes() for w in set(chain.from_iterable(parts))}
        return [b"".join(map(ids.__getitem__, p)) for p in parts]

    return Table(vocab, find, b"".join)


def encode(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    return _table(path).look_up(texts)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (binary, unsigned 32-bit little-endian) and the text decoded from them, for every text."""
    return _mapped(docs, path, key, text, {"ids": "binary", "decoded": "string"}, lambda ids, back: (ids, back))


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """round_trip(), reduced in place to key, n_tokens, ids_sha256 and decoded_sha256."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(docs, path, key, text, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, lambda ids, back: (len(ids) // 4, sha(ids), sha(back.encode())))


def _mapped(docs: DataFrame, path: str, key: str, text: str, columns: dict[str, str], row) -> DataFrame:
    small_batches(docs.sparkSession)
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = [row(ids, decode(ids, vocab)) for ids in encode([t or "" for t in batch.column(1).to_pylist()], path)]
            cells = zip(*rows, strict=True) if rows else [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kinds[k]) for x, k in zip(cells, columns.values(), strict=True))], names=[key, *columns])

    rest = ", ".join(f"{k} {v}" for k, v in columns.items())
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {rest}")

"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie one after another in one array of symbols. Each step finds the lowest-ranked neighbouring
pair of every sequence and joins it in all sequences at once, at all its places from the left that don't overlap; only
the ranks beside a new symbol are looked up again. Sequences without a pair leave with their number of symbols.

Null texts are empty and have no token. Special strings inside a text count one token each, as the tokenizer file's
library does by default. Repeated rows get equal counts. An empty table gives an empty result; columns other than the id
and the text aren't read. A pre-token of more than LONG bytes would hold up its whole batch for as many steps as it has
ranks; its pairs are merged in the same order from a heap instead, whose time grows with the length alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import long_boundaries
from tallyforge.llm.common import small_batches
from tallyforge.llm.vocab import Table, vocabulary

NONE = np.int64(1) << 40
LONG = 4_096


class Merger:
    def __init__(self, path: str):
        vocab = vocabulary(path)
        keys = np.array([(a << 20) | b for a, b, _ in vocab.merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.result = np.array([c for _, _, c in vocab.merges], dtype=np.int64)
        self.byte_ids = np.array([vocab.ids.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that survive of each word."""
        out = np.zeros(len(words), np.int64)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        if not len(symbols):
            return out
        rank = np.full(len(symbols), NONE)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(owner)])
            least = np.minimum.reduceat(rank, first)
            done = least == NONE
            if done.any():
                out[owner[first[done]]] = size[done]
                stay = np.repeat(~done, size)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                least, size = least[~done], size[~done]
                if not len(symbols):
                    break
            hit = rank == np.repeat(least, size)
            at = np.flatnonzero(hit)
            new_run = np.r_[True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])]
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbols[at] = self.result[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # places once the right halves are gone
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[again] = NONE
            again = again[again + 1 < len(symbols)]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self.ranks(symbols[again], symbols[again + 1])
        return out


@lru_cache(maxsize=2)
def _table(path: str) -> Table:
    vocab, merger = vocabulary(path), Merger(path)

    def find(strings: list[str]) -> list[int]:
        parts = [vocab.parts(x) for x in strings]
        words = [w for w in set(chain.from_iterable(parts)) if isinstance(w, str)]
        raw = {w: w.encode() for w in words}
        short = [w for w in words if len(raw[w]) <= LONG]
        n = dict(zip(short, merger.counts([raw[w] for w in short]).tolist(), strict=True))
        n.update((w, len(long_boundaries(raw[w], vocab.ranks)) - 1) for w in words if w not in n)
        return [sum(n.get(w, 1) for w in p) for p in parts]  # a special string is one token

    return Table(vocab, find, sum)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and n_tokens of every text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = list(_table(path).look_up(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key), F.col(text))
    return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")

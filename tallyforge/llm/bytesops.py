"""Array kernels over the bytes of a batch of texts: words, their hashes and n-gram hashes, without a loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that a kernel takes at once; a longer text is taken alone.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15  # an odd number with mixed bits
#: Bytes up to which a piece is hashed together with others.
LONG_PIECE = 64
#: Masks that keep the first n bytes of a block of eight.
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)

#: Blank and the controls 9 to 13 separate words.
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
IS_WORD = (~IS_SPACE).astype(np.uint8)
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offsets of its texts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pieces(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes of one non-zero kind."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    k = kind[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(k[1:], k[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    real = k[at[:-1]] != 0
    starts, ends = at[:-1][real], at[1:][real]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces: their blocks of eight bytes are mixed in one after another, in all pieces at once; pieces
    of more than LONG_PIECE bytes are digested by themselves."""
    size = ends - starts
    blocks = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(mix(size.astype(U64) + U64(_BASE)) ^ (blocks[starts] & _FIRST_BYTES[np.minimum(size, 8)]))
    some = np.flatnonzero((size > 8) & (size <= LONG_PIECE))
    at, rest = starts[some] + 8, size[some] - 8
    while len(some):
        out[some] = mix(out[some] ^ (blocks[at] & _FIRST_BYTES[np.minimum(rest, 8)]))
        on = rest > 8
        some, at, rest = some[on], at[on] + 8, rest[on] - 8
    for k in np.flatnonzero(size > LONG_PIECE).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def hashed_pieces(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of the pieces of texts. A single long text goes in parts of about CHUNK bytes that end where
    a separator is, so that only its hashes are held whole."""
    if len(offsets) != 2 or len(data) <= 2 * CHUNK:
        starts, ends, owner = pieces(data, offsets, kind)
        return piece_hashes(data, starts, ends), owner
    found, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and kind[data[end]]:
            gap = np.flatnonzero(kind[data[end : end + CHUNK]] == 0)
            end += int(gap[0]) if len(gap) else min(CHUNK, len(data) - end)
        starts, ends, _ = pieces(data[at:end], np.array([0, end - at]), kind)
        found.append(piece_hashes(data[at:end], starts, ends))
        at = end
    out = np.concatenate(found)
    return out, np.zeros(len(out), np.int64)


def counts_by_text(owner: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(owner, minlength=texts)


def windows(hashes: np.ndarray, owner: np.ndarray, texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words and their text numbers. A text of fewer words, but one at least, has one
    window: all of its words."""
    n = len(hashes)
    words = counts_by_text(owner, texts)
    factors = [U64(pow(_BASE, k + 2, 1 << 64)) for k in range(size)]
    if n >= size:
        full = owner[: n - size + 1] == owner[size - 1 :]
        total = hashes[: n - size + 1] * factors[0]
        for k in range(1, size):
            total = total + hashes[k : n - size + 1 + k] * factors[k]
        got, who = mix(total)[full], owner[: n - size + 1][full]
    else:
        got, who = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = np.zeros(len(short), U64)
        for k in range(size - 1):
            has = words[short] > k
            extra[has] = extra[has] + hashes[first[has] + k] * factors[k]
        got = np.concatenate([got, mix(extra + words[short].astype(U64))])
        who = np.concatenate([who, short])
        order = np.argsort(who, kind="stable")
        got, who = got[order], who[order]
    return got, who


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes, A-Z lower-cased; none without words."""
    data, offsets = texts_of(column)
    for i, j in chunks(offsets):
        part, offs = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        got, who = windows(*hashed_pieces(part, offs, IS_WORD), j - i, size)
        ends_of = np.searchsorted(who, np.arange(j - i + 1))
        for k in range(j - i):
            yield np.unique(got[ends_of[k] : ends_of[k + 1]])

"""Media columns: interleaved sequences of text and media references out of HTML, resolved by digest joins.

parse() turns HTML into one ordered array per row: each item has its position, its kind (text or media), its text, its
media url, the digest that a url of the form media:<digest> names, and its caption (a figure's caption, else the alternative
text). store() turns payloads into grayscale PNG rows with 8-bit samples, one per row, keyed by the payload's SHA-256;
look_at() reads stored bytes back and computes features. resolve() joins the references to any table by digest and keeps
the position, so text and media stay aligned. Only digests and features are shuffled; media bytes stay where they were
written.

Null and empty HTML give an empty array; a reference without a stored payload, or to an outside address, stays, with nulls.
A null payload is an empty one. Equal payloads have equal rows, and repeated rows stay repeated. An empty table gives an
empty result. What these operators add is one struct or array column; if the table has a column of its name, it gets an
underscore more, so no column is lost or mixed up. A text of any length is one payload of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import Scratch, fresh, small_batches

#: Samples of a row of a stored image.
WIDTH = 576
PAD = b"\xff"
SCHEME = "media:"
#: Fixed value: the first bytes of a PNG file.
PNG = b"\x89PNG\r\n\x1a\n"
_TEXTS = ("kind", "text", "url", "digest", "caption")
ITEMS = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), *(T.StructField(x, T.StringType()) for x in _TEXTS)]))
_ITEM = pa.struct([("position", pa.int32()), *((x, pa.string()) for x in _TEXTS)])
STORED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("media", T.BinaryType())])


def _url(attributes: dict) -> str | None:
    """Where an element's media are: its source, a lazy one, the first of a set, or a poster."""
    several = (attributes.get("srcset") or "").strip().split()
    return attributes.get("src") or attributes.get("data-src") or (several[0].rstrip(",") if several else None) or attributes.get("poster")


class Sequence(HTMLParser):
    """The ordered items of a page. Scripts, styles and comments aren't content; runs of white space are one blank."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.hidden, self.caption, self.open = [], [], 0, None, []

    def add(self, kind, **cells):
        self.items.append({"position": len(self.items), "kind": kind, **{x: cells.get(x) for x in _TEXTS[1:]}})

    def flush(self):
        if text := " ".join("".join(self.words).split()):
            self.add("text", text=text)
        self.words = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self.flush()
            self.open = [len(self.items)]
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source") and (url := _url(a)):
            self.flush()
            self.add("media", url=url, digest=url[len(SCHEME) :] if url.startswith(SCHEME) else None, caption=a.get("alt"))
        elif tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "ul", "ol"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.items[self.open[0] :] if self.open else []:
                item["caption"] = text if item["kind"] == "media" else item["caption"]
            self.caption = None
        elif tag == "figure":
            self.flush()
            self.open = []
        elif tag in ("p", "div", "li", "tr", "article", "section"):
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    page = Sequence()
    page.feed(html or "")
    page.close()
    page.flush()
    return page.items


def parse(pages: DataFrame, html: str, name: str = "items") -> DataFrame:
    """pages with the items of each row's HTML, as the last column, in place of the HTML."""
    small_batches(pages.sparkSession)
    at = pages.columns.index(html)
    rest = [f for k, f in enumerate(pages.schema.fields) if k != at]
    name = fresh(pages.drop(html), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sequence_of(x) for x in batch.column(at).to_pylist()], pa.list_(_ITEM))
            yield pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at] + [found], names=[*(f.name for f in rest), name])

    return pages.mapInArrow(run, T.StructType([*rest, T.StructField(name, ITEMS)]))


def references(pages: DataFrame, items: str | None = None) -> DataFrame:
    """One row for each media reference: the page's other columns, and last, in place of the column `items` (the last one, as
    parse() leaves it), the item itself: position, url, digest, caption."""
    items = items or pages.columns[-1]
    media = F.explode(F.filter(items, lambda x: x["kind"] == "media")).alias(items)
    return pages.select(*(c for c in pages.columns if c != items), media)


def resolve(refs: DataFrame, found: DataFrame, item: str | None = None, name: str = "payload") -> DataFrame:
    """The references with, as a struct in the last column, what `found` has for their digest; null where it has none.
    `found` has each digest once and is a written table, so that both sides are dealt by digest and a digest that many
    pages share is split. The item is the last column, as references() leaves it, or the one given."""
    item = item or refs.columns[-1]
    name, key = fresh(refs, name), fresh(refs, "tf_digest")
    side = found.select(F.col("digest").alias(key), F.struct(*(c for c in found.columns if c != "digest")).alias(name))
    return refs.join(side, F.col(item)["digest"] == F.col(key), "left").select(*refs.columns, name)


def padded(raw: bytes) -> bytes:
    """raw, filled up to a positive multiple of WIDTH."""
    return raw + PAD * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(stored: bytes) -> np.ndarray:
    """The samples of a PNG written by to_png()."""
    if stored[:8] != PNG:
        raise ValueError("not a PNG file")
    at, body, size = 8, [], (0, 0)
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        data = stored[at + 8 : at + 8 + n]
        if struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", data[:8])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Size, mean, deviation, and which of 8 by 8 tiles are brighter than the mean of the tiles."""
    flat = samples.reshape(-1).astype(np.float64)
    tiles = np.add.reduceat(flat, np.arange(64) * len(flat) // 64) / np.diff(np.r_[np.arange(64) * len(flat) // 64, len(flat)])
    bits = int("".join("01"[int(x)] for x in tiles > tiles.mean()), 2)
    return f"gray8:{samples.shape[1]}x{samples.shape[0]}:mean={flat.mean():.3f}:std={flat.std():.3f}:tiles={bits:016x}"


def payload_digest(text: Column) -> Column:
    """The SHA-256 of a text's payload, as store() has it."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.greatest(F.ceil(F.length(raw) / WIDTH), F.lit(1)) * WIDTH
    fill = F.call_function("repeat", F.lit(PAD.hex()), (size - F.length(raw)).cast("int"))
    return F.sha2(F.concat(raw, F.unhex(fill)), 256)


def page_of(text: Column, caption: Column) -> Column:
    """A text as HTML: a paragraph per line, and in their middle a figure whose source is the text's stored payload."""
    whole = F.coalesce(text, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        whole = F.replace(whole, F.lit(sign), F.lit(name))
    lines = F.split(whole, "\n")
    half = F.ceil(F.size(lines) / 2).cast("int")
    part = lambda start, n: F.concat(F.lit("<p>"), F.array_join(F.slice(lines, start, n), "</p><p>"), F.lit("</p>"))
    figure = F.concat(F.lit("<figure><img src='"), F.lit(SCHEME), payload_digest(text), F.lit("' alt='text'><figcaption>"), caption, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), part(F.lit(1), half), figure, part(half + 1, F.size(lines) - half), F.lit("</article>"))


def store(room: Scratch, rows: DataFrame, text: str = "text", name: str = "stored") -> DataFrame:
    """A written table of all other columns of rows and, last, a struct: n_bytes of the UTF-8 text, digest of its payload
    and media."""
    small_batches(rows.sparkSession)
    at = rows.columns.index(text)
    rest = [f for k, f in enumerate(rows.schema.fields) if k != at]
    name = fresh(rows.drop(text), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, media = [], [], []
            for t in batch.column(at):
                raw = (t.as_py() or "").encode()
                payload = padded(raw)
                n.append(len(raw))
                digest.append(hashlib.sha256(payload).hexdigest())
                media.append(to_png(payload))
            made = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(media, pa.binary())], names=STORED.names)
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), made], names=[*(f.name for f in rest), name])

    return room.keep(rows.mapInArrow(run, T.StructType([*rest, T.StructField(name, STORED)])))


def look_at(stored: DataFrame, name: str | None = None) -> DataFrame:
    """Each digest of a stored table once, with what is read back: n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature. `name` is store()'s column, by default the last."""
    name = name or stored.columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                media = x.as_py()
                samples = from_png(media)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cells = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], names=["digest", "n_bytes", *names])

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    small_batches(stored.sparkSession)
    rows = stored.select(*(F.col(name)[c].alias(c) for c in ("digest", "n_bytes", "media"))).mapInArrow(run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return rows.groupBy("digest").agg(*(F.min(c).alias(c) for c in ("n_bytes", *names)))

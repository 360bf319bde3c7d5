"""MinHash near-dedup with sequential Bayesian verification.

1. One pass makes each text's shingle set, its fingerprint and a signature of BANDS * ROWS minima. Texts of equal sets
   become one class with a number of its own, so copies cost nothing further.
2. Signatures are cut into bands; classes that agree in a band share a bucket. At similarity 0.8 all bands are missed
   with a chance of (1 - 0.8**ROWS)**BANDS, below 1e-7.
3. Rounds contract dense groups. A bucket's hub is its class with the most bucket mates over all bands, that is the one
   nearest to the middle of a group. Each class meets the hub it shares most buckets with; links join components, and the
   next round does the same among the classes outside their bucket's largest component.
4. What is still open is searched completely: in each bucket every class outside the largest component meets every other
   class. Those classes are put into blocks by their most central hub; the other side is sent to a block once, however many buckets they
   share, and streams past it. So, up to a block's size, rows grow with the
   classes; a bucket of n unlinked classes beyond it makes n * (n / BLOCK) rows. Comparisons are (classes left over) * (bucket).

Wherever two classes meet, signature batches are compared in turn and the pair is pruned as soon as the posterior chance
that its similarity reaches the threshold falls below MISS. Survivors of different components are verified on full sets
and then on the shingles themselves. No partner or candidate is capped, no group of classes is held whole by a task.

A null or empty text, or one without words, has an empty set: it is linked with nothing and kept. A class's least id that
isn't null stands for it; rows with a null id get their class's component, and are kept only if no row of it has an id.
Rows that repeat an id each get the result of their own text. An empty table gives an empty result, ties and columns of
any other name change nothing, and very long texts are cut into shingles whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bytesops import LOWER, shingle_sets
from tallyforge.llm.common import Scratch, fresh, join_ids, scratch, small_batches
from tallyforge.llm.graph import components

ROWS, BANDS, BATCH = 4, 32, 32
MISS = 1e-6
#: Rounds of hubs before the complete search, which is exact whatever they leave.
ROUNDS = 2
#: Classes, and shingles in all, of a block; and classes that stream past a copy of a block, at least.
BLOCK, BLOCK_SHINGLES, STREAM = 4096, 1 << 21, 256
#: Pairs whose minima are compared at once, and shingle matches counted at once.
AT_ONCE, MATCHES = 1 << 16, 1 << 22
HASHES = ROWS * BANDS
_random = np.random.Generator(np.random.PCG64(20240601))
_MULTIPLY = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_NO_ID = -(1 << 63)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of HASHES linear hashes over a set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF), np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(out, (low[at : at + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=out)
    return out


def least_matches(percent: int) -> dict[int, int]:
    """For each number of compared minima the matches below which the posterior (uniform prior) that the similarity is
    at least percent / 100 is under MISS: P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    t, out = percent / 100, {}
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < MISS:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def survivors(x: np.ndarray, y: np.ndarray, allowed: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of rows of two signature matrices that are allowed, those that outlast all batches: the two row
    numbers and the matches."""
    least = least_matches(percent)
    first = np.zeros(allowed.shape, np.uint8)
    for k in range(BATCH):
        first += x[:, k, None] == y[None, :, k]
    i, j = np.nonzero(allowed & (first >= least[BATCH]))
    matches = first[i, j].astype(np.int64)
    for n in range(2 * BATCH, HASHES + 1, BATCH):
        matches += (x[i, n - BATCH : n] == y[j, n - BATCH : n]).sum(axis=1)
        stay = matches >= least[n]
        i, j, matches = i[stay], j[stay], matches[stay]
    return i, j, matches


class Index:
    """The shingles of a block of sets, each with the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.n)[order]
        self.shingles, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))

    def common(self, sets: list[np.ndarray]) -> np.ndarray:
        """The sizes of the intersections of the block's sets with others, in parts of about MATCHES matches at most."""
        out, step = [], max(1, MATCHES // max(1, len(self.owner)))
        for at in range(0, len(sets), step):
            part = sets[at : at + step]
            flat, who = np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part])
            place = np.minimum(np.searchsorted(self.shingles, flat), len(self.shingles) - 1)
            hit = self.shingles[place] == flat
            place, who = place[hit], who[hit]
            many = self.first[place + 1] - self.first[place]
            before = np.cumsum(many) - many
            entry = np.arange(many.sum()) - np.repeat(before - self.first[place], many)
            pair = self.owner[entry] * len(part) + np.repeat(who, many)
            out.append(np.bincount(pair, minlength=len(self.n) * len(part)).reshape(len(self.n), len(part)))
        return np.concatenate(out, axis=1)


def _shingles(text: str, size: int) -> set[tuple[bytes, ...]]:
    words = text.encode().translate(bytes(LOWER)).split()  # bytes.split() cuts at the blank and the controls 9 to 13
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def truly_linked(a: str, b: str, size: int, percent: int) -> bool:
    """100 * intersection >= percent * union, on the shingles themselves, without any hash."""
    x, y = _shingles(a, size), _shingles(b, size)
    common = len(x & y)
    return bool(common) and 100 * common >= percent * (len(x) + len(y) - common)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, minima = [], [], []
            for s in shingle_sets(batch.column("text"), size):
                n.append(len(s))
                prints.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
                minima.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("code"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(minima, pa.binary())], names=["id", "code", "n", "print", "minima"])

    return run


class _Meeting:
    """The links between a block of classes, which is held, and the classes that stream past it."""

    def __init__(self, size: int, percent: int, ordered: bool):
        self.size, self.percent, self.ordered = size, percent, ordered
        self.parts, self.minima, self.index, self.above = [], None, None, {}

    def top(self, root: int) -> int:
        while (up := self.above.get(root, root)) != root:
            self.above[root] = root = self.above.get(up, up)
        return root

    def hold(self, rows: pa.Table) -> None:
        self.parts.append(rows)

    def pass_by(self, rows: pa.Table) -> list[tuple[int, int]]:
        if self.minima is None:
            held = pa.concat_tables(self.parts)
            self.minima = _matrix(held.column("minima"))
            self.root, self.rank, self.n = (held.column(c).to_numpy() for c in ("root", "rank", "n"))
            self.texts, self.reps = held.column("text").combine_chunks(), held.column("rep").to_pylist()
        minima, (root, rank, n) = _matrix(rows.column("minima")), (rows.column(c).to_numpy() for c in ("root", "rank", "n"))
        out, step = [], max(1, AT_ONCE // len(self.reps))
        for at in range(0, rows.num_rows, step):
            part = slice(at, at + step)
            allowed = (self.root[:, None] != root[None, part]) & (100 * np.minimum(self.n[:, None], n[None, part]) >= self.percent * np.maximum(self.n[:, None], n[None, part]))
            if self.ordered:
                allowed &= (self.rank[:, None] < rank[None, part]) | ((self.rank[:, None] == rank[None, part]) & (self.root[:, None] < root[None, part]))
            i, j, matches = survivors(self.minima, minima[part], allowed, self.percent)
            if len(i):
                out += self.verified(rows, i, j + at, matches)
        return out

    def verified(self, rows: pa.Table, i: np.ndarray, j: np.ndarray, matches: np.ndarray) -> list[tuple[int, int]]:
        """Of the pairs linked on full sets, the likeliest first, those that join two components."""
        if self.index is None:
            self.index = Index(list(shingle_sets(self.texts, self.size)))
        need, of = np.unique(j, return_inverse=True)
        texts = rows.column("text").take(pa.array(need)).combine_chunks()
        sets = list(shingle_sets(texts, self.size))
        common = self.index.common(sets)[i, of]
        union = self.index.n[i] + np.array([len(x) for x in sets])[of] - common
        at = np.flatnonzero(100 * common >= self.percent * union)
        reps, roots, out = rows.column("rep"), rows.column("root"), []
        for k in at[np.argsort(-matches[at], kind="stable")].tolist():
            a, b = int(i[k]), int(j[k])
            x, y = self.top(int(self.root[a])), self.top(roots[b].as_py())
            if x != y and truly_linked(self.texts[a].as_py(), texts[int(of[k])].as_py(), self.size, self.percent):
                self.above[max(x, y)] = min(x, y)
                out.append((self.reps[a], reps[b].as_py()))
        return out


def _meet(size: int, percent: int, ordered: bool):
    """Of rows sorted by block, copy and side: the links between the block's sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, meeting = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).combine_chunks()
            block, copy, side = (t.column(c).to_numpy() for c in ("block", "copy", "side"))
            edges = np.flatnonzero((block[1:] != block[:-1]) | (copy[1:] != copy[:-1]) | (side[1:] != side[:-1])) + 1
            found = []
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), t.num_rows], strict=True):
                if (block[i], copy[i]) != now:
                    now, meeting = (block[i], copy[i]), _Meeting(size, percent, ordered)
                if side[i] == 0:
                    meeting.hold(t.slice(i, j - i))
                else:
                    found += meeting.pass_by(t.slice(i, j - i))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _search(room: Scratch, held: DataFrame, passing: DataFrame, detail: DataFrame, roots: DataFrame | None, size: int, percent: int, ordered: bool) -> DataFrame:
    """The links (a, b) between the classes `held` by a block and those `passing` it; both are (block, rep)."""
    held, passing = room.keep(held), room.keep(passing)
    passing_by = passing.groupBy("block").agg(F.count("*").alias("many"))
    copies = held.groupBy("block").agg(F.count("*").alias("few")).join(passing_by, "block").select("block", F.ceil(F.col("many") / F.greatest(F.lit(STREAM), "few")).cast("int").alias("copies"))
    left = held.join(copies, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("side"), "rep")
    right = passing.join(copies, "block").select("block", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("side"), "rep")
    known = join_ids(detail, held.select("rep").unionByName(passing.select("rep")).distinct(), "rep", "left_semi")
    if roots is None:
        known = known.withColumn("root", F.col("rep")).withColumn("rank", F.lit(1).cast("long"))
    else:
        known = known.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")).withColumn("rank", F.coalesce("rank", F.lit(1).cast("long")))
    rows = left.unionByName(right).join(known, "rep").select("block", "copy", "side", "rep", "root", "rank", "n", "minima", "text")
    rows = rows.repartition("block", "copy").sortWithinPartitions("block", "copy", "side")
    return room.keep(rows.mapInArrow(_meet(size, percent, ordered), "a long, b long"))


def _contract(room: Scratch, roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """id, root and rank (classes of the root) of every class in a link so far."""
    if roots is not None:
        of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        links = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = components(room, links)
    if roots is not None:
        merged = roots.select("id", "root").join(tops.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
        tops = room.keep(merged.unionByName(tops.join(roots.select("id"), "id", "left_anti").select("id", "root")))
    return room.keep(tops.join(tops.groupBy("root").agg(F.count("*").alias("rank")), "root").select("id", "root", "rank"))


def _open(room: Scratch, shared: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of shared buckets that still hold several components, and of these the rows outside a bucket's largest."""
    marked = shared.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")).withColumn("rank", F.coalesce("rank", F.lit(1).cast("long")))
    marked = room.keep(marked)
    tops = marked.groupBy("bucket").agg(F.max(F.struct("rank", "root")).alias("most"), F.min("root").alias("x"), F.max("root").alias("y"))
    still = room.keep(marked.join(tops.where("x != y").select("bucket", F.col("most.root").alias("largest")), "bucket"))
    return still.select(shared.columns), still.where("root != largest").select(shared.columns)


def _by_hub(pool: DataFrame) -> DataFrame:
    """Each rep with every hub of its buckets: the hub's bucket mates, and the buckets shared. A hub may be its own."""
    hubs = pool.groupBy("bucket").agg(F.max(F.struct("mates", F.xxhash64("rep"), "rep")).alias("h")).select("bucket", F.col("h.rep").alias("hub"), F.col("h.mates").alias("hub_mates"))
    return pool.join(hubs, "bucket").groupBy("rep", "hub", "hub_mates").agg(F.count("*").alias("shares"))


def _classes(room: Scratch, source: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The table of rows (id, code of the text, n, rep) and, for every class in a link, rep and root."""
    rows = room.keep(source.select("id", "code", "text").mapInArrow(_sketch(size), "id long, code long, n long, print binary, minima binary"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "code")
    classes = rows.where("n > 0").groupBy("print").agg(F.min_by(F.struct("id", "code", "n", "minima"), first).alias("m"))
    classes = room.keep(classes.select(F.monotonically_increasing_id().alias("rep"), "print", "m.*"))  # written, so the numbers stay
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr(F.col("minima"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    bands = classes.select("rep", F.explode(band).alias("bucket"))
    buckets = room.keep(bands.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"))
    shared = room.keep(bands.join(buckets, "bucket"))
    mates = shared.groupBy("rep").agg(F.sum("c").alias("mates"))
    shared = room.keep(shared.select("rep", "bucket").join(mates, "rep"))

    meeting = classes.join(mates.select("rep"), "rep", "left_semi").select("rep", F.coalesce("id", F.lit(_NO_ID)).alias("key"), "code", "n", "minima")
    wanted = room.keep(meeting)
    texts = join_ids(source.select(F.coalesce("id", F.lit(_NO_ID)).alias("key"), "code", "text"), wanted.select("key", "code"), ["key", "code"], "left_semi").dropDuplicates(["key", "code"])
    detail = room.keep(texts.join(wanted, ["key", "code"]).select("rep", "n", "minima", "text"))

    roots, still, rest = None, shared, shared
    for k in range(ROUNDS):
        shares = _by_hub(rest if k else still).where("rep != hub")
        best = shares.groupBy("rep").agg(F.max_by("hub", F.struct("shares", "hub")).alias("block"))
        links = _search(room, best.select("block", F.col("block").alias("rep")).distinct(), best.select("block", "rep"), detail, roots, size, percent, False)
        if links.isEmpty():
            break
        roots = _contract(room, roots, links)
        still, rest = _open(room, shared, roots)
    home = room.keep(_by_hub(still).groupBy("rep").agg(F.max_by("hub", F.struct("hub_mates", "hub")).alias("home")))
    for _ in range(2):  # hubs of one dense group share its most central hub, so that the group's classes share blocks
        up = home.select(F.col("rep").alias("home"), F.col("home").alias("above"))
        home = home.join(up, "home", "left").select("rep", F.coalesce("above", "home").alias("home"))
    home = room.keep(home.join(rest.select("rep").distinct(), "rep", "left_semi").join(wanted.select("rep", "n"), "rep"))
    parts = home.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    held = room.keep(home.join(parts, "home").select("rep", F.xxhash64("home", F.pmod(F.xxhash64("rep", F.lit("part")), F.col("parts"))).alias("block")))
    blocks = room.keep(rest.join(held, "rep").select("bucket", "block").distinct())
    passing = still.join(blocks, "bucket").select("block", "rep").distinct()
    links = _search(room, held.select("block", "rep"), passing, detail, roots, size, percent, True)
    roots = _contract(room, roots, links)
    return rows.join(classes.select("print", "rep"), "print", "left").select("id", "code", "n", "rep"), roots.select(F.col("id").alias("rep"), "root")


def _components(room: Scratch, source: DataFrame, size: int, percent: int) -> DataFrame:
    """id, code, n, component (a number, null for an empty set) and component_id of every row."""
    rows, roots = _classes(room, source, size, percent)
    rows = room.keep(rows.join(roots, "rep", "left").select("id", "code", "n", F.coalesce("root", "rep").alias("component")))
    ids = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id"))
    return rows.join(room.keep(ids), "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")))


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("code"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the least id that links reach), kept (whether it is the row's own id)."""
    with scratch(docs.sparkSession) as room:
        out = _components(room, _source(docs, key, text), size, percent)
        return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")).checkpoint()


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that of the least id (a null id comes last; of equal ids the least hash of
    the text). Of rows that agree in id and text any one stays. Texts without words all stay."""
    source = _source(docs, key, text)
    no, code = fresh(docs, "tf_no_id"), fresh(docs, "tf_code")
    with scratch(docs.sparkSession) as room:
        rows = room.keep(_components(room, source, size, percent).where("component IS NOT NULL").groupBy("component", "id", "code").agg(F.count("*").alias("times")))
        order = F.struct(F.col("id").isNull().alias("none"), "id", "code")
        first = room.keep(rows.groupBy("component").agg(F.min(order).alias("first")))
        marked = rows.join(first, "component").select(F.coalesce("id", F.lit(_NO_ID)).alias(no), F.col("code").alias(code), "times", (order == F.col("first")).alias("stays"))
        marked = room.keep(marked.where("NOT stays OR times > 1"))
        gone, again = (marked.where(c).select(no, code).checkpoint() for c in ("NOT stays", "stays"))
    names = docs.columns
    left = docs.withColumn(no, F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID))).withColumn(code, F.xxhash64(F.col(text)))
    left = join_ids(left, gone, [no, code], "left_anti")
    if not again.isEmpty():
        left = join_ids(left, again, [no, code], "left_anti").unionByName(join_ids(left, again, [no, code], "left_semi").dropDuplicates([no, code]))
    return left.select(names)

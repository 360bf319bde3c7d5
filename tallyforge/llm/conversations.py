"""Repair of conversations: cheapest edits that make a conversation's roles follow the grammar (s?(ua)+)?.

The grammar has four states: nothing yet, behind the system turn, behind a user turn, behind an assistant turn. A forward
Viterbi pass goes through a conversation's rows in order. Each state carries the least (cost, audit string) that leads to it;
a row's layer has Keep, Rerole and Delete, and insert transitions close it, at most as many as the longest way between
states. Equal costs are decided by the audit string: of two strings for the same rows and of equal cost neither begins with the
other, so comparing what is there so far decides as the whole strings would. An audit string says all: the roles follow from it.

The rows of a conversation go to one task in their order and stream through it: a state is a cost, an audit string and a running
hash of the repaired lines, so a task never holds a conversation's texts, whatever its length; of long audit strings a state carries
the last part and its rank among the four. (A hash of all lines in order is sequential: no split of a conversation would spare its task the pass.) Repeats
are found by a window over (conversation, role, text) that needs no shuffle of its own.

Rows are taken by turn, null turns first; rows of one turn by role and then text. Null roles and texts are one blank. Rows
with a null conversation are a conversation. Repeated rows are duplicates. A role is judged by its first sign; an empty one has
none and can't be kept. Texts may have any length. A conversation without rows has zeros, an empty audit and the hash of nothing. An empty
table has no conversations. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import small_batches

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The four states are called by the role they are behind: nothing, "s", "u" and "a". A conversation may end in two of them.
FINAL = ("", "a")
#: The states from which a turn of a role may follow.
BEFORE = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}
ROLE = {"u": "user", "a": "assistant"}
#: Insert transitions in a row that may be worth while: behind nothing, a user and an assistant turn.
CLOSING = 2
#: Signs of an audit string from which on a rank among the states' strings stands for them.
TAIL = 256
#: White space at a text's end.
SIGNS = " \t\n\v\f\r"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Initials of neighbours that are in order.
LEGAL = ("su", "ua", "au")


def damage(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of a table, damaged by a checksum of conversation and turn: conv, turn, role, text. Of 20 rests 0 drops a row,
    1 empties its text, 2 removes sentence ends, 3 repeats it, and 4 sets its role to user. Nulls count as one blank."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(key), F.lit(":"), part(turn))) % 20
    rows = turns.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), part(role).alias("role"), part(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    kept = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role_ = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role_.alias("role"), kept.alias("text"), copies.alias("copy")).drop("copy")


class Walk:
    """A conversation on its way: its counts so far, and the layer behind its last row. A state's way there is its cost, rank and
    tail (its audit string), the running hash of its lines, and what its string was before its tail."""

    def __init__(self):
        self.layer = {"": (0, 0, "", hashlib.sha256(), None)}
        self.close()
        self.counts, self.first, self.last, self.turns, self.before = dict.fromkeys(_COUNTS, 0), None, None, 0, None

    @staticmethod
    def best(ways: list[tuple]) -> tuple:
        return min(ways, key=lambda way: way[:3])

    def step(self, state: str, cost: int, edit: str, line: str | None = None) -> tuple:
        """A state's way, going on with an edit that leaves a line or, if deleted, none."""
        before, rank, tail, hashed, rest = self.layer[state]
        if line is not None:
            hashed = hashed.copy()
            hashed.update((line if state == "" else "\n" + line).encode())
        return (before + cost, rank, tail + edit, hashed, rest)

    def close(self) -> None:
        """Insert transitions, until none can be better."""
        for _ in range(CLOSING):
            for r, s in [(r, s) for r in ROLE for s in BEFORE[r] if s in self.layer]:
                cost, rank, tail = self.layer[s][:3]
                if r not in self.layer or (cost + INSERT, rank, tail + "I") < self.layer[r][:3]:
                    self.layer[r] = self.step(s, INSERT, "I", ROLE[r] + ":")

    def row(self, turn, role: str, text: str, repeat: bool) -> None:
        """The layer behind one more row."""
        end, initial = text.rstrip(SIGNS)[-1:], role[:1]
        fault = "blank" if not end else "duplicate" if repeat else "truncated" if end not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = self.first if self.turns else turn, turn, self.turns + 1
        self.counts["illegal"] += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        ways = {s: [(s, DELETE, "D")] for s in self.layer}
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED * (fault == "truncated")
            edits = [(initial, more, "K")] * (initial in BEFORE) + [(r, REROLE + more, "R") for r in ROLE if r != initial]
            for r, cost, edit in edits:
                ways.setdefault(r, []).extend((s, cost, edit) for s in BEFORE[r] if s in self.layer)
        layer = {}
        for r, found in ways.items():
            if found:
                s, cost, edit = min(found, key=lambda w: (self.layer[w[0]][0] + w[1], self.layer[w[0]][1], self.layer[w[0]][2] + w[2]))
                layer[r] = self.step(s, cost, edit, None if edit == "D" else f"{role if edit == 'K' else ROLE[r]}:{text}")
        self.layer = layer
        self.close()
        if len(self.layer[""][2]) >= TAIL:
            self.shorten()

    def shorten(self) -> None:
        """Ranks in place of long strings, up to their last row's edit: strings of as many rows that differ, differ there."""
        heads = {s: (way[1], way[2].rstrip("I")) for s, way in self.layer.items()}
        ranks = {h: k for k, h in enumerate(sorted(set(heads.values())))}
        self.layer = {s: (way[0], ranks[heads[s]], way[2][len(heads[s][1]) :], way[3], (way[4], heads[s][1])) for s, way in self.layer.items()}

    def end(self) -> dict:
        cost, _, audit, hashed, rest = self.best([self.layer[s] for s in FINAL if s in self.layer])
        parts = [audit]
        while rest:
            rest, part = rest
            parts.append(part)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return {**self.counts, "gaps": gaps, "cost": cost, "audit": "".join(reversed(parts)), "repaired_sha256": hashed.hexdigest()}


def repair(rows: DataFrame) -> DataFrame:
    """For each conversation of the rows (conv, turn, role, text): gaps in its turns, rows by their first fault, illegal
    neighbours, the least cost, the edits and the hash of the repaired lines, each role:text."""
    small_batches(rows.sparkSession)
    order = ["conv", "turn", "role", "text"]
    cells = [F.coalesce(c, F.lit(" ")).alias(c) if c in ("role", "text") else F.col(c) for c in order]
    dealt = rows.select(*cells).repartition("conv")
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("turn")) > 1
    dealt = dealt.withColumn("again", again).sortWithinPartitions(*order, "again")
    kind = rows.schema["conv"].dataType
    names = ["conv", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, walk, out, arrow = None, None, [], None

        def table():
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], arrow if c == "conv" else pa.int64() if c in _COUNTS else pa.string()) for c in names], names=names)

        for batch in batches:
            arrow = batch.schema.field("conv").type
            for conv, *cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if walk is None or conv != at:
                    if walk is not None:
                        out.append({"conv": at, **walk.end()})
                    at, walk = conv, Walk()
                walk.row(*cells)
            if len(out) >= 1_000:
                yield table()
                out = []
        if walk is not None:
            out.append({"conv": at, **walk.end()})
        if out:
            yield table()

    fields = [T.StructField("conv", kind), *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    return dealt.mapInArrow(run, T.StructType(fields))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv, place (from 0), edit (K, R or I), role, text. `found` is what repair() gave for
    the same rows. Edits meet rows by their number in the conversation, so a long conversation is split like any skewed key."""
    length = F.length(F.replace("audit", F.lit("D"), F.lit("")))
    edits = found.select("conv", length.alias("length"), F.posexplode(F.split("audit", "")).alias("k", "edit")).where("edit <> ''")
    so_far = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda but: F.sum(F.when(F.col("edit") == but, 0).otherwise(1)).over(so_far)
    edits = edits.withColumn("n", count("I")).withColumn("place", count("D") - 1).where("edit <> 'D'")
    numbered = rows.select(F.col("conv").alias("conv_"), "role", "text", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).alias("n_"))
    out = edits.join(numbered, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("n") == F.col("n_")) & (F.col("edit") != "I"), "left")
    made = F.when((F.col("length") - F.col("place")) % 2 == 1, "assistant").otherwise("user")  # the last is an assistant's
    return out.select("conv", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(made).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

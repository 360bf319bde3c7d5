"""Conversation repair against an exhaustive search, its rows against its hash, and its edge cases."""

import hashlib
import random
import re
import time
import zlib

import pytest

from tallyforge.llm import conversations, queries

WORD = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")
DIR = "/root/testdata/sf0.001"


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        signs = WORD.findall(text)
        out.append("blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """The cheapest edits by trying all, with up to two inserts at each place: (cost, audit, lines)."""
    marks, best = faults(rows), None

    def go(i, cost, audit, roles, lines):
        nonlocal best
        if best is not None and cost > best[0] or not re.fullmatch(r"s?(ua)*u?", roles):
            return
        for extra in ("", "u", "a", "ua", "au"):
            r2 = roles + extra
            if not re.fullmatch(r"s?(ua)*u?", r2):
                continue
            c2, a2 = cost + 3 * len(extra), audit + "I" * len(extra)
            l2 = lines + [{"u": "user:", "a": "assistant:"}[x] for x in extra]
            if i == len(rows):
                if GRAMMAR.fullmatch(r2) and (best is None or (c2, a2) < best[:2]):
                    best = (c2, a2, l2)
                continue
            _, role, text = rows[i]
            go(i + 1, c2 + 4, a2 + "D", r2, l2)
            if marks[i] not in ("blank", "duplicate"):
                more = 3 * (marks[i] == "truncated")
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, c2 + more, a2 + "K", r2 + role[0], [*l2, f"{role}:{text}"])
                for x, name in (("u", "user"), ("a", "assistant")):
                    go(i + 1, c2 + 3 + more, a2 + "R", r2 + x, [*l2, f"{name}:{text}"])

    go(0, 0, "", "", [])
    return best


def made(r, n):
    rows = []
    for k in range(n):
        role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", ""])
        rows.append((k, role, r.choice(["Yes.", "No", "", " \n", f"Text {k}!", f"text {k}", "Yes. \n"])))
    return rows


@pytest.mark.parametrize("tail", [1, 2, 256])
def test_walk_finds_the_cheapest_edits(monkeypatch, tail):
    monkeypatch.setattr(conversations, "TAIL", tail)
    r = random.Random(4)
    for n in [0, 1, 2, 3, 4, 5] * 25:
        rows, walk, seen = made(r, n), conversations.Walk(), set()
        for turn, role, text in rows:
            walk.row(turn, role, text, (role, text) in seen)
            seen.add((role, text))
        got = walk.end()
        cost, audit, lines = exhaustive(rows)
        assert (got["cost"], got["audit"]) == (cost, audit), rows
        assert got["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        marks = faults(rows)
        assert [got[x] for x in ("blank", "duplicate", "truncated")] == [marks.count(x) for x in ("blank", "duplicate", "truncated")]
        assert got["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))


def test_long_conversations_take_time_in_proportion():
    took = []
    for n in (20_000, 40_000):
        walk, start = conversations.Walk(), time.time()
        for k in range(n):
            walk.row(k, "user", f"Turn {k}.", False)
        got = walk.end()
        took.append(time.time() - start)
        assert len(got["audit"]) == n and got["cost"] == 3 * n // 2
    assert took[1] < 4 * took[0] + 1


def damaged(rows):
    """The contract's damage, in plain Python."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def table(spark, path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, conv int").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_query_on_edges(spark, tmp_path):
    r = random.Random(8)
    rows = [(c, *x) for c in range(60) for x in made(r, r.randint(1, 5))]
    rows += [(None, 0, "user", "Who?"), (None, None, None, None), (None, 3, "assistant", None), (70, None, "user", "A."), (70, None, "user", "A."), (71, 5, "user", "x " * 200_000 + "."), (71, 9, "assistant", "Fine."), (72, 4, "system", "Be kind.")]
    lost = next(k for k in range(100, 300) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Gone."))
    found = queries.op13_conversation_repair(spark, table(spark, tmp_path, rows))
    got = {x.conv_id: x for x in found.collect()}
    assert set(got) == {x[0] for x in rows} and found.count() == len(got)
    left = {}
    for conv, *cells in damaged(rows):
        left.setdefault(conv, []).append(tuple(cells))
    for conv, x in got.items():
        turns = sorted(left.get(conv, []), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        known = [t[0] for t in turns if t[0] is not None]
        cost, audit, lines = exhaustive(turns)
        assert x.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert (x.cost, x.audit, x.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert got[lost].audit == "" and got[lost].repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark, tmp_path):
    assert queries.op13_conversation_repair(spark, table(spark, tmp_path, [])).count() == 0


def test_repaired_rows_are_those_that_were_hashed(spark):
    rows = conversations.damage(spark.read.parquet(f"{DIR}/conversations.parquet")).checkpoint()
    found = conversations.repair(rows).checkpoint()
    lines = {}
    for x in conversations.repaired(rows, found).collect():
        lines.setdefault(x.conv, []).append((x.place, f"{x.role}:{x.text}"))
    for x in found.collect():
        mine = sorted(lines.get(x.conv, []))
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(t for _, t in mine).encode()).hexdigest() == x.repaired_sha256
        assert GRAMMAR.fullmatch("".join(t[0] for _, t in mine))

"""The Merkle manifest against plain Python: nulls in all columns, ties, repeated rows, a hot group, groups of one."""

import hashlib
import zlib

import pytest

from tallyforge.llm import merkle, queries
from tallyforge.llm.common import scratch

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tf_i int, leaf string, tf_digest string"
DIR = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    cell = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(*map(cell, (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """The root of digests, and for each the (left, right) siblings on its way up."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + 16] for i in range(0, len(digests), 16)]
        for k, i in enumerate(at):
            run, pos = runs[i // 16], i % 16
            paths[k].append((run[:pos], run[pos + 1 :]))
            at[k] = i // 16
        digests = [h(*run) for run in runs]
    return digests[0], paths


def plain(rows):
    """The contract's rows of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found = []
    for s in names:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        found.append((members, *climb([leaf_of(*r) for r in members])))
    root, upper = climb([f[1] for f in found])
    out = []
    for (members, subroot, paths), above in zip(found, upper, strict=True):
        for r, path in zip(members, paths, strict=True):
            path = path + above
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                shown = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            folded = leaf_of(*shown)
            for left, right in path:
                folded = h(*left, folded, *right)
            out.append((r[0], leaf_of(*r), subroot, root, h(*(x for left, right in path for x in left + right)), folded, folded == root))
    return out


def edge_rows():
    rows = [(k, "hot", "en", k, f"Text {k}") for k in range(700)]
    rows += [(k, f"s{k % 40}", None, None, "É" * (k % 3)) for k in range(700, 760)]
    rows += [(None, None, None, None, None), (None, "hot", "en", 1, ""), (1, None, "de", 2, "A B"), (3, "hot", "en", 3, "Text 3"), (3, "hot", "en", 3, "Text 3"), (3, "hot", "xx", 3, "Other"), (5, "one", "", 0, "ONLY"), (6, "é", "en", 1, "x"), (7, "\U0001f642", "en", 1, "x"), (8, "", "en", 1, "Y")]
    return rows


def test_manifest_is_that_of_plain_python(spark, tmp_path):
    rows = edge_rows()
    spark.createDataFrame([(*r, 1, "l", "d") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_small_tables(spark, tmp_path, n):
    rows = [(k, "a", "en", 1, f"T{k}") for k in range(n)]
    spark.createDataFrame([(*r, 1, "l", "d") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_merkle_manifest(spark, str(tmp_path)).collect()))
    assert got == (sorted(plain(rows)) if rows else [])


def test_paths_are_whole_and_groups_are_dealt(spark):
    """The operator's own output: paths whose siblings and leaf give the root; a hot group's rows lie in several partitions."""
    docs = spark.createDataFrame([r[:5] for r in edge_rows()], "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with scratch(spark) as room:
            rows = merkle.manifest(room, docs).collect()
            assert len(rows) == len(edge_rows())
            for r in rows:
                at = r.leaf
                for step in r.path:
                    at = h(step.left, at, step.right)
                assert at == r.root
            numbered = merkle.numbered(room, room.keep(docs.selectExpr("source as g", "doc_id", "text")), ["g"], ["doc_id", "text"])
            hot = sorted(r.tf_i for r in numbered.where("g = 'hot'").collect())
            assert hot == list(range(len(hot)))
            assert docs.where("source = 'hot'").repartitionByRange("source", "doc_id").selectExpr("spark_partition_id() as p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

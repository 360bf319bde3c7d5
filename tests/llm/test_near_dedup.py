"""Near-dedup: hashes that differ, rows that grow with the group, repeated and null ids, and the removal of copies."""

import random

from tallyforge.llm import minhash


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_polynomial_hashes_confuse(spark):
    word = thue_morse(4096)
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"one two three {word}", f"one two three {other}", "x" * 64 + word[:40], "x" * 64 + other[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in minhash.near_duplicates(docs, size=4).orderBy("doc_id").collect()] == list(range(len(texts)))


def test_rows_grow_with_a_group_of_near_copies(spark, monkeypatch):
    rows, search = [], minhash._search

    def counted(room, held, passing, *rest):
        held, passing = room.keep(held), room.keep(passing)
        rows[-1] += held.count() + passing.count()
        return search(room, held, passing, *rest)

    monkeypatch.setattr(minhash, "_search", counted)
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 300))
    base = [word() for _ in range(80)]
    for n in (150, 300, 600):
        texts = [" ".join(word() if rng.random() < rng.choice([0.01, 0.02, 0.05]) else w for w in base) for _ in range(n)]
        rows.append(0)
        minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=4)
    assert rows[1] <= 2.6 * rows[0] and rows[2] <= 2.6 * rows[1]


def test_intersections_are_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    found = minhash.Index(sets[:20]).common(sets[20:])
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:20]]


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (1, "another text under the same id here"), (None, long), (None, "a text only without id for sure"), (None, "a text only without id for sure"), (7, long + " end"), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, tf_code string, component int")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert out == sorted([(1, 56, 1, True), (1, 56, 1, True), (1, 3, 1, True), (None, 56, 1, False), (None, 3, None, True), (None, 3, None, True), (7, 57, 1, False), (8, 0, 8, True), (9, 0, 9, True)], key=str)
    left = minhash.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, long), (1, rows[2][1]), (None, rows[4][1]), (8, None), (9, "")], key=str)

"""Neighbours, Gram-matrix models and splines against plain NumPy, and their edge cases."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import normal
from tallyforge.operators import gram, neighbours, simulate, splines
from tallyforge.plans import QUERIES, SQL


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<float>, label string")


def brute(rows, k, within=False):
    """id to [(distance, id)] by comparing all."""
    good = [(i, np.asarray(v, float), w) for i, v, w in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and x == x for x in v)]
    out = {}
    for i, v, w in good:
        gaps = sorted((float(np.sqrt(((v - u) ** 2).sum())), j) for j, u, z in good if j != i and (not within or z == w))
        out[i] = gaps[:k]
    return out


def same(got, want):
    assert set(got) == set(want)
    for i in want:
        assert [x[1] for x in got[i]] == [x[1] for x in want[i]]
        assert np.allclose([x[0] for x in got[i]], [x[0] for x in want[i]], atol=1e-6)


def listed(found):
    return {r.id: [tuple(x) for x in r.neighbours] for r in found.collect()}


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    out = [(k, [float(x) for x in r.normal(size=4).astype(np.float32)], "ab"[k % 2]) for k in range(150)]
    out += [(200 + k, [1.0, 2.0, 3.0, 4.0], "a") for k in range(40)]  # copies
    out += [(300, None, "a"), (301, [1.0, float("nan"), 0.0, 0.0], "a"), (302, [1.0, None, 0.0, 0.0], "b"), (303, [1.0], "b"), (304, [], "b"), (None, [0.0] * 4, "a"), (305, [0.0] * 4, None), (306, [0.5] * 4, None), (307, [9.0] * 4, "alone")]
    return out


@pytest.mark.parametrize("within", [None, "label"])
def test_exact_neighbours(spark, rows, within, monkeypatch):
    monkeypatch.setattr(neighbours, "SHELF_ROWS", 40)  # the one list is dealt over shelves, and the asked ones over blocks
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 30)
    monkeypatch.setattr(neighbours, "AT_ONCE", 7)
    monkeypatch.setattr(neighbours.shelves, "__defaults__", (40,))
    same(listed(neighbours.nearest(vectors(spark, rows), "id", "v", 5, within=within)), brute(rows, 5, within is not None))


def test_asked_rows_and_edges(spark, rows):
    df = vectors(spark, rows)
    got = listed(neighbours.nearest(df, "id", "v", 3, asked=F.col("id") % 20 == 0))
    want = {i: x for i, x in brute(rows, 3).items() if i % 20 == 0}
    same(got, want)
    assert listed(neighbours.nearest(vectors(spark, []), "id", "v", 3)) == {}
    assert listed(neighbours.nearest(vectors(spark, [(1, [0.0] * 4, "a")]), "id", "v", 3)) == {1: []}
    assert neighbours.fit(vectors(spark, []), "id", "v", 3).probes == 1


def test_index_probes_as_many_lists_as_the_recall_needs(spark):
    r = np.random.default_rng(2)
    centre = r.normal(size=(30, 16)) * 5
    rows = [(k, [float(x) for x in centre[k % 30] + r.normal(size=16)], "a") for k in range(1500)]
    rows += [(5000 + k, [0.25] * 16, "a") for k in range(500)]  # a hot class
    df = vectors(spark, rows).checkpoint()
    index = neighbours.fit(df, "id", "v", 5, list_rows=60)
    assert len(index.centroids) > 20 and index.probes < len(index.centroids) / 2
    exact = neighbours.nearest(df, "id", "v", 5)
    total = neighbours.recall_of(neighbours.nearest(df, "id", "v", 5, index), exact, "id").agg(F.sum("hits"), F.sum("wanted")).first()
    assert total[0] >= 0.9 * total[1] and total[1] == 5 * 2000


def test_lists_are_packed_and_hot_ones_dealt():
    got = neighbours.shelves([("", 0, 10), ("", 1, 90), ("", 2, 5), ("", 3, 250), ("", 4, 1)], 100)
    assert got == {("", 0): (0, 1), ("", 1): (0, 1), ("", 2): (1, 1), ("", 3): (2, 3), ("", 4): (5, 1)}


def test_made_rows_lie_between_rows_of_their_class(spark, rows):
    df = vectors(spark, rows)
    made = neighbours.oversampled(df, "id", "v", "label", k=3)
    again = {tuple(map(str, r)) for r in neighbours.oversampled(df.repartition(7), "id", "v", "label", k=3).collect()}
    got = made.collect()
    assert {tuple(map(str, r)) for r in got} == again
    by_id = {i: (np.asarray(v, float), w) for i, v, w in rows if v is not None and len(v) == 4 and i is not None}
    near = brute(rows, 3, True)
    usable = [w for i, v, w in rows if i in near and w is not None]
    whole = [w for i, v, w in rows if i is not None and w is not None and v is not None and all(x is not None and x == x for x in v)]
    largest = max(whole.count(w) for w in set(whole))
    for w in ("a", "b"):
        assert sum(r.label == w for r in got) == largest - whole.count(w)
    assert "alone" in usable and all(r.label in "ab" for r in got)
    for r in got:
        (a, wa), (b, wb) = by_id[r.base], by_id[r.other]
        assert wa == wb == r.label and r.other in [j for _, j in near[r.base]] and 0 < r.place < 1
        assert np.allclose(r.v, a + r.place * (b - a))


def linear_rows(n, p, groups, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p)) + 3
    x[:, 1] = x[:, 0] + 0.1 * r.normal(size=n)  # nearly collinear
    g = r.integers(0, groups, n)
    y = x @ r.normal(size=p) + g + r.normal(size=n)
    return x, g, y


def table(spark, x, g, y):
    names = [f"x{k}" for k in range(x.shape[1])]
    rows = [(None if a == 2 else int(a), int(k % 4), *map(float, r), float(v)) for k, (a, r, v) in enumerate(zip(g, x, y, strict=True))]
    return spark.createDataFrame(rows, f"g int, fold int, {', '.join(f'{c} double' for c in names)}, y double"), names


def objective(b, a, x, y, weight, l1):
    return 0.5 * np.mean((y - x @ b - a) ** 2) + weight * (l1 * np.abs(b).sum() + (1 - l1) / 2 * (b**2).sum())


def test_gram_models(spark):
    x, g, y = linear_rows(400, 5, 3)
    df, names = table(spark, x, g, y)
    bad = spark.createDataFrame([(0, 1, None, 1.0, 1.0, 1.0, 1.0, 1.0), (0, 1, 1.0, float("nan"), 1.0, 1.0, 1.0, 1.0), (0, 1, 1.0, 1.0, 1.0, 1.0, 1.0, None)], df.schema)
    sums = gram.sums(df.unionByName(bad).repartition(5), names, "y", ["g"]).checkpoint()
    for weight, l1 in ((0.0, 0.0), (0.3, 0.0), (0.2, 1.0), (0.2, 0.5)):
        for r in gram.fitted(sums, weight, l1).collect():
            use = g == (2 if r.g is None else r.g)
            xs, ys, b = x[use], y[use], np.array(r.tf_b)
            assert r.tf_n == use.sum()
            slope = (xs - xs.mean(0)).T @ (xs @ b + r.tf_a - ys) / len(ys) + weight * (1 - l1) * b
            for s, c in zip(slope, b, strict=True):  # the conditions of the least objective
                assert abs(s + weight * l1 * np.sign(c)) < 1e-6 if c else abs(s) <= weight * l1 + 1e-6
            assert abs(np.mean(ys - xs @ b - r.tf_a)) < 1e-8
            for _ in range(20):
                assert objective(b, r.tf_a, xs, ys, weight, l1) <= objective(b + np.random.default_rng(3).normal(size=5) * 0.01, r.tf_a, xs, ys, weight, l1) + 1e-9
    got = {r.g: r for r in gram.fitted(sums, bayesian=True).collect()}
    for a, r in got.items():
        use = g == (2 if a is None else a)
        xs, ys = x[use] - x[use].mean(0), y[use] - y[use].mean()
        want = np.linalg.solve(r.tf_noise * xs.T @ xs + r.tf_spread * np.eye(5), r.tf_noise * xs.T @ ys)
        assert np.allclose(r.tf_b, want)
        known = 5 - r.tf_spread * np.trace(np.linalg.inv(r.tf_noise * xs.T @ xs + r.tf_spread * np.eye(5)))
        assert r.tf_spread == pytest.approx(known / (want**2).sum(), rel=1e-4)
        assert r.tf_noise == pytest.approx((len(ys) - known) / ((ys - xs @ want) ** 2).sum(), rel=1e-4)
    shown = gram.predicted(df, gram.fitted(sums), names, ["g"], "p").collect()
    assert len(shown) == 400 and all(r.p is not None for r in shown)
    assert gram.sums(df.limit(0), names, "y", ["g"]).count() == 0


def test_constant_features_get_nothing(spark):
    df = spark.createDataFrame([(1.0, float(k), 2.0 * k) for k in range(20)], "a double, b double, y double")
    for weight, l1 in ((0.0, 0.0), (0.01, 1.0)):
        r = gram.fitted(gram.sums(df, ["a", "b"], "y", []), weight, l1).first()
        assert r.tf_b[0] == 0 and r.tf_b[1] == pytest.approx(2, abs=0.01)


def test_halving_finds_what_a_full_search_finds(spark):
    x, g, y = linear_rows(600, 5, 3, seed=7)
    df, names = table(spark, x, g, y)
    grid = [(w, l1) for w in (0.001, 0.05, 0.5, 3.0) for l1 in (0.0, 1.0)]
    got = {r.g: r for r in gram.search(df, names, "y", ["g"], "fold", 4, grid).collect()}
    full = {r.g: r for r in gram.search(df, names, "y", ["g"], "fold", 4, grid, keep=1.0, first=4).collect()}
    fold = np.arange(600) % 4
    for a in (0, 1, None):
        use = g == (2 if a is None else a)
        errors = []
        for weight, l1 in grid:
            each = []
            for f in range(4):
                fit, out = use & (fold != f), use & (fold == f)
                xs, ys = x[fit] - x[fit].mean(0), y[fit] - y[fit].mean()
                b = gram.elastic_net(xs.T @ xs / len(ys), xs.T @ ys / len(ys), weight, l1)
                each.append(np.mean((y[out] - y[fit].mean() - (x[out] - x[fit].mean(0)) @ b) ** 2))
            errors.append(np.mean(each))
        best = int(np.argmin(errors))
        assert full[a].trial == got[a].trial == best
        assert got[a].error == pytest.approx(errors[best]) == full[a].error


def dense(x, y, w, penalty):
    """The smoothing spline's hat matrix by a dense solve."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    return np.linalg.solve(np.diag(w) + penalty * q @ np.linalg.solve(r, q.T), np.diag(w))


@pytest.mark.parametrize("n", [3, 4, 5, 6, 60])
def test_spline_is_that_of_a_dense_solve(n):
    r = np.random.default_rng(n)
    x, w = np.cumsum(r.uniform(0.2, 1.5, n)), r.integers(1, 9, n).astype(float)  # closer knots leave the dense system without digits
    y = np.sin(x) + r.normal(0, 0.2, n)
    some = np.array([1e-3, 0.1, 10.0])
    curve, bend, left_out = splines.solve(x, y, w, some)
    for k, penalty in enumerate(some):
        hat = dense(x, y, w, penalty)
        assert np.allclose(curve[k], hat @ y, atol=1e-8)
        assert np.allclose(left_out[k], (y - hat @ y) / (1 - np.diag(hat)), atol=1e-7)
        assert bend[k][0] == bend[k][-1] == 0
    for j in range(n if n > 4 else 0):  # leaving a knot out indeed
        rest = np.arange(n) != j
        found, second, _ = splines.solve(x[rest], y[rest], w[rest], some)
        for k in range(3):
            piece = splines.pieces(x[rest], found[k], second[k])[np.searchsorted(x[rest], x[j])]
            value = np.polyval(piece[:0:-1], x[j] - piece[0])
            assert y[j] - value == pytest.approx(left_out[k][j], abs=1e-6)


def test_curves_by_group(spark):
    r = np.random.default_rng(4)
    rows = [(g, float(v), float(np.cos(v * (1 + (g or 0))) + r.normal(0, 0.05))) for g in (0, 1, None) for v in r.uniform(0, 6, 700)]
    rows += [(7, 1.0, 2.0), (8, 1.0, 2.0), (8, 3.0, 4.0), (8, 3.0, 6.0), (9, None, 1.0), (9, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    found = splines.curves(df, ["g"], "x", "y", knots=64).checkpoint()
    cells = {}
    for k in found.orderBy("x").collect():
        cells.setdefault(k.g, []).append(k)
    assert set(cells) == {0, 1, None, 7, 8} and all(len(c) <= 64 for c in cells.values())
    for g, knots in cells.items():
        if len(knots) > 2:
            x, y, n = (np.array([k[c] for k in knots], float) for c in ("x", "y", "n"))
            assert np.allclose([k.fitted for k in knots], dense(x, y, n, knots[0].penalty) @ y, atol=1e-6)
            best = min((float((n * (splines.solve(x, y, n, [p])[2][0] ** 2)).sum()), p) for p in np.array(splines.GRID) * (x[-1] - x[0]) ** 3 * n.mean())
            assert knots[0].penalty == pytest.approx(best[1])
    asked = [(g, v) for g in (0, 1, None, 7, 8) for v in (-5.0, 0.0, 0.3, 2.71, 5.9, 50.0)] + [(5, 1.0), (0, None)]
    got = splines.at(spark.createDataFrame(asked, "g int, x double"), found, ["g"], "x", "curve", knots=64).collect()
    assert len(got) == len(asked)
    for a in got:
        if a.x is None or a.g == 5:
            assert a.curve is None
        else:
            x, y, c = (np.array([k[f] for k in cells[a.g]], float) for f in ("x", "fitted", "bend"))
            piece = splines.pieces(x, y, c)[np.searchsorted(x, a.x, "right")]
            assert a.curve == pytest.approx(np.polyval(piece[:0:-1], a.x - piece[0]))
    by_x = {a.x: a.curve for a in got if a.g == 8}
    assert by_x[50.0] == pytest.approx(2.0 + 49.0 * 1.5) and {a.curve for a in got if a.g == 7} == {2.0}
    assert splines.curves(df.limit(0), ["g"], "x", "y").count() == 0


def test_normal_expressions(spark):
    from statistics import NormalDist

    from tallyforge.functions import normal

    n = NormalDist()
    ps = [1e-300, 1e-40, 1e-12, 1e-5, 0.01, 0.074, 0.076, 0.3, 0.5, 0.7, 0.93, 0.99, 1 - 1e-9, 0.0, 1.0, None]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.inverse(F.col("p")).alias("z")).collect():
        assert r.z is None if r.p in (0.0, 1.0, None) else r.z == pytest.approx(n.inv_cdf(r.p), abs=1e-12)
    zs = [-9.0, -7.4, -3.0, -0.5, 0.0, 1.0, 2.5, 6.0, 8.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal.distribution(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(n.cdf(r.z), abs=1e-14)
    rows = [(u, m, s, a, b) for u in (0.001, 0.4, 0.999) for m, s, a, b in ((5.0, 1.0, 4.0, 8.0), (0.0, 2.0, 1.0, 1.5), (3.0, 0.0, 4.0, 8.0))]
    df = spark.createDataFrame(rows, "u double, mean double, sd double, low double, high double")
    c = [F.col(x) for x in ("mean", "sd", "low", "high")]
    for r in df.withColumn("x", normal.truncated(F.col("u"), normal.shares(*c), *c)).collect():
        pa, pb = (n.cdf((r.low - r.mean) / r.sd), n.cdf((r.high - r.mean) / r.sd)) if r.sd else (0, 0)
        want = r.mean + r.sd * n.inv_cdf(pa + r.u * (pb - pa)) if r.sd else r.mean
        assert r.x == pytest.approx(min(max(want, r.low), r.high), abs=1e-9)


def test_made_rows_of_a_larger_table_as_in_sql(spark, tmp_path):
    r = np.random.default_rng(4)
    made = [(i, [float(x) for x in v], 0 if i % 3 else 1 if i % 2 else 2) for i, v in enumerate(r.normal(size=(2_400, 8)))]
    path = str(tmp_path)
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    got = sorted(tuple(x) for x in QUERIES["ml15_made_rows"](spark, path).select("label", "base", "turn", "other").collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    assert got == sorted(duck.sql(f"SELECT label, base, turn, other FROM ({SQL['ml15_made_rows']})").fetchall())


def test_every_row_gets_a_vote(spark, tmp_path):
    r = np.random.default_rng(9)
    made = [(i, [float(x) for x in v], i * 7 % 4) for i, v in enumerate(r.normal(size=(90, 4)).astype(np.float32))]
    made += [(100 + i, [1.0, 2.0, 3.0, 4.0], i % 3) for i in range(25)]  # copies
    path = str(tmp_path)
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    got = sorted(tuple(x) for x in QUERIES["ml4_neighbour_vote"](spark, path).select("vec_id", "label", "predicted", "votes", "mean").collect())
    labels, want = {i: x for i, _, x in made}, []
    for i, near in sorted(brute([(i, v, "") for i, v, _ in made], 10).items()):
        own = [labels[j] for _, j in near]
        most = min(own, key=lambda x: (-own.count(x), x))
        want.append((i, labels[i], most, own.count(most), round(sum(own) / 10, 6)))
    assert len(want) == 115 and got == want
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    assert got == sorted(duck.sql(f"SELECT vec_id, label, predicted, votes, mean FROM ({SQL['ml4_neighbour_vote']})").fetchall())


def most_memory(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_search_holds_tiles_and_near_ties_are_told_apart():
    r = np.random.default_rng(5)
    base = r.normal(size=(20_000, 8)).astype(np.float32)
    asked = r.normal(size=(1_000, 8)).astype(np.float32)
    find = lambda a, b, k: neighbours.best_of(a, [[0]] * len(a), [""] * len(a), b, [0] * len(b), [""] * len(b), k)
    assert most_memory(lambda: find(asked, base, 19)) < 40  # all distances are 80 MB
    who, whom = find(asked[:50], base, 7)
    true = ((asked[:50, None].astype(float) - base) ** 2).sum(2)
    assert whom.reshape(50, 7).tolist() == np.argsort(true, axis=1)[:, :7].tolist() and who.tolist() == np.repeat(range(50), 7).tolist()
    close = (100 + 1e-4 * base[:500]).astype(np.float32)
    true = ((close[:20, None].astype(float) - close) ** 2).sum(2)
    got = find(close[:20], close, 7)[1].reshape(20, 7)
    assert np.allclose(np.sort(np.take_along_axis(true, got, 1)), np.sort(true)[:, :7], rtol=1e-2, atol=1e-10)


def test_probing_memory_is_bounded():
    index = neighbours.Index(np.random.default_rng(6).normal(size=(4_096, 8)).astype(np.float32), 1_000)
    vectors_ = np.random.default_rng(7).normal(size=(4_000, 8)).astype(np.float32)
    got = []
    assert most_memory(lambda: got.append(index.order(vectors_, 3))) < 40  # all places are 131 MB
    whole = (index.centroids**2).sum(1) - 2 * vectors_ @ index.centroids.T
    assert got[0].tolist() == np.argsort(whole, axis=1, kind="stable")[:, :3].tolist()


def test_draws_are_compiled_and_as_truncated_says(spark):
    rows = [("a", 5.0, 1.0, 2.5, 7.5), ("b", 5.0, 2.0, 20.0, 30.0), ("c", 5.0, 0.0, 6.0, 9.0), ("d", 5.0, None, 1.0, 9.0), ("e", None, 1.0, 1.0, 9.0), ("f", 5.0, 1.0, -40.0, 40.0)]
    df = spark.createDataFrame(rows, "player string, mean double, sd double, low double, high double")
    out = simulate.draws(df, "player", 40)
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    c = [F.col(x) for x in ("mean", "sd", "low", "high")]
    long = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(39))))
    want = long.select("player", "draw", normal.truncated(simulate.uniform(1, F.col("player"), F.col("draw")), normal.shares(*c), *c).alias("points"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

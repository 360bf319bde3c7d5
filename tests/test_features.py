"""Feature agglomeration, attributions, quantile regression and gamma draws against plain Python, and their edge cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tallyforge.functions.gamma import gamma
from tallyforge.operators import agglomerate, attributions, gram, quantile_regression
from tallyforge.operators.simulate import uniform
from tallyforge.plans import QUERIES
from tallyforge.sources import model_store


def nearest_pairs(d, clusters=None, height=None):
    """Average linkage by always merging the nearest pair of clusters."""
    groups = [[k] for k in range(len(d))]
    while len(groups) > (clusters or 1):
        h, a, b = min((np.mean([d[i][j] for i in groups[a] for j in groups[b]]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        if height is not None and h > height:
            break
        groups[a] = sorted(groups[a] + groups.pop(b))
    number = {k: n for n, g in enumerate(sorted(groups)) for k in g}
    return [number[k] for k in range(len(d))]


@pytest.mark.parametrize("seed", range(25))
def test_chain_is_the_nearest_pair(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(2, 13))
    x = r.normal(size=(60, n)) + r.normal(size=(60, 1)) * r.normal(size=n)
    d = 1 - np.corrcoef(x.T)
    merges = agglomerate.chain(d)
    assert len(merges) == n - 1
    for k in range(1, n + 1):
        assert agglomerate.cut(merges, n, k, None) == nearest_pairs(d, clusters=k)
    for h in (0.0, 0.3, 0.8, 1.1):
        assert agglomerate.cut(merges, n, None, h) == nearest_pairs(d, height=h)


def test_equal_columns_merge_in_order():
    d = np.ones((5, 5)) - np.eye(5)
    assert agglomerate.cut(agglomerate.chain(d), 5, 4, None) == [0, 0, 1, 2, 3]
    assert agglomerate.cut(agglomerate.chain(np.zeros((4, 4))), 4, 1, None) == [0, 0, 0, 0]


def test_pooled_columns(spark):
    r = np.random.default_rng(3)
    a = r.normal(size=80)
    rows = [(k, "u" if k % 4 else None, float(a[k]), float(2 * a[k] + 1 + r.normal() * 0.01), float(r.normal()), 7.0) for k in range(80)]
    rows += [(90, "u", None, 1.0, 2.0, 7.0), (91, "u", float("nan"), 1.0, 2.0, 7.0), (92, "other", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    found = agglomerate.clustered(df, cols, ["g"], clusters=3)
    got = {x.g: x for x in found.collect()}
    assert set(got) == {"u", None} and all(list(x.tf_cluster) == [0, 0, 1, 2] for x in got.values())
    out = {x.id: x.parts for x in agglomerate.pooled(df, found, cols, ["g"], "parts").collect()}
    assert 92 not in out and out[90][0] is None and out[91][0] is None and out[90][2] == 0.0 and out[90][1] is not None
    for g in ("u", None):
        mine = np.array([x[2:5] for x in rows[:80] if x[1] == g])
        z = (mine - mine.mean(0)) / mine.std(0)
        want = dict(zip([x[0] for x in rows[:80] if x[1] == g], z, strict=True))
        for k, v in want.items():
            assert out[k] == pytest.approx([v[:2].mean(), v[2], 0.0], abs=1e-9)
    assert agglomerate.clustered(df.limit(0), cols, ["g"], clusters=2).count() == 0
    assert list(agglomerate.clustered(df, cols, [], height=2.0).first().tf_cluster) == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        agglomerate.clustered(df, cols, ["g"])


def test_vector_groups(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    x = np.array(list(rows.values()), float)
    z = (x - x.mean(0)) / x.std(0)
    group = np.array(nearest_pairs(1 - np.corrcoef(x.T), clusters=8))
    want = {k: [v[group == g].mean() for g in range(8)] for k, v in zip(rows, z, strict=True)}
    got = {r.vec_id: list(r)[1:] for r in QUERIES["ml7_vector_groups"](spark, sf).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1.1e-5) for k in want)


def expectation(node, x, known):
    """A tree's value with the features outside `known` going both ways."""
    if node.numDescendants() == 0:
        return node.prediction()
    left, right, f = node.leftChild(), node.rightChild(), node.split().featureIndex()
    if f in known:
        return expectation(left if x[f] <= node.split().threshold() else right, x, known)
    n, m = left.impurityStats().count(), right.impurityStats().count()
    return (n * expectation(left, x, known) + m * expectation(right, x, known)) / (n + m)


@pytest.mark.parametrize("kind", [DecisionTreeRegressor, RandomForestRegressor, GBTRegressor])
def test_shapley_values_of_trees(spark, kind):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(120, 4)), 1)
    rows = [(k, *map(float, v), float(v[0] * 2 + v[1] * v[2] + (v[0] > 0) * v[3])) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double")
    cols = ["a", "b", "c", "d"]
    more = {} if kind is DecisionTreeRegressor else {"numTrees": 3} if kind is RandomForestRegressor else {"maxIter": 3}
    assembled = VectorAssembler(inputCols=cols, outputCol="v").transform(df)
    model = kind(featuresCol="v", labelCol="y", predictionCol="said", maxDepth=4, seed=2, **more).fit(assembled)
    out = attributions.trees(model.transform(assembled).drop("v"), model, cols, "part").collect()
    assert len(out) == 120
    assert all(sum(o.part) + o.part_base == pytest.approx(o.said, abs=1e-9) for o in out)
    trees = model.trees if hasattr(model, "trees") else [model]
    weights = list(model.treeWeights) if hasattr(model, "trees") else [1.0]
    weights = [w / sum(weights) for w in weights] if kind is RandomForestRegressor else weights
    roots = [t._call_java("rootNode") for t in trees]
    for o in out[:3]:
        say = lambda s, o=o: sum(w * expectation(n, [o.a, o.b, o.c, o.d], s) for w, n in zip(weights, roots, strict=True))
        values = {s: say(set(s)) for k in range(5) for s in itertools.combinations(range(4), k)}
        assert o.part_base == pytest.approx(values[()], abs=1e-9)
        for i in range(4):
            rest = [s for s in values if i not in s]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (values[tuple(sorted((*s, i)))] - values[s]) for s in rest)
            assert o.part[i] == pytest.approx(want, abs=1e-9)
    missing = spark.createDataFrame([(1, None, 1.0, 1.0, 1.0), (2, 1.0, float("nan"), 1.0, 1.0), (3, 0.0, 0.0, 0.0, 0.0)], "id long, a double, b double, c double, d double")
    got = {o.id: (o.part, o.part_base) for o in attributions.trees(missing, model, cols, "part").collect()}
    assert got[1] == (None, None) and got[2] == (None, None) and got[3][1] is not None
    assert attributions.trees(missing.limit(0), model, cols, "part").count() == 0


def test_linear_parts_and_signed_scores(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 3))
    y = 3 + x @ [2.0, -1.0, 0.1]
    df = spark.createDataFrame([(k, "ab"[k % 2], *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))] + [(900, "a", None, 1.0, 1.0, None), (901, "none", 1.0, 1.0, 1.0, None)], "id long, g string, p double, q double, r double, y double")
    cols = ["p", "q", "r"]
    m = gram.sums(df, cols, "y", ["g"])
    models = gram.fitted(m)
    out = {o.id: o for o in attributions.linear(df, models, attributions.group_means(m, 3), cols, ["g"], "part").collect()}
    assert 901 not in out and out[900].part[0] is None and out[900].part[1] is not None
    assert all(sum(out[k].part) + out[k].part_base == pytest.approx(y[k], abs=1e-8) for k in range(200))
    scores = {o.id: o.s for o in attributions.signed_score(df, models, cols, ["g"], 2, "s").collect()}
    assert scores[900] is None and 901 not in scores
    for g in (0, 1):
        mine = x[g::2]
        q_top = max(mine[:, 1].max(), 1.0 if g == 0 else -9.0)
        t = np.log(q_top - mine[:, 1] + 1)
        extra = np.log(q_top - 1.0 + 1)  # the row without p has a q, which counts where q is standardised
        pool = np.append(t, extra) if g == 0 else t
        want = (2 * (mine[:, 0] - mine[:, 0].mean()) / mine[:, 0].std() + (t - pool.mean()) / pool.std()) / 2
        assert [scores[k] for k in range(g, 200, 2)] == pytest.approx(list(want), abs=1e-6)


def pinball(y, line, q):
    r = y - line
    return np.maximum(q * r, (q - 1) * r).sum()


@pytest.mark.parametrize("q", [0.2, 0.8])
def test_quantile_lines_have_the_least_loss(spark, q):
    """The best line goes through two rows, so on few rows all pairs tell the least loss."""
    r = np.random.default_rng(6)
    x = r.uniform(0, 10, 90)
    y = 3 * x + (1 + x) * r.exponential(size=90)
    df = spark.createDataFrame([(int(k % 2), float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "g int, x double, y double")
    got = {o.g: o for o in quantile_regression.fit(df, ["x"], "y", ["g"], q).collect()}
    for g in (0, 1):
        a, b = x[g::2], y[g::2]
        pairs = [((b[i] - b[j]) / (a[i] - a[j]), i) for i in range(45) for j in range(i)]
        best = min(pinball(b, b[i] + s * (a - a[i]), q) for s, i in pairs)
        mine = pinball(b, got[g].tf_a + got[g].tf_b[0] * a, q)
        assert mine <= best * 1.01


def test_quantile_lines_of_many_rows_and_edges(spark):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS g", "double(id % 97) AS x", "double(id % 89) AS z", "7D AS still", "double(id % 97) * 2 - double(id % 89) + pow((id * 7919) % 10007 / 10007D, 3) * 50 * (1 + id % 97 / 97D) AS y")
    lines = quantile_regression.fit(df, ["x", "z", "still"], "y", ["g"], 0.8)
    out = gram.predicted(df, lines, ["x", "z", "still"], ["g"], "line").groupBy("g").agg(F.avg((F.col("y") < F.col("line")).cast("int")).alias("s"), F.sum(F.greatest(0.8 * (F.col("y") - F.col("line")), -0.2 * (F.col("y") - F.col("line")))).alias("loss"))
    found, models = {r.g: r for r in out.collect()}, {r.g: r for r in lines.collect()}
    assert set(found) == {None, 1, 2} and all(abs(r.s - 0.8) < 0.002 for r in found.values())
    for g, r in found.items():  # no line a little aside is better
        p = df.where(F.col("g").eqNullSafe(F.lit(g))).toPandas()
        a, b = models[g].tf_a, np.array(models[g].tf_b)
        assert b[2] == 0.0
        say = lambda a, b, p=p: pinball(p.y.to_numpy(), a + p[["x", "z", "still"]].to_numpy() @ b, 0.8)
        assert say(a, b) == pytest.approx(r.loss)
        for k in (0, 1):
            for turn in (-0.02, 0.02):
                moved = b.copy()
                moved[k] += turn
                shift = -turn * p["xz"[k]].mean()
                assert say(a + shift, moved) >= r.loss * (1 - 1e-4)
    few = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 1.0), ("c", 1.0, float("nan")), ("d", 1.0, 5.0), ("d", 1.0, 5.0)], "g string, x double, y double")
    got = {r.g: (list(r.tf_b), r.tf_a) for r in quantile_regression.fit(few, ["x"], "y", ["g"], 0.5, passes=3).collect()}
    assert got == {"a": ([0.0], pytest.approx(2.0)), "d": ([0.0], pytest.approx(5.0))}
    assert quantile_regression.fit(few.limit(0), ["x"], "y", ["g"], 0.5, passes=1).count() == 0


@pytest.mark.parametrize("shape", [1.0, 2.5, 40.0])
def test_gamma_draws(spark, shape):
    draw = gamma(F.lit(shape), lambda k: (uniform(1, F.col("id"), k), uniform(2, F.col("id"), k)))
    m, v, low = spark.range(40_000).select(draw.alias("x")).agg(F.avg("x"), F.var_pop("x"), F.min("x")).first()
    assert m == pytest.approx(shape, abs=4 * math.sqrt(shape / 40_000)) and v == pytest.approx(shape, rel=0.08) and low > 0
    assert spark.range(1).select(gamma(F.lit(0.5), lambda k: (uniform(1, k), uniform(2, k)))).first()[0] is None


def test_model_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(k, k % 3 if k < 30 else None, float(k), 2.0 * k + 1 + k % 2) for k in range(32)], "id long, fold int, x double, y double")
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v"), LinearRegression(featuresCol="v", labelCol="y", predictionCol="said")])
    with pytest.raises(KeyError):
        model_store.load(spark, root, "a")
    assert model_store.keys(spark, root).count() == 0
    oof = model_store.out_of_fold(df, pipeline, "fold", 3, "said", "oof").select("id", "fold", "oof")
    model_store.save(root, "a", pipeline.fit(df.where("id < 5")), oof.limit(1))
    model_store.save(root, "b", pipeline.fit(df.where("id > 9")), oof.limit(2))
    fitted = pipeline.fit(df)
    model_store.save(root, "a", fitted, oof)
    (tmp_path / "store/runs/halfway/model").mkdir(parents=True)  # what a lost driver leaves is not read
    model, held = model_store.load(spark, root, "a")
    assert sorted(r.key for r in model_store.keys(spark, root).collect()) == ["a", "b"]
    assert model.transform(df).select("id", "said").collect() == fitted.transform(df).select("id", "said").collect()
    rows = {r.id: r for r in held.collect()}
    assert set(rows) == set(range(30))
    for k, r in rows.items():
        x, y = zip(*((j, 2.0 * j + 1 + j % 2) for j in range(30) if j % 3 != k % 3), strict=True)
        slope, start = np.polyfit(x, y, 1)
        assert r.oof == pytest.approx(start + slope * k, abs=1e-6)
    assert model_store.load(spark, root, "b")[1].count() == 2


def test_rows_of_few_groups_are_not_shuffled_by_group(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "ab"[k % 10 > 0] if k else None, float(k)) for k in range(50)], "id int, g string, x double")
    means = rows.groupBy("g").agg(F.avg("x").alias("m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = gram.joined(rows, means, ["g"])
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.m for r in out.collect()}
        monkeypatch.setattr(gram, "FEW", 2)  # more groups than that are joined by a shuffle
        assert got == {r.id: r.m for r in gram.joined(rows, means, ["g"]).collect()} and len(got) == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

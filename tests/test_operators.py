"""Micro-fixtures for the semantics that are easy to get wrong."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tallyforge.functions.columns import clean_name, clean_number, half_even, look_up, no_nan, ratio, row_mean, row_std, row_sum, scrub, title
from tallyforge.functions.text import similarity
from tallyforge.operators import relational as rel
from tallyforge.operators import models, quantile_regression, simulate, stats
from tallyforge.operators import windows as win
from tallyforge.sources import files, tables


def col(df, name):
    return [r[name] for r in df.collect()]


def test_rolling_counts_rows_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 5, 4.0), ("b", 1, 7.0)], "k string, y int, x double")
    out = {(r.k, r.y): (r.x_r3_mean, r.full_x_r3_mean) for r in win.rolling(win.rolling(df, ["k"], ["y"], ["x"], 3, "mean"), ["k"], ["y"], ["x"], 3, "mean", least=3, fill=-1.0, prefix="full_").collect()}
    assert out == {("a", 1): (1.0, -1.0), ("a", 2): (1.0, -1.0), ("a", 5): (2.5, -1.0), ("b", 1): (7.0, -1.0)}


def test_forward_fill_keeps_leading_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 3), ("a", 3, None)], "k string, y int, x int")
    assert col(win.forward_fill(df, ["k"], ["y"], ["x"]).orderBy("y"), "x") == [None, 3, 3]


def test_rank_of_null_is_null_and_ties_share_the_least(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 1)], "i int, x int").withColumn("g", F.lit(1))
    assert col(win.rank_min(df, ["g"], "x", "r").orderBy("i"), "r") == [1, 1, None, 3]


@pytest.mark.parametrize(("n", "k", "sizes"), [(14, 4, [4, 4, 4, 2]), (9, 6, [2, 2, 2, 2, 1])])
def test_buckets_are_not_ntile(spark, n, k, sizes):
    df = win.equal_buckets(spark.range(n).withColumn("g", F.lit(1)), ["g"], "id", False, [], k, "b")
    assert [r["count"] for r in df.groupBy("b").count().orderBy("b").collect()] == sizes


def test_replacement_in_small_groups_and_unknown_kinds(spark):
    df = spark.createDataFrame([(1, "QB", 9.0, 1), (1, "QB", 5.0, 2), (1, "K", 3.0, 3)], "y int, pos string, pts double, id int")
    out = {r.id: r.vor for r in win.over_replacement(df, ["y", "pos"], "pos", "pts", {"QB": 12}, [F.desc("pts"), "id"], "vor").collect()}
    assert out == {1: 4.0, 2: 0.0, 3: None}


def test_extreme_rows_keep_ties_and_keep_first_does_not(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", 4, 1)], "k string, x int, id int")
    assert sorted(col(win.extreme_rows(df, ["k"], ["x"]), "id")) == [2, 3]
    assert col(win.keep_first(df, ["k"], ["x", "id"]), "id") == [2]


def test_consensus(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, 4.0, None, None), (3, 5.0, 5.0, 5.0), (4, 2.0, None, 4.0)], "i int, a double, b double, c double")
    out = {r.i: (r.a, r.b, r.avg_p, r.std_p) for r in stats.consensus(df, ["a", "b", "c"], "p").collect()}
    assert out[1] == (None, None, None, None)
    assert out[4] == (2.0, 3.0, 3.0, 1.0)
    assert out[2] == (4.0, 4.0, 4.0, 1.33) and out[3][3] == 1.67  # mean * the others' deviation / mean


def test_row_statistics_and_rounding(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (2.0, None, None)], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    got = [tuple(r) for r in df.select(row_mean(cols), row_sum(cols), F.round(row_std(cols), 6)).collect()]
    assert got == [(2.0, 4.0, 1.414214), (None, 0.0, None), (2.0, 2.0, None)]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(half_even(F.col("x"), 0).alias("r"))
    assert col(halves, "r") == [0.0, 2.0, 2.0]


def test_safe_ratios_and_nan(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 2.0), (float("inf"), 1.0)], "a double, b double")
    assert col(df.select(ratio(F.col("b"), F.col("b") * 0).alias("x")), "x") == [None] * 3
    assert col(df.select(no_nan(F.col("a")).alias("x")), "x") == [1.0, None, None]


def test_text_cleaning(spark):
    raw = ["O'Neil Jr.", "Amon-Ra St. Brown", "John Smith III", "D.J. Moore", "old alias", None]
    df = spark.createDataFrame([(x,) for x in raw], "n string").select(clean_name(F.col("n"), {"Old Alias": "New Name"}).alias("n"))
    assert col(df, "n") == ["Oneil", "Amon Ra St Brown", "John Smith", "Dj Moore", "New Name", None]
    money = ["$68 ", "35", "", "55.70%", "-5.0%", "#DIV/0!", "UNK", "-"]
    out = spark.createDataFrame([(x,) for x in money], "v string").select(scrub(F.col("v")).alias("v"), clean_number(F.col("v")).alias("w"))
    assert col(out, "v") == [68.0, 35.0, None, 55.7, -5.0, None, None, None]
    assert col(spark.range(3).select(look_up(F.col("id").cast("int"), {0: "a", 1: "b"}, "z").alias("v")), "v") == ["a", "b", "z"]
    same = spark.createDataFrame([("abcd", "abcd"), ("abcd", "wxyz"), (None, "a")], "a string, b string").select(similarity(F.col("a"), F.col("b")).alias("s"))
    assert col(same, "s") == [1.0, 0.0, 0.0]


def test_history_covers_missing_cells(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 4.0), (1, 2, 10.0), (0, 3, 9.0)], "t int, y int, x double")
    out = {(r.t, r.y): r.m for r in stats.history_mean(df, "t", "y", "x", "m").collect()}
    assert out == {(0, 1): 3.0, (0, 2): 3.0, (0, 3): 5.0, (1, 1): None, (1, 2): 10.0, (1, 3): 10.0}


def test_history_of_the_first_periods_looks_ahead(spark):
    df = spark.createDataFrame([(0, 1, 10.0), (0, 2, 20.0), (0, 3, 60.0), (0, 4, 110.0), (1, 3, 7.0)], "t int, y int, x double")
    out = {(r.t, r.y): r.m for r in stats.history_mean(df, "t", "y", "x", "m", ahead=2).collect()}
    assert out == {(0, 1): 15.0, (0, 2): 30.0, (0, 3): 30.0, (0, 4): 50.0, (1, 1): None, (1, 2): 7.0, (1, 3): 7.0, (1, 4): 7.0}


def test_labels_with_fewer_rows_than_the_top(spark):
    df = spark.createDataFrame([(1, 9.0, 5.0, 10, 1), (1, 7.0, 7.0, 10, 2), (1, 3.0, 0.0, 2, 3)], "y int, pts double, proj double, games int, id int")
    out = {r.id: r.c for r in stats.over_performers(df, "y", "pts", "proj", "games", [F.desc("pts"), "id"], 10, 5, 0.5, 6, "c").collect()}
    assert out == {1: 1, 2: 0, 3: 0}


def test_clamp_order_and_slope_fill(spark):
    df = spark.createDataFrame([(10.0, -2.0, 12.0, 5.0)], "p double, s double, lo double, hi double")
    assert tuple(stats.clamp_interval(df, "p", "s", "lo", "hi").first()) == (10.0, 1.0, 8.5, 11.5)
    picks = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None)], "r int, pick double")
    assert col(stats.fill_by_slope(picks, "r", "pick", F.col("pick") < 250).orderBy("r"), "pick") == [2.0, 4.0, 6.0]


def test_slope_of_ranks_whose_squares_pass_an_int(spark):
    picks = spark.createDataFrame([(100_000, 50_000.0), (200_000, 100_000.0), (300_000, None)], "r int, pick double")
    assert col(stats.fill_by_slope(picks, "r", "pick", F.col("pick") < 250_000).orderBy("r"), "pick") == [50_000.0, 100_000.0, 150_000.0]


def test_data_dependent_columns_and_predicates(spark):
    df = spark.createDataFrame([(1, 7, None, "a"), (2, 7, 3, "a")], "i int, same int, x int, pos string")
    assert rel.drop_constant(df, ["pos"]).columns == ["i", "pos"]
    assert rel.drop_with_nulls(df).columns == ["i", "same", "pos"]
    assert col(rel.predicate(df, "x", "!=", 3), "i") == [1]
    with pytest.raises(ValueError):
        rel.predicate(df, "x", "; drop", 1)


def test_replace_keys_and_slice_upsert(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "v int, k string, y int")
    new = spark.createDataFrame([(9, "b", 1), (8, "c", 2)], "v int, k string, y int")
    assert sorted(col(rel.replace_keys(old, new, ["k"]), "v")) == [1, 8, 9]
    path = str(tmp_path / "t")
    tables.replace_slices(old, path, ["k"])
    tables.replace_slices(new, path, ["k"])
    assert sorted(col(spark.read.parquet(path), "v")) == [1, 8, 9]


def test_file_shapes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Player,Team,Team\nA,x,y\nB,z\nC,u,v,extra\n")
    rows = files.read_delimited(spark, str(tmp_path / "a.csv"), "player string, team string, team_2 string").collect()
    assert ("A", "x", "y") in [tuple(r) for r in rows]
    (tmp_path / "cr.csv").write_bytes(b"Ann,12\rBob,30\r")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "cr.csv"), "n string, s int", header=False, line_sep="\r").collect()] == [("Ann", 12), ("Bob", 30)]
    (tmp_path / "two.csv").write_text("Rush,,Pass\nYds,TD%,Yds\n1,2,3\n")
    two = files.read_two_row_header(spark, str(tmp_path / "two.csv"))
    assert two.columns == ["rush_yds", "rush_tdpct", "pass_yds"] and [tuple(r) for r in two.collect()] == [("1", "2", "3")]
    lines = ["Long Name One", "$", "12", "", "RB", "Long Name Two", "$", "7"]
    stream = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "f string, i int, x string")
    assert [(r["name"], r.amount) for r in files.names_and_amounts(stream, "f", "x", "i").orderBy("n").collect()] == [("Long Name One", 12.0), ("Long Name Two", 7.0)]
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "s_2019.csv").write_text("n\n5\n")
    assert [tuple(r) for r in files.read_years(spark, str(tmp_path / "y"), "n int").collect()] == [(5, 2019)]
    js = spark.createDataFrame([(1, '[{"k": 1}, {"k": 2}]'), (2, "no")], "i int, j string")
    assert [tuple(r) for r in files.records(js, "j", "k int").collect()] == [(1, 1), (1, 2)]
    files.write_csv(js, str(tmp_path / "out"), files=1)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_lineups_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(3)
    points, price, kind = rng.random(12), rng.integers(1, 9, 12), np.array(list("aaaabbbbcccc"))
    need, budget = {"a": 1, "b": 2, "c": 1}, 18
    got = simulate.best_lineup(points, price, kind, need, budget)
    every = (c for c in combinations(range(12), 4) if price[list(c)].sum() <= budget and all((kind[list(c)] == k).sum() == n for k, n in need.items()))
    assert points[got].sum() == pytest.approx(max(points[list(c)].sum() for c in every))
    assert simulate.best_lineup(points, price, kind, need, 0) == []


def test_draws_stay_in_bounds_and_repeat(spark):
    df = spark.createDataFrame([(1, 10.0, 2.0, 6.0, 12.0), (2, 5.0, 0.0, 1.0, 9.0)], "player long, mean double, sd double, low double, high double")
    a, b = (simulate.draws(df, "player", 500).toPandas() for _ in range(2))
    assert a.equals(b) and a[a.player == 1].points.between(6, 12).all() and (a[a.player == 2].points == 5).all()
    assert abs(a[a.player == 1].points.mean() - 9.6) < 0.4


def test_stream_equals_batch(spark, tmp_path):
    from tallyforge.streaming.rollup import rollup

    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) AS ts, concat('t', id % 3) AS event_type, double(id) AS value FROM range(96)")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = rollup(stream).writeStream.outputMode("complete").format("memory").queryName("rolled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, rollup(events).collect()))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.951, 1.0])
def test_quantile_is_exact_in_brackets(spark, q):
    for expr in ("double((id * 7919) % 3001)", "double(id % 3)", "double(5)", "CASE WHEN id % 2 = 0 THEN double(id) END"):
        df = spark.range(4000).selectExpr(f"{expr} AS x")
        want = df.agg(F.percentile("x", F.lit(q))).first()[0]
        assert stats.quantile(df, "x", q, few=50, accuracy=200) == pytest.approx(want)
    assert stats.quantile(spark.range(0).selectExpr("double(id) AS x"), "x", q) is None


def test_ranks_and_quantiles_by_runs(spark):
    df = spark.range(3000).selectExpr("id % 3 AS g", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 1.0 ELSE double((id * 7919) % 501) END AS x", "id")
    for descending in (False, True):
        got = {r.id: r.n for r in win.ranked(df, ["g"], "x", descending, [F.col("id")], "n", runs=8).collect()}
        order = [F.desc_nulls_last("x") if descending else F.asc_nulls_last("x"), F.col("id")]
        assert got == {r.id: r.n for r in win.number(df, ["g"], order, "n").collect()}
    want = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.percentile("x", F.lit(0.8)).alias("a"), F.percentile("x", F.lit(0.5)).alias("b")).collect()}
    assert {r.g: (pytest.approx(r.a), pytest.approx(r.b)) for r in stats.quantiles_by(df, ["g"], "x", {"a": 0.8, "b": 0.5}).collect()} == want


def test_lines_of_replacement_against_whole_windows(spark):
    df = spark.range(400).selectExpr("id % 4 AS g", "CASE WHEN id % 4 < 3 THEN 'a' ELSE 'b' END AS pos", "double((id * 31) % 97) AS pts", "id").where("g > 0 OR id < 12")
    rows = df.toPandas().sort_values(["pts", "id"], ascending=[False, True])
    out = win.over_replacements(df, ["g", "pos"], "pos", "pts", {"one": {"a": 5, "b": 90}, "two": {"a": 200}}, [F.desc("pts"), "id"]).toPandas().set_index("id")
    for (_, pos), t in rows.groupby(["g", "pos"]):
        for name, k in (("one", {"a": 5, "b": 90}[pos]), ("two", 200 if pos == "a" else None)):
            line = t.pts.iloc[min(k, len(t)) - 1] if k else None
            assert all(out.loc[r.id, name] == r.pts - line if k else np.isnan(out.loc[r.id, name]) for r in t.itertuples())
    left = win.after_top(df, ["g"], "pts", "id", 7).toPandas()
    assert set(left.id) == {i for _, t in rows.groupby("g") for i in t.id.iloc[7:]}


def test_titles_as_in_python(spark):
    raw = ["old 3rd mcx", "a.b c", "UPPER case", "", "x", "été (école) d9z", None]
    assert col(spark.createDataFrame([(x,) for x in raw], "n string").select(title(F.col("n")).alias("n")), "n") == [x and x.title() if x is not None else None for x in raw]


def test_similarity_as_a_multiset_of_signs(spark):
    from difflib import SequenceMatcher

    pairs = [("abcd", "bcde"), ("aab", "abb"), ("", ""), ("", "x"), ("night", "thing"), ("a.b*c", "c*b.a"), ("été", "ete")]
    got = col(spark.createDataFrame(pairs, "a string, b string").select(similarity(F.col("a"), F.col("b")).alias("s")), "s")
    assert got == pytest.approx([SequenceMatcher(None, a, b).quick_ratio() for a, b in pairs])


def test_delete_append_and_run_log(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.append(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "b")], "v int, k string"), path, ["k"])
    tables.append(spark.createDataFrame([(4, "c")], "v int, k string"), path, ["k"])
    tables.delete_where(spark, path, "v = 2 OR v = 4", ["k"])
    assert sorted(((r.v, r.k) for r in spark.read.parquet(path).collect()), key=str) == sorted([(1, "a"), (3, "b"), (None, "b")], key=str)
    tables.delete_where(spark, path, "v > 90", ["k"])
    assert spark.read.parquet(path).count() == 3
    log = f"file://{tmp_path}/log"
    assert [tables.log_run(spark, log, spark.createDataFrame([(x,)], "score double")) for x in (0.5, 0.7, 0.6)] == [1, 2, 3]
    assert sorted(col(tables.runs_between(spark, log, 2, 3), "score")) == [0.6, 0.7]
    with pytest.raises(Exception, match="CAST"):
        tables.replace(tables.typed(spark.createDataFrame([("x",)], "v string"), {"v": "int"}), path)


def test_names_after_a_join_and_lists_of_columns(spark):
    df = spark.createDataFrame([(1, "x", 2, "y")], "a int, b string, c int, d string").toDF("a", "b", "A", "b")
    assert rel.first_of_names(df).columns == ["a", "b"] and tuple(rel.first_of_names(df).first()) == (1, "x")
    assert rel.columns_to_fill("s_", ["x", "y", "z"], ["y"]) == ["s_x", "s_z"]


def test_monotone_and_smoothed_curves(spark):
    rng = np.random.default_rng(4)
    y = rng.random(9)
    fit = models.monotone(y, np.ones(9))
    assert (np.diff(fit) >= 0).all()
    best = min((np.square(np.repeat([np.mean(b) for b in np.split(y, cut)], [len(b) for b in np.split(y, cut)]) - y).sum() for cut in _cuts(9) if all(np.diff([np.mean(b) for b in np.split(y, cut)]) >= 0)))
    assert np.square(fit - y).sum() == pytest.approx(best)
    curve = spark.createDataFrame([(k, float(k * k)) for k in (1, 2, 3, 7)], "k int, v double")
    got = {r.k: r.s for r in models.smoothed(curve, "k", "v", 2, "s").collect()}
    w = lambda d: 1 - (d / 3) ** 3
    assert got[7] == 49 and got[1] == pytest.approx((1 + 4 * w(1) + 9 * w(2)) / (1 + w(1) + w(2)))


def _cuts(n):
    from itertools import combinations

    return (list(c) for k in range(n) for c in combinations(range(1, n), k))


def test_quantile_lines_leave_the_share_below(spark):
    df = spark.range(6000).selectExpr("id % 2 AS g", "double(id % 40) AS x", "double(id % 40) * 2 + pow((id * 7919) % 1000 / 1000D, 3) * 50 AS y")
    lines = quantile_regression.fit(df, ["x"], "y", ["g"], 0.8)
    below = (F.col("y") < F.col("tf_b")[0] * F.col("x") + F.col("tf_a")).cast("int")
    share = df.join(lines, "g").groupBy("g").agg(F.avg(below).alias("s"))
    assert all(abs(r.s - 0.8) < 0.002 for r in share.collect())


def test_spread_curves_take_the_bins_nearest_to_a_curve(spark):
    df = spark.range(1200).selectExpr("double(id) AS p", "(id * 7919 % 1000 - 500) * id / 1000D AS a")
    got = models.spread_curves(df, "p", "a", [4, 6]).toPandas()
    rows = df.toPandas().sort_values(["p", "a"]).reset_index(drop=True)
    for metric, f in (("sd", lambda v: v.std()), ("p99", lambda v: v.quantile(0.99)), ("p1", lambda v: v.quantile(0.01))):
        fits = {}
        for n in (4, 6):
            cells = rows.groupby(rows.index // -(-len(rows) // n)).a.apply(f).to_numpy()
            curve = models.monotone(cells, np.ones(len(cells)))
            fits[n] = (((curve - cells) ** 2).mean(), curve)
        n = min(fits, key=lambda n: (fits[n][0], n))
        mine = got[got.metric == metric].sort_values("bin")
        assert set(mine.bins) == {n} and mine.value.to_numpy() == pytest.approx(fits[n][1])


def test_stacked_models_are_out_of_fold(spark):
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    df = spark.range(300).selectExpr("id", "double(id % 17) AS x", "double(id % 17) * 3 + (id * 7919 % 100) / 100D AS y", "CAST(id % 3 AS INT) AS fold")
    out = models.stack(df, ["x"], "y", "fold", {"line": LinearRegression(), "tree": DecisionTreeRegressor(maxDepth=2)}, 3, 2).toPandas()
    pdf = df.toPandas()
    for k in range(3):
        train, test = pdf[pdf.fold != k], out[out.fold == k]
        slope, start = np.polyfit(train.x, train.y, 1)
        assert test.p_line.to_numpy() == pytest.approx(start + slope * test.x.to_numpy(), abs=1e-6)
    error = lambda c: ((out[c] - out.y) ** 2).mean()
    assert error("best_mean") <= min(error("p_line"), error("p_tree")) + 1e-9 and error("stacked") <= 1.05 * error("p_line")


def test_stacked_models_compute_their_rows_once(spark):
    times = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            times.add(b.num_rows)
            yield b

    rows = spark.range(90).selectExpr("id", "CAST(id % 3 AS INT) AS fold", "CAST(id AS DOUBLE) AS x", "CAST(id * 2 + id % 5 AS DOUBLE) AS y")
    out = models.stack(rows.mapInArrow(seen, rows.schema), ["x"], "y", "fold", {"line": LinearRegression(), "ridge": LinearRegression(regParam=0.3)}, 3, 2)
    assert out.count() == 90 and times.value == 90

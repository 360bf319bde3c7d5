"""Composite queries: scoring, roll-ups, consensus, labels, history, combination, strings, models and simulation."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import clean_name, clean_number, feet_inches, look_up, row_mean, scrub, weighted_sum
from tallyforge.functions.text import similarity
from tallyforge.operators import models, simulate, stats
from tallyforge.operators import relational as rel
from tallyforge.operators import windows as win
from tallyforge.plans.registry import query, table
from tallyforge.plans.season import SEASON_SQL, SOURCES_SQL, best, season, sources
from tallyforge.sources.files import records
from tallyforge.streaming.rollup import rollup

S = f"WITH {SEASON_SQL} "
Q = f"WITH {SOURCES_SQL} "
SCORE_SQL = "coalesce(l_quantity, 0) * 0.1 + coalesce(l_discount, 0) * 6 - coalesce(l_tax, 0) * 2 + CASE WHEN l_extendedprice >= 50000 THEN 3 WHEN l_extendedprice >= 30000 THEN 1 ELSE 0 END"


def score():
    bonus = F.when(F.col("l_extendedprice") >= 50000, 3).when(F.col("l_extendedprice") >= 30000, 1).otherwise(0)
    return weighted_sum({"l_quantity": 0.1, "l_discount": 6, "l_tax": -2}) + bonus


@query("bz1_scoring", f"SELECT l_orderkey, l_linenumber, round({SCORE_SQL}, 6) AS pts FROM lineitem")
def bz1(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score(), 6).alias("pts"))


@query("bz2_season_rollup", f"""WITH g AS (SELECT l_suppkey AS player, CAST(year(l_shipdate) AS INT) AS season, {SCORE_SQL} AS pts FROM lineitem),
x AS (SELECT player, season, sum(pts) AS s, avg(pts) AS m, max(pts) AS b, CAST(count(*) AS BIGINT) AS games FROM g GROUP BY ALL)
SELECT player, season + 1 AS yr, round(s, 4) AS sum_pts, round(m, 6) AS mean_pts, round(b, 6) AS max_pts, games, round(lead(m) OVER w, 6) AS y_act, lead(games) OVER w AS games_next
FROM x WINDOW w AS (PARTITION BY player ORDER BY season)""")  # fmt: skip
def bz2(spark, d):
    g = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("player"), F.year("l_shipdate").alias("season"), score().alias("pts"))
    x = g.groupBy("player", "season").agg(F.sum("pts").alias("s"), F.avg("pts").alias("m"), F.max("pts").alias("b"), F.count("*").alias("games"))
    w = Window.partitionBy("player").orderBy("season")
    return x.select(
        "player", (F.col("season") + 1).alias("yr"), F.round("s", 4).alias("sum_pts"), F.round("m", 6).alias("mean_pts"), F.round("b", 6).alias("max_pts"), "games",
        F.round(F.lead("m").over(w), 6).alias("y_act"), F.lead("games").over(w).alias("games_next"),
    )


@query("bz3_team_totals", S + "SELECT team, yr, round(sum(pts), 2) AS team_sum_pts, round(avg(pts), 6) AS team_mean_pts, CAST(sum(games) AS BIGINT) AS team_sum_games FROM season GROUP BY team, yr")
def bz3(spark, d):
    return season(spark, d).groupBy("team", "yr").agg(F.round(F.sum("pts"), 2).alias("team_sum_pts"), F.round(F.avg("pts"), 6).alias("team_mean_pts"), F.sum("games").alias("team_sum_games"))


@query("bz4_consensus_fill", Q + """, m AS (SELECT part, s1, s2, s3, (coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / nullif((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT, 0) AS a FROM sources),
f AS (SELECT part, a, coalesce(s1, a) AS s1, coalesce(s2, a) AS s2, coalesce(s3, a) AS s3 FROM m),
t AS (SELECT *, sqrt((pow(s1 - (s1 + s2 + s3) / 3, 2) + pow(s2 - (s1 + s2 + s3) / 3, 2) + pow(s3 - (s1 + s2 + s3) / 3, 2)) / 2) AS sd FROM f),
c AS (SELECT avg(CASE WHEN sd > 1e-9 THEN sd / a END) AS cv FROM t)
SELECT part, round(a, 7) AS avg_price, round(CASE WHEN sd <= 1e-9 THEN a * cv ELSE sd END, 7) AS std_price FROM t, c""")  # fmt: skip
def bz4(spark, d):
    return stats.consensus(sources(spark, d), ["s1", "s2", "s3"], "price", digits=7).select("part", "avg_price", "std_price")


@query("bz5_pick_imputation", S + """, x AS (SELECT *, rank() OVER (PARTITION BY yr, pos ORDER BY pts DESC) AS r, CASE WHEN player % 6 = 0 THEN NULL ELSE pts / 1000 END AS pick FROM season),
b AS (SELECT sum(r * pick) / sum(r * r) AS b FROM x WHERE pick < 250)
SELECT player, yr, round(ln(coalesce(pick, CASE WHEN b * r < 0 THEN 2 * r ELSE b * r END) + 1), 6) AS log_pick FROM x, b""")  # fmt: skip
def bz5(spark, d):
    df = win.rank_min(season(spark, d), ["yr", "pos"], "pts", "r").withColumn("pick", F.when(F.col("player") % 6 != 0, F.col("pts") / 1000))
    return stats.fill_by_slope(df, "r", "pick", F.col("pick") < 250).select("player", "yr", F.round(F.log(F.col("pick") + 1), 6).alias("log_pick"))


@query("bz7_team_projection", S + """, x AS (SELECT *, row_number() OVER (PARTITION BY team, yr, pos ORDER BY pts DESC, player) AS rn FROM season), y AS (SELECT * FROM x WHERE rn <= 3),
u AS (SELECT team, yr, pos AS grp, pts FROM y UNION ALL SELECT team, yr, 'BUILDING' AS grp, pts FROM y WHERE pos = 'FURNITURE')
SELECT team, yr, grp, round(sum(pts), 2) AS pts, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY ALL""")  # fmt: skip
def bz7(spark, d):
    top = win.number(season(spark, d), ["team", "yr", "pos"], best(), "rn").where("rn <= 3")
    groups = F.when(F.col("pos") == "FURNITURE", F.array(F.lit("FURNITURE"), F.lit("BUILDING"))).otherwise(F.array("pos"))
    return top.withColumn("grp", F.explode(groups)).groupBy("team", "yr", "grp").agg(F.round(F.sum("pts"), 2).alias("pts"), F.count("*").alias("n"))


@query("bz8_share_and_rolling", S + ", x AS (SELECT player, yr, pts / (sum(pts) OVER (PARTITION BY team, yr) + 3) AS share FROM season) SELECT player, yr, round(share, 8) AS share, round(avg(share) OVER (PARTITION BY player ORDER BY yr ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 8) AS share3 FROM x")
def bz8(spark, d):
    df = win.rolling(win.share(season(spark, d), ["team", "yr"], "pts", 3, "share"), ["player"], ["yr"], ["share"], 3, "mean")
    return df.select("player", "yr", F.round("share", 8).alias("share"), F.round("share_r3_mean", 8).alias("share3"))


@query("bz9_best_of_team", S + ", b AS (SELECT team, yr, player AS qb_player, pts AS qb_pts FROM (SELECT *, row_number() OVER (PARTITION BY team, yr ORDER BY pts DESC, player) AS rn FROM season WHERE pos = 'BUILDING') WHERE rn = 1) SELECT player, s.yr, qb_player, qb_pts FROM season s LEFT JOIN b ON s.team = b.team AND s.yr = b.yr")
def bz9(spark, d):
    df = season(spark, d)
    leader = rel.prefixed(win.keep_first(df.where("pos = 'BUILDING'"), ["team", "yr"], best()).select("team", "yr", "player", "pts"), "qb_", ["team", "yr"])
    return df.join(leader, ["team", "yr"], "left").select("player", "yr", "qb_player", "qb_pts")


@query("bz10_year_over_year", S + ", t AS (SELECT team, yr, max(pts) AS best FROM season GROUP BY ALL), l AS (SELECT team, yr, best, coalesce(lag(best) OVER (PARTITION BY team ORDER BY yr), best) AS last_best FROM t) SELECT player, s.yr, round(best - last_best, 2) AS change FROM season s LEFT JOIN l ON s.team = l.team AND s.yr = l.yr")
def bz10(spark, d):
    df = season(spark, d)
    top = df.groupBy("team", "yr").agg(F.max("pts").alias("best"))
    last = top.withColumn("last_best", F.coalesce(F.lag("best").over(Window.partitionBy("team").orderBy("yr")), "best"))
    return df.join(last, ["team", "yr"], "left").select("player", "yr", F.round(F.col("best") - F.col("last_best"), 2).alias("change"))


@query("ag26_history_by_experience", S + """, x AS (SELECT yr - min(yr) OVER (PARTITION BY player) AS tenure, yr, pts FROM season), t AS (SELECT DISTINCT tenure FROM x), y AS (SELECT DISTINCT yr FROM x)
SELECT CAST(t.tenure AS INT) AS tenure, y.yr, round((SELECT avg(pts) FROM x WHERE x.tenure = t.tenure AND x.yr <= y.yr + CAST(y.yr <= (SELECT min(yr) FROM y WHERE yr > (SELECT min(yr) FROM y)) AS INT)), 3) AS mean FROM t, y""")  # fmt: skip
def ag26(spark, d):
    df = season(spark, d).withColumn("tenure", F.col("yr") - F.min("yr").over(Window.partitionBy("player")))
    return stats.history_mean(df, "tenure", "yr", "pts", "mean", ahead=2).withColumn("mean", F.round("mean", 3))


@query("bz12_class_label", S + """, x AS (SELECT *, pts - 150000 * games AS gap, row_number() OVER (PARTITION BY yr ORDER BY pts DESC, player) AS rn FROM season), t AS (SELECT * FROM x WHERE rn <= 100),
q AS (SELECT yr, quantile_cont(gap, 0.7) AS g, max(CASE WHEN rn = least(60, n) THEN pts END) AS line FROM (SELECT *, count(*) OVER (PARTITION BY yr) AS n FROM t) GROUP BY yr)
SELECT player, t.yr, CAST(gap >= g AND pts >= line AND games > 3 AS INT) AS y_act_class FROM t JOIN q ON t.yr = q.yr""")  # fmt: skip
def bz12(spark, d):
    df = season(spark, d).withColumn("proj", 150000 * F.col("games"))
    return stats.over_performers(df, "yr", "pts", "proj", "games", best(), 100, 60, 0.7, 3, "y_act_class").select("player", "yr", "y_act_class")


@query("bz13_next_year_target", S + "SELECT b.player, b.yr, b.pts, a.pts AS y_next FROM season a RIGHT JOIN season b ON a.player = b.player AND a.yr - 1 = b.yr")
def bz13(spark, d):
    df = season(spark, d).select("player", "yr", "pts")
    return df.select("player", (F.col("yr") - 1).alias("yr"), F.col("pts").alias("y_next")).join(df, ["player", "yr"], "right")


@query("bz14_validation_compare", S + ", two AS (SELECT team, yr, sum(a) AS pred FROM (SELECT team, yr, pos, avg(pts) AS a FROM season GROUP BY ALL) GROUP BY ALL), one AS (SELECT team, yr, avg(pts) * 5 AS pred2 FROM season GROUP BY ALL) SELECT yr, round(sqrt(avg(pow(pred - pred2, 2))), 2) AS rmse, round(corr(pred, pred2), 6) AS r FROM two JOIN one USING (team, yr) GROUP BY yr")
def bz14(spark, d):
    df = season(spark, d)
    two = df.groupBy("team", "yr", "pos").agg(F.avg("pts").alias("a")).groupBy("team", "yr").agg(F.sum("a").alias("pred"))
    both = two.join(df.groupBy("team", "yr").agg((F.avg("pts") * 5).alias("pred2")), ["team", "yr"])
    gap = F.col("pred") - F.col("pred2")
    return both.groupBy("yr").agg(F.round(F.sqrt(F.avg(gap * gap)), 2).alias("rmse"), F.round(F.corr("pred", "pred2"), 6).alias("r"))


@query("bz15_tail_ratio", S + "SELECT pos, round((quantile_cont(CASE WHEN games <= 2 THEN pts END, 0.9) / quantile_cont(CASE WHEN games > 2 THEN pts END, 0.9) + quantile_cont(CASE WHEN games <= 2 THEN pts END, 0.95) / quantile_cont(CASE WHEN games > 2 THEN pts END, 0.95)) / 2, 6) AS ratio FROM season GROUP BY pos")
def bz15(spark, d):
    df = season(spark, d).select("pos", F.when(F.col("games") <= 2, F.col("pts")).alias("few"), F.when(F.col("games") > 2, F.col("pts")).alias("many"))
    few = stats.quantiles_by(df, ["pos"], "few", {"f90": 0.9, "f95": 0.95})
    many = stats.quantiles_by(df, ["pos"], "many", {"m90": 0.9, "m95": 0.95})
    return few.join(many, "pos").select("pos", F.round((F.col("f90") / F.col("m90") + F.col("f95") / F.col("m95")) / 2, 6).alias("ratio"))


BZ16 = """, u AS (SELECT player, yr, pts AS pred, CAST(games - 3 AS DOUBLE) AS sd, pts * 0.9 AS hi, pts * 1.1 AS lo FROM season UNION ALL SELECT player, yr, pts * 1.2, CAST(2 AS DOUBLE), pts * 1.5, pts * 0.5 FROM season WHERE games > 2),
a AS (SELECT player, yr, pred, CASE WHEN sd < 0 THEN 1 ELSE sd END AS sd, hi, lo FROM u),
b AS (SELECT player, yr, pred, sd, CASE WHEN hi < pred THEN pred + 1.5 * sd ELSE hi END AS hi, CASE WHEN lo > pred THEN pred - 1.5 * sd ELSE lo END AS lo FROM a)
"""


@query("bz16_final_combine", S + BZ16 + "SELECT player, yr, pred, sd, hi, lo FROM (SELECT player, yr, round(avg(pred), 7) AS pred, round(avg(sd), 6) AS sd, round(avg(hi), 7) AS hi, round(avg(lo), 7) AS lo, row_number() OVER (PARTITION BY yr ORDER BY round(avg(pred), 7) DESC, player) AS rn FROM b GROUP BY player, yr) WHERE rn <= 200")
def bz16(spark, d):
    df, c = season(spark, d), F.col("pts")
    one = df.select("player", "yr", c.alias("pred"), (F.col("games") - 3.0).alias("sd"), (c * 0.9).alias("hi"), (c * 1.1).alias("lo"))
    two = df.where("games > 2").select("player", "yr", (c * 1.2).alias("pred"), F.lit(2.0).alias("sd"), (c * 1.5).alias("hi"), (c * 0.5).alias("lo"))
    both = stats.clamp_interval(rel.union_all([one, two]), "pred", "sd", "lo", "hi")
    mean = both.groupBy("player", "yr").agg(*(F.round(F.avg(x), 6 if x == "sd" else 7).alias(x) for x in ("pred", "sd", "hi", "lo")))
    return win.number(mean, ["yr"], [F.desc("pred"), F.col("player")], "rn").where("rn <= 200").drop("rn")


@query("upd5_clamp_chain", S + BZ16 + "SELECT player, yr, round(pred, 3) AS pred, sd, round(hi, 3) AS hi, round(lo, 3) AS lo FROM b WHERE sd <> 2 OR hi < pred * 1.2")
def upd5(spark, d):
    c = F.col("pts")
    kind = lambda pred, sd, hi, lo: F.struct(pred.alias("pred"), sd.alias("sd"), hi.alias("hi"), lo.alias("lo"))
    both = F.array(kind(c, F.col("games") - 3.0, c * 0.9, c * 1.1), F.when(F.col("games") > 2, kind(c * 1.2, F.lit(2.0), c * 1.5, c * 0.5)))
    one = season(spark, d).select("player", "yr", F.inline(F.filter(both, lambda x: x.isNotNull())))
    out = stats.clamp_interval(one, "pred", "sd", "lo", "hi").where((F.col("sd") != 2) | (F.col("hi") < F.col("pred") * 1.2))
    return out.select("player", "yr", F.round("pred", 3).alias("pred"), "sd", F.round("hi", 3).alias("hi"), F.round("lo", 3).alias("lo"))


@query("bz17_keeper_inflation", S + ", k AS (SELECT yr, 1 + sum(pts / 100000) / 3600 AS inflation FROM season WHERE player % 50 = 0 GROUP BY yr) SELECT player, s.yr, round(pts * coalesce(inflation, 1), 3) AS price FROM season s LEFT JOIN k ON s.yr = k.yr")
def bz17(spark, d):
    df = season(spark, d)
    k = df.where("player % 50 = 0").groupBy("yr").agg((1 + F.sum(F.col("pts") / 100000) / 3600).alias("inflation"))
    return df.join(F.broadcast(k), "yr", "left").select("player", "yr", F.round(F.col("pts") * F.coalesce("inflation", F.lit(1.0)), 3).alias("price"))


@query("bz18_pick_curve", S + ", x AS (SELECT yr, row_number() OVER (PARTITION BY yr ORDER BY pts DESC, player) AS slot, pts FROM season), m AS (SELECT slot, median(pts) AS med FROM x WHERE slot <= 300 GROUP BY slot) SELECT CAST(slot AS INT) AS slot, round(min(med) OVER (ORDER BY slot), 3) AS value FROM m")
def bz18(spark, d):
    """At most 300 slots: the curve's running minimum is one small window."""
    x = win.number(season(spark, d), ["yr"], best(), "slot").where("slot <= 300")
    med = x.groupBy("slot").agg(F.median("pts").alias("med")).withColumn("curve", F.lit(1))
    return win.running(med, ["curve"], [F.col("slot")], "med", "min", "value").select("slot", F.round("value", 3).alias("value"))


@query("bz19_vor_board", S + """, n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY yr, pos) AS n FROM season WINDOW w AS (PARTITION BY yr, pos ORDER BY pts DESC, player)),
v AS (SELECT player, yr, pts - max(CASE WHEN rn = least(12, n) THEN pts END) OVER p AS v1, pts - max(CASE WHEN rn = least(28, n) THEN pts END) OVER p AS v2, pts - max(CASE WHEN rn = least(44, n) THEN pts END) OVER p AS v3 FROM n WINDOW p AS (PARTITION BY yr, pos))
SELECT player, yr, round((v1 * 5 + v2 + v3) / 3, 3) AS board FROM v""")  # fmt: skip
def bz19(spark, d):
    kinds = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]
    boards = {name: dict.fromkeys(kinds, k) for name, k in (("v1", 12), ("v2", 28), ("v3", 44))}
    df = win.over_replacements(season(spark, d), ["yr", "pos"], "pos", "pts", boards, best())
    return df.select("player", "yr", F.round(row_mean([F.col("v1") * 5, F.col("v2"), F.col("v3")]), 3).alias("board"))


@query("bz20_derived_range", S + ", a AS (SELECT player, avg(pts) AS p FROM season GROUP BY player), b AS (SELECT player, avg(pts) AS q, min(pts) AS lo, max(pts) AS hi FROM season WHERE yr > 1997 GROUP BY player) SELECT player, round(lo / q * p, 6) AS min_pick, round(hi / q * p, 6) AS max_pick, round((hi - lo) / 5, 3) AS sd FROM a JOIN b USING (player)")
def bz20(spark, d):
    df, c = season(spark, d), F.col
    a = df.groupBy("player").agg(F.avg("pts").alias("p"))
    b = df.where("yr > 1997").groupBy("player").agg(F.avg("pts").alias("q"), F.min("pts").alias("lo"), F.max("pts").alias("hi"))
    return a.join(b, "player").select("player", F.round(c("lo") / c("q") * c("p"), 6).alias("min_pick"), F.round(c("hi") / c("q") * c("p"), 6).alias("max_pick"), F.round((c("hi") - c("lo")) / 5, 3).alias("sd"))


@query("bz22_capital_by_team", S + "SELECT team, coalesce(round(sum(CASE WHEN pos = 'BUILDING' THEN pts END), 2), 0) AS BUILDING_sum, coalesce(max(CASE WHEN pos = 'BUILDING' THEN pts END), 0) AS BUILDING_max, coalesce(round(sum(CASE WHEN pos = 'FURNITURE' THEN pts END), 2), 0) AS FURNITURE_sum, coalesce(max(CASE WHEN pos = 'FURNITURE' THEN pts END), 0) AS FURNITURE_max FROM season GROUP BY team")
def bz22(spark, d):
    return season(spark, d).groupBy("team").pivot("pos", ["BUILDING", "FURNITURE"]).agg(F.round(F.sum("pts"), 2).alias("sum"), F.max("pts").alias("max")).fillna(0.0)


@query("bz23_dominator", S + ", x AS (SELECT player, yr, pts / sum(pts) OVER w AS a, games / sum(games) OVER w AS b FROM season WINDOW w AS (PARTITION BY team, yr)) SELECT player, round(avg((a + b) / 2), 8) AS dominator, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY player")
def bz23(spark, d):
    df = win.with_totals(season(spark, d), ["team", "yr"], {"all_pts": F.sum("pts"), "all_games": F.sum("games")})
    x = df.select("player", (F.col("pts") / F.col("all_pts")).alias("a"), (F.col("games") / F.col("all_games")).alias("b"))
    return x.groupBy("player").agg(F.round(F.avg((F.col("a") + F.col("b")) / 2), 8).alias("dominator"), F.count("*").alias("n"))


@query("bz25_weighted_opportunity", "SELECT l_suppkey, round(sum(l_quantity) / nullif(sum(l_linenumber), 0), 6) AS per_line, round(1.5 * sum(l_quantity) / 100 + 0.7 * sum(l_tax), 4) AS wopr FROM lineitem GROUP BY l_suppkey")
def bz25(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.try_divide(F.sum("l_quantity"), F.sum("l_linenumber")), 6).alias("per_line"), F.round(1.5 * F.sum("l_quantity") / 100 + 0.7 * F.sum("l_tax"), 4).alias("wopr"))


@query("bz26_available_opportunity", S + ", x AS (SELECT team, yr, sum(CASE WHEN games > 2 THEN pts ELSE 0 END) AS used, sum(pts) AS total FROM season GROUP BY ALL) SELECT team, yr, round(1 - used / total, 8) AS available FROM x")
def bz26(spark, d):
    x = season(spark, d).groupBy("team", "yr").agg(F.sum(F.when(F.col("games") > 2, F.col("pts")).otherwise(0)).alias("used"), F.sum("pts").alias("total"))
    return x.select("team", "yr", F.round(1 - F.try_divide("used", "total"), 8).alias("available"))


@query("bz27_missed_games", S + "SELECT player, yr, CAST(sum(6 - games) OVER (PARTITION BY player ORDER BY yr ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS missed3, lead(6 - games) OVER (PARTITION BY player ORDER BY yr) AS missed_next FROM season")
def bz27(spark, d):
    df = season(spark, d).withColumn("missed", 6 - F.col("games"))
    df = win.rolling(df, ["player"], ["yr"], ["missed"], 3, "sum")
    return df.select("player", "yr", F.col("missed_r3_sum").alias("missed3"), F.lead("missed").over(Window.partitionBy("player").orderBy("yr")).alias("missed_next"))


@query("bz30_budget_rescale", S + ", r AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY pts DESC, player) AS rn FROM season), o AS (SELECT yr, 3600 - sum(pts / 5000) AS off FROM r WHERE rn <= 156 GROUP BY yr) SELECT player, season.yr, CAST(trunc(pts / 5000 * (1 + off / 3600)) AS INT) AS salary FROM season JOIN o ON season.yr = o.yr")
def bz30(spark, d):
    df = season(spark, d)
    off = win.number(df, ["yr"], best(), "rn").where("rn <= 156").groupBy("yr").agg((3600 - F.sum(F.col("pts") / 5000)).alias("off"))
    return df.join(F.broadcast(off), "yr").select("player", "yr", (F.col("pts") / 5000 * (1 + F.col("off") / 3600)).cast("int").alias("salary"))


@query("bz32_dictionary_encode", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS code FROM customer")
def bz32(spark, d):
    c = table(spark, d, "customer")
    codes = c.select("c_mktsegment").distinct().withColumn("code", (F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1).cast("int"))  # a few values
    return c.join(codes, "c_mktsegment").select("c_custkey", "code")


@query("bz36_missing_pick", S + "SELECT player, yr, round(least(coalesce(CASE WHEN player % 3 = 0 THEN NULL ELSE pts / 1000 END, 250), 250), 5) AS pick, round(ln(least(coalesce(CASE WHEN player % 3 = 0 THEN NULL ELSE pts / 1000 END, 250), 250)), 6) AS log_pick FROM season")
def bz36(spark, d):
    pick = F.least(F.coalesce(F.when(F.col("player") % 3 != 0, F.col("pts") / 1000), F.lit(250.0)), F.lit(250.0))
    return season(spark, d).select("player", "yr", F.round(pick, 5).alias("pick"), F.round(F.log(pick), 6).alias("log_pick"))


@query("bz37_career_start", S + ", n AS (SELECT team, pos, min(yr) AS start, count(*) OVER (PARTITION BY team) AS k FROM season GROUP BY team, pos) SELECT player, yr, round(pts * exp(-(yr - start)), 4) AS value FROM season JOIN n USING (team, pos)")
def bz37(spark, d):
    df = season(spark, d)
    start = df.groupBy("team", "pos").agg(F.min("yr").alias("start"))
    return df.join(start, ["team", "pos"]).select("player", "yr", F.round(F.col("pts") * F.exp(-(F.col("yr") - F.col("start"))), 4).alias("value"))


@query("bz39_synthetic_player", S + "SELECT player, yr, pts FROM season WHERE player <> 1 UNION ALL SELECT CAST(1 AS BIGINT), CAST(2001 AS INT), round(avg(pts) * 0.8, 4) FROM season WHERE pos = 'BUILDING' AND yr = 2000")
def bz39(spark, d):
    df = season(spark, d).select("player", "yr", "pts", "pos")
    made = df.where("pos = 'BUILDING' AND yr = 2000").agg(F.round(F.avg("pts") * 0.8, 4).alias("pts")).select(F.lit(1).cast("long").alias("player"), F.lit(2001).alias("yr"), "pts")
    return rel.replace_keys(df.drop("pos"), made, ["player"])


@query("bz40_refresh_values", S + ", old AS (SELECT player, pts FROM season WHERE yr = 2000), new AS (SELECT player, pts FROM season WHERE yr = 2001) SELECT old.player, coalesce(new.pts, old.pts) AS pts FROM old LEFT JOIN new ON old.player = new.player")
def bz40(spark, d):
    df = season(spark, d)
    old, new = df.where("yr = 2000").select("player", "pts"), df.where("yr = 2001").select("player", F.col("pts").alias("fresh"))
    return old.join(new, "player", "left").select("player", F.coalesce("fresh", "pts").alias("pts"))


@query("bz42_score_weighted", S + ", m AS (SELECT pos AS model, yr, avg(pts) AS pred, median(pts) AS score FROM season GROUP BY ALL), w AS (SELECT *, score - min(score) OVER (PARTITION BY yr) + 1 AS s FROM m), k AS (SELECT *, max(s) OVER (PARTITION BY yr) AS best FROM w) SELECT yr, round(sum(pred * s) / sum(s), 3) AS pred, CAST(count(*) AS BIGINT) AS models FROM k WHERE s >= 0.3 * best GROUP BY yr")
def bz42(spark, d):
    df = season(spark, d)
    score = stats.quantiles_by(df, ["pos", "yr"], "pts", {"score": 0.5})
    m = df.groupBy("pos", "yr").agg(F.avg("pts").alias("pred")).join(score, ["pos", "yr"])
    w = Window.partitionBy("yr")
    k = m.withColumn("s", F.col("score") - F.min("score").over(w) + 1).withColumn("best", F.max("s").over(w)).where("s >= 0.3 * best")
    return k.groupBy("yr").agg(F.round(F.sum(F.col("pred") * F.col("s")) / F.sum("s"), 3).alias("pred"), F.count("*").alias("models"))


@query("bz43_interval_miss_rate", S + ", q AS (SELECT team, quantile_cont(pts, 0.2) AS lo, quantile_cont(pts, 0.8) AS hi FROM season WHERE yr < 2000 GROUP BY team) SELECT s.team, round(avg((pts < lo)::INT), 6) AS below, round(avg((pts > hi)::INT), 6) AS above FROM season s JOIN q ON s.team = q.team WHERE yr >= 2000 GROUP BY s.team")
def bz43(spark, d):
    df = season(spark, d)
    q = stats.quantiles_by(df.where("yr < 2000"), ["team"], "pts", {"lo": 0.2, "hi": 0.8})
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return df.where("yr >= 2000").join(q, "team").groupBy("team").agg(rate(F.col("pts") < F.col("lo")).alias("below"), rate(F.col("pts") > F.col("hi")).alias("above"))


@query("bz44_z_composite", S + "SELECT player, yr, round(((pts - avg(pts) OVER w) / stddev_pop(pts) OVER w * 2 + (games - avg(games) OVER w) / stddev_pop(games) OVER w) / 2, 6) AS z FROM season WINDOW w AS (PARTITION BY team, yr)")
def bz44(spark, d):
    cols = ("pts", "games")
    df = win.with_totals(season(spark, d), ["team", "yr"], {f"m_{c}": F.avg(c) for c in cols} | {f"sd_{c}": F.stddev_pop(c) for c in cols})
    z = lambda c: F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"sd_{c}"))
    return df.select("player", "yr", F.round((z("pts") * 2 + z("games")) / 2, 6).alias("z"))


@query("bz46_curve_slice", S + ", m AS (SELECT pos, median(pts) AS v FROM season WHERE yr = 2001 GROUP BY pos) SELECT team, pos, coalesce(max(CASE WHEN yr = 2001 THEN pts END), (SELECT min(v) FROM m)) AS value FROM season GROUP BY team, pos")
def bz46(spark, d):
    df = season(spark, d)
    least = stats.quantiles_by(df.where("yr = 2001"), ["pos"], "pts", {"v": 0.5}).agg(F.min("v").alias("least"))  # one row
    best = df.groupBy("team", "pos").agg(F.max(F.when(F.col("yr") == 2001, F.col("pts"))).alias("best"))
    return best.join(F.broadcast(least)).select("team", "pos", F.coalesce("best", "least").alias("value"))


@query("bz48_top_quartile", S + "SELECT player, yr, pts FROM season WHERE pts >= (SELECT quantile_cont(pts, 0.75) FROM season)")
def bz48(spark, d):
    df = season(spark, d)
    line = stats.quantile(df, "pts", 0.75)
    return df.where(F.col("pts") >= F.lit(line)).select("player", "yr", "pts")


@query("str1_name_clean", "SELECT c_custkey, trim(replace(replace(replace(replace(c_name, '#', ' '), '.', ''), '000', ''), '-', ' ')) AS name FROM customer")
def str1(spark, d):
    return table(spark, d, "customer").select("c_custkey", clean_name(F.replace(F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")), F.lit("000"), F.lit(""))).alias("name"))


@query("str3_split_tokens", "SELECT p_partkey, split_part(p_type, ' ', 1) AS first, split_part(p_type, ' ', -1) AS last, left(p_brand, 2) AS two, TRY_CAST(substr(p_brand, 7) AS INT) AS num FROM part")
def str3(spark, d):
    t = F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", F.try_element_at(t, F.lit(1)).alias("first"), F.try_element_at(t, F.lit(-1)).alias("last"), F.left("p_brand", F.lit(2)).alias("two"), F.expr("substr(p_brand, 7)").try_cast("int").alias("num"))


@query("str7_money_and_percent", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS price, CAST(p_size AS DOUBLE) / 2 AS pct FROM part")
def str7(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.concat(F.lit("$"), "p_size", F.lit(" ")).alias("a"), F.concat(F.col("p_size") / 2, F.lit("%")).alias("b"))
    return df.select("p_partkey", clean_number(F.col("a")).alias("price"), clean_number(F.col("b")).alias("pct"))


@query("str8_feet_inches", "SELECT p_partkey, CAST((p_size // 12) * 12 + p_size % 12 AS INT) AS inches FROM part")
def str8(spark, d):
    return table(spark, d, "part").select("p_partkey", feet_inches(F.concat_ws("-", F.floor(F.col("p_size") / 12), F.col("p_size") % 12)).alias("inches"))


@query("str12_missing_tokens", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS v FROM part")
def str12(spark, d):
    raw = F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("string")).otherwise(F.element_at(F.array(*map(F.lit, ("-", "#DIV/0!", "UNK"))), F.col("p_size") % 3 + 1))
    return table(spark, d, "part").select("p_partkey", scrub(raw).alias("v"))


@query("dt1_age", "SELECT o_orderkey, round(date_diff('day', CAST(o_orderdate AS DATE), make_date(year(o_orderdate), 9, 1)) / 365, 6) AS age, strftime(o_orderdate, '%m-%d-%Y %H:%M') AS stamp FROM orders")
def dt1(spark, d):
    date = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.datediff(F.make_date(F.year(date), F.lit(9), F.lit(1)), date.cast("date")) / 365, 6).alias("age"), F.date_format(date, "MM-dd-yyyy HH:mm").alias("stamp"))


@query("ma10_decay", "SELECT o_orderkey, round(o_totalprice * exp(-(2001 - year(o_orderdate))), 4) AS decayed, round(ln(o_totalprice + 1), 6) AS log_price, round(least(greatest(o_totalprice, 50000), 200000), 2) AS clipped FROM orders")
def ma10(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(p * F.exp(-(2001 - F.year("o_orderdate"))), 4).alias("decayed"), F.round(F.log(p + 1), 6).alias("log_price"), F.round(F.least(F.greatest(p, F.lit(50000.0)), F.lit(200000.0)), 2).alias("clipped"))


@query("ma12_per_game", S + "SELECT player, yr, round(pts / CASE WHEN yr > 1998 THEN 16 ELSE 15 END, 9) AS per_game FROM season")
def ma12(spark, d):
    return season(spark, d).select("player", "yr", F.round(F.col("pts") / F.when(F.col("yr") > 1998, 16).otherwise(15), 9).alias("per_game"))


@query("js1_json_records", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def js1(spark, d):
    df = table(spark, d, "events").select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("doc"))
    return records(df, "doc", "k int")


@query("ar1_percentile_of_list", S + "SELECT player, round(quantile_cont(pts, 0.8), 3) AS p80, CAST(count(*) AS BIGINT) AS n FROM season GROUP BY player")
def ar1(spark, d):
    return season(spark, d).groupBy("player").agg(F.round(F.percentile("pts", F.lit(0.8)), 3).alias("p80"), F.size(F.collect_list("pts")).cast("long").alias("n"))


@query("mp1_map_default", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'other' END AS zone FROM nation")
def mp1(spark, d):
    return table(spark, d, "nation").select("n_nationkey", look_up(F.col("n_regionkey"), {0: "a", 1: "b"}, "other").alias("zone"))


@query("ml1_baseline_slope", S + "SELECT pos, round(regr_slope(pts, games), 4) AS slope, round(regr_intercept(pts, games), 4) AS intercept FROM season GROUP BY pos")
def ml1(spark, d):
    return season(spark, d).groupBy("pos").agg(F.round(F.regr_slope("pts", "games"), 4).alias("slope"), F.round(F.regr_intercept("pts", "games"), 4).alias("intercept"))


ML9_SQL = S + """, y AS (SELECT yr, count(*) AS n, sum(games) AS x, sum(pts) AS y, sum(games * pts) AS xy, sum(games * games) AS xx FROM season GROUP BY yr),
c AS (SELECT yr, sum(n) OVER w AS n, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(xy) OVER w AS xy, sum(xx) OVER w AS xx FROM y WINDOW w AS (ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT yr, (n * xy - x * y) / (n * xx - x * x) AS slope, (y - (n * xy - x * y) / (n * xx - x * x) * x) / n AS intercept FROM c WHERE n IS NOT NULL)
SELECT yr, round(sqrt(avg(pow(pts - intercept - slope * games, 2))), 2) AS rmse, CAST(count(*) AS BIGINT) AS n FROM season JOIN b USING (yr) GROUP BY yr"""  # fmt: skip


@query("ml9_expanding_validation", ML9_SQL)
def ml9(spark, d):
    """Train before each year, test in it: the fit comes from running sums over years, not from a loop of fits."""
    df, c = season(spark, d), F.col
    y = df.groupBy("yr").agg(F.count("*").cast("double").alias("n"), F.sum("games").cast("double").alias("x"), F.sum("pts").alias("y"), F.sum(c("games") * c("pts")).alias("xy"), F.sum(c("games") * c("games")).cast("double").alias("xx"))
    w = Window.orderBy("yr").rowsBetween(Window.unboundedPreceding, -1)  # one row per year
    s = y.select("yr", *(F.sum(k).over(w).alias(k) for k in ("n", "x", "y", "xy", "xx"))).where("n IS NOT NULL")
    s = s.withColumn("slope", F.try_divide(c("n") * c("xy") - c("x") * c("y"), c("n") * c("xx") - c("x") * c("x")))
    s = s.select("yr", "slope", ((c("y") - c("slope") * c("x")) / c("n")).alias("intercept"))
    error = c("pts") - c("intercept") - c("slope") * c("games")
    return df.join(F.broadcast(s), "yr").groupBy("yr").agg(F.round(F.sqrt(F.avg(error * error)), 2).alias("rmse"), F.count("*").alias("n"))


@query("ml19_metrics", S + ", x AS (SELECT pts, games * 150000.0 AS p FROM season) SELECT round(sqrt(avg(pow(pts - p, 2))), 2) AS rmse, round(1 - sum(pow(pts - p, 2)) / (SELECT sum(pow(pts - (SELECT avg(pts) FROM x), 2)) FROM x), 6) AS r2, round(avg(abs(pts - p)), 3) AS mae FROM x")
def ml19(spark, d):
    x = season(spark, d).select("pts", (F.col("games") * 150000.0).alias("p"))
    e = F.col("pts") - F.col("p")
    return x.agg(F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"), F.round(1 - F.sum(e * e) / (F.var_pop("pts") * F.count("*")), 6).alias("r2"), F.round(F.avg(F.abs(e)), 3).alias("mae"))


@query("ml19_calibration", S + ", x AS (SELECT least(CAST(floor(least(games / 10.0, 0.999) * 5) AS INT), 4) AS bin, games / 10.0 AS p, (pts > 400000)::INT AS y FROM season) SELECT bin, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY bin")
def ml19_calibration(spark, d):
    x = season(spark, d).select((F.col("games") / 10.0).alias("p"), (F.col("pts") > 400000).cast("int").alias("y"))
    return x.groupBy(F.least(F.floor(F.least(F.col("p"), F.lit(0.999)) * 5).cast("int"), F.lit(4)).alias("bin")).agg(F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("observed"), F.count("*").alias("n"))


@query("ml17_normal_posterior", S + "SELECT team, (100000000 + CAST(sum(CAST(round(pts * 100) AS BIGINT)) AS DOUBLE)) / (100 * (2 + count(*))) AS m_n, CAST(2 + count(*) AS BIGINT) AS k_n, round(1000000 + 0.5 * (var_pop(pts) * count(*)) + 2 * count(*) * pow(avg(pts) - 500000, 2) / (2 * (2 + count(*))), -3) AS b_n FROM season GROUP BY team")
def ml17(spark, d):
    n = F.count("*")
    gap = F.avg("pts") - 500000
    return season(spark, d).groupBy("team").agg(
        ((100000000 + F.sum(F.round(F.col("pts") * 100).cast("long")).cast("double")) / (100 * (2 + n))).alias("m_n"), (2 + n).alias("k_n"),
        F.round(1000000 + 0.5 * (F.var_pop("pts") * n) + 2 * n * gap * gap / (2 * (2 + n)), -3).alias("b_n"),
    )


@query("ml1_ridge_prediction")
def ml1_ridge(spark, d):
    df = season(spark, d).withColumn("pts_m", F.col("pts") / 1e5)
    rows = VectorAssembler(inputCols=["games", "yr"], outputCol="raw").transform(df)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows.where("yr < 2000")).transform(rows)
    model = LinearRegression(labelCol="pts_m", regParam=0.1, elasticNetParam=0.0).fit(scaled.where("yr < 2000"))
    return model.transform(scaled.where("yr >= 2000")).select("player", "yr", F.round("prediction", 6).alias("prediction"))


@query("ml12_stacked_models")
def ml12(spark, d):
    """Three models out of fold, folds by hash of the player, the mean of the best and a meta model on all."""
    fold = F.conv(F.substring(F.md5(F.col("player").cast("string")), 1, 7), 16, 10).cast("long") % 3
    df = season(spark, d).select("player", "yr", (F.col("pts") / 1e5).alias("y"), F.col("games").cast("double").alias("x"), F.col("team").cast("double").alias("t"), fold.alias("fold"))
    some = {"line": LinearRegression(), "ridge": LinearRegression(regParam=0.3, elasticNetParam=0.0), "tree": DecisionTreeRegressor(maxDepth=4)}
    out = models.stack(df, ["x", "t"], "y", "fold", some, 3, 3)
    return out.select("player", "yr", *(F.round(c, 5).alias(c) for c in ("p_line", "p_ridge", "p_tree", "best_mean", "stacked")))


JN11_SQL = """WITH t AS (SELECT p_size, p_brand, p_type, min(p_partkey) AS rep, count(*) AS n FROM part GROUP BY ALL),
p AS (SELECT a.rep, b.rep AS match, a.n, b.n AS match_n, a.p_type AS x, b.p_type AS y FROM t a JOIN t b USING (p_size, p_brand) WHERE a.rep < b.rep),
s AS (SELECT rep, match, n, match_n, 2 * list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))))) / (length(x) + length(y)) AS score FROM p)
SELECT rep, match, n, match_n, round(score, 6) AS score FROM s WHERE score > 0.5"""


@query("jn11_fuzzy_join", JN11_SQL)
def jn11(spark, d):
    """Equal size and brand first, then similar text. Equal texts of a key are one class: pairs are of class representatives
    (rep, match), n and match_n are the classes' sizes, so that copies never multiply pairs; jn11_fuzzy_classes has the
    membership."""
    classes = _text_classes(table(spark, d, "part"))
    other = classes.select(F.col("rep").alias("match"), F.col("p_type").alias("m_type"), "p_size", "p_brand", F.col("n").alias("match_n"))
    pairs = classes.join(other, ["p_size", "p_brand"]).where("rep < match").withColumn("score", similarity(F.col("p_type"), F.col("m_type")))
    return pairs.where("score > 0.5").select("rep", "match", "n", "match_n", F.round("score", 6).alias("score"))


def _text_classes(part):
    return part.groupBy("p_size", "p_brand", "p_type").agg(F.min("p_partkey").alias("rep"), F.count("*").alias("n"))


@query("jn11_fuzzy_classes", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_size, p_brand, p_type) AS rep FROM part")
def jn11_classes(spark, d):
    keys = ["p_size", "p_brand", "p_type"]
    part = table(spark, d, "part")
    return part.select("p_partkey", *keys).join(_text_classes(part).select(*keys, "rep"), keys).select("p_partkey", "rep")


def _candidates(spark, d, n: int = 60):
    top = win.number(season(spark, d).where("yr = 2000"), ["pos"], best(), "rn").where(F.col("rn") <= n // 5)
    mean = F.col("pts") / 10000
    return top.select("player", F.col("pos").alias("kind"), F.greatest(F.round(mean / 2), F.lit(1)).cast("int").alias("price"), mean.alias("mean"), (mean / 5).alias("sd"), (mean / 2).alias("low"), (mean * 1.5).alias("high"))


@query("sm1_truncated_normal_draws")
def sm1(spark, d):
    """Draws for every player of every season, each a row."""
    rows = season(spark, d).select(F.concat_ws(":", "player", "yr").alias("player"), (F.col("pts") / 10000).alias("mean"))
    m = F.col("mean")
    rows = rows.withColumns({"sd": m / 5, "low": m / 2, "high": m * 1.5})
    return simulate.draws(rows, "player", 10).withColumn("points", F.round("points", 6))


NEED = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 2, "MACHINERY": 1}


@query("sm7_lineup_trials")
def sm7(spark, d):
    return simulate.selection(simulate.trials(_candidates(spark, d), 40, NEED, 400), 40)


@query("sm10_pick_probability")
def sm10(spark, d):
    """How often each player of all seasons is drawn at a pick."""
    m = F.col("mean")
    rows = season(spark, d).groupBy("player").agg((F.avg("pts") / 10000).alias("mean")).withColumns({"sd": m / 5, "low": m / 2, "high": m * 1.5})
    drawn = simulate.draws(rows, "player", 50, seed=7)
    return drawn.groupBy("player", F.round("points").cast("int").alias("pick")).agg(F.count("*").alias("n"))


@query("sm12_points_with_floor", S + "SELECT player, yr, round(pts / games * (16 - (16 - games)) + (16 - games) * least(20000, pts / games), 4) AS pts16 FROM season")
def sm12(spark, d):
    ppg, missed = F.col("pts") / F.col("games"), 16 - F.col("games")
    return season(spark, d).select("player", "yr", F.round(ppg * (16 - missed) + missed * F.least(F.lit(20000.0), ppg), 4).alias("pts16"))


@query("ext_event_rollup", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_rollup(spark, d):
    return rollup(table(spark, d, "events")).withColumn("total", F.round("total", 4))

"""Further queries of the inventory: small projections, filters, joins, text, composite features, models, simulation."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import row_mean, weighted_sum
from tallyforge.operators import models, quantile_regression, simulate
from tallyforge.operators import relational as rel
from tallyforge.operators import windows as win
from tallyforge.plans.registry import query, table
from tallyforge.plans.season import SEASON_SQL, SOURCES_SQL, best, season, sources

S = f"WITH {SEASON_SQL} "
Q = f"WITH {SOURCES_SQL} "


@query("prj3_renames_and_constants", "SELECT s_suppkey AS id, s_name AS name, 2025 AS year, 'feed' AS source FROM supplier")
def prj3(spark, d):
    df = table(spark, d, "supplier").withColumnsRenamed({"s_suppkey": "id", "s_name": "name"}).drop("s_nationkey", "s_acctbal", "not_there")
    return df.withColumns({"year": F.lit(2025), "source": F.lit("feed")})


@query("prj4_positional_names", "SELECT r_regionkey AS a, r_name AS b FROM region")
def prj4(spark, d):
    return table(spark, d, "region").toDF("a", "b")


@query("prj14_numeric_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def prj14(spark, d):
    df = table(spark, d, "part")
    return df.select(*(c for c, kind in df.dtypes if kind in ("int", "bigint", "double")))


@query("flt4_null_tests", Q + "SELECT part, s1, s3 FROM sources WHERE s1 IS NOT NULL AND s3 IS NOT NULL")
def flt4(spark, d):
    return sources(spark, d).dropna(subset=["s1", "s3"]).select("part", "s1", "s3")


@query("flt6_experience_slice", S + ", x AS (SELECT *, yr - min(yr) OVER (PARTITION BY player) AS year_exp FROM season) SELECT player, yr, CAST(year_exp AS INT) AS year_exp FROM x WHERE (year_exp >= 2 AND yr < 2001) OR (year_exp >= 2 AND yr = 2001)")
def flt6(spark, d):
    x = season(spark, d).withColumn("year_exp", F.col("yr") - F.min("yr").over(Window.partitionBy("player")))
    return x.where("year_exp >= 2").select("player", "yr", "year_exp")


@query("flt7_keep_current_year", S + ", x AS (SELECT player, yr, lead(pts) OVER (PARTITION BY player ORDER BY yr) AS y_act FROM season) SELECT player, yr, CASE WHEN yr = 2001 THEN 0 ELSE y_act END AS y_act FROM x WHERE y_act IS NOT NULL OR yr = 2001")
def flt7(spark, d):
    x = season(spark, d).select("player", "yr", F.lead("pts").over(Window.partitionBy("player").orderBy("yr")).alias("y_act"))
    return x.where("y_act IS NOT NULL OR yr = 2001").withColumn("y_act", F.when(F.col("yr") == 2001, F.lit(0.0)).otherwise(F.col("y_act")))


@query("flt9_touch_or_games", S + "SELECT player, yr, pts, games FROM season WHERE yr = 2001 OR pts > 300000 OR games > 4")
def flt9(spark, d):
    return season(spark, d).where("yr = 2001 OR pts > 300000 OR games > 4").select("player", "yr", "pts", "games")


@query("upd4_mean_fill", Q + "SELECT part, round(coalesce(s2, (SELECT avg(s2) FROM sources)), 5) AS s2 FROM sources")
def upd4(spark, d):
    df = sources(spark, d)
    return df.select("part", F.round(F.coalesce("s2", F.lit(df.agg(F.avg("s2")).first()[0])), 5).alias("s2"))


@query("upd9_keeper_override", S + ", k AS (SELECT player, 5.0 AS keep FROM season WHERE yr = 2000 AND player % 9 = 0) SELECT s.player, yr, CASE WHEN keep IS NOT NULL AND yr = 2001 THEN CAST(keep AS DOUBLE) ELSE pts END AS price FROM season s LEFT JOIN k ON s.player = k.player")
def upd9(spark, d):
    df = season(spark, d)
    keep = df.where("yr = 2000 AND player % 9 = 0").select("player", F.lit(5.0).alias("keep"))
    return df.join(keep, "player", "left").select("player", "yr", F.when(F.col("keep").isNotNull() & (F.col("yr") == 2001), F.col("keep")).otherwise(F.col("pts")).alias("price"))


@query("jn4_star_of_aggregates", S + "SELECT player, round(sum(pts), 2) AS total, round(avg(pts), 7) AS mean, max(pts) AS best, CAST(count(*) AS BIGINT) AS seasons, CAST(sum(games) AS BIGINT) AS games FROM season GROUP BY player")
def jn4(spark, d):
    """What the same-grain joins of aggregates give, in one aggregation."""
    return season(spark, d).groupBy("player").agg(F.round(F.sum("pts"), 2).alias("total"), F.round(F.avg("pts"), 7).alias("mean"), F.max("pts").alias("best"), F.count("*").alias("seasons"), F.sum("games").alias("games"))


@query("jn8_lagged_key_join", S + ", x AS (SELECT player, yr, team, coalesce(lag(team) OVER (PARTITION BY player ORDER BY yr), team) AS last_team FROM season), t AS (SELECT team AS last_team, yr + 1 AS yr, max(pts) AS last_best FROM season GROUP BY team, yr) SELECT x.player, x.yr, x.last_team, t.last_best FROM x LEFT JOIN t ON x.last_team = t.last_team AND x.yr = t.yr")
def jn8(spark, d):
    df = season(spark, d)
    x = df.select("player", "yr", F.coalesce(F.lag("team").over(Window.partitionBy("player").orderBy("yr")), "team").alias("last_team"))
    t = df.groupBy(F.col("team").alias("last_team"), (F.col("yr") + 1).alias("yr")).agg(F.max("pts").alias("last_best"))
    return x.join(t, ["last_team", "yr"], "left").select("player", "yr", "last_team", "last_best")


@query("jn18_collision_suffixes", "SELECT c_custkey, c_acctbal AS acctbal_x, s_acctbal AS acctbal_y FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def jn18(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey"), F.col("c_acctbal").alias("acctbal_x"))
    return a.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("acctbal_y")), "c_custkey", "left")


@query("ag3_many_functions", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 5) AS o_totalprice_mean, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max FROM orders GROUP BY 1")
def ag3(spark, d):
    c = "o_totalprice"
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.sum(c), 2).alias(f"{c}_sum"), F.round(F.avg(c), 5).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))


@query("ag6_prediction_rollup", S + "SELECT player, pos, round(avg(pts), 7) AS pred, round(avg(games), 7) AS games FROM season WHERE pos IN ('BUILDING', 'MACHINERY') AND yr NOT IN (1995) AND pos LIKE '%IN%' GROUP BY player, pos")
def ag6(spark, d):
    df = season(spark, d).where(F.col("pos").isin("BUILDING", "MACHINERY") & ~F.col("yr").isin(1995) & F.col("pos").like("%IN%"))
    return df.groupBy("player", "pos").agg(F.round(F.avg("pts"), 7).alias("pred"), F.round(F.avg("games"), 7).alias("games"))


@query("ag21_latest_key", "SELECT max(o_orderkey) AS pkey FROM orders")
def ag21(spark, d):
    return table(spark, d, "orders").agg(F.max("o_orderkey").alias("pkey"))


@query("wn18_best_prefix", S + """, e AS (SELECT pos AS model, sqrt(avg(pow(pts - 150000 * games, 2))) AS err FROM season GROUP BY pos), r AS (SELECT *, row_number() OVER (ORDER BY err, model) AS k FROM e)
SELECT CAST(k AS INT) AS k, round(avg(err) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS err FROM r""")  # fmt: skip
def wn18(spark, d):
    """Mean error over the best k models, for each k; models are a handful of rows."""
    gap = F.col("pts") - 150000 * F.col("games")
    e = season(spark, d).groupBy(F.col("pos").alias("model")).agg(F.sqrt(F.avg(gap * gap)).alias("err")).withColumn("all", F.lit(1))
    r = win.number(e, ["all"], ["err", "model"], "k")
    return win.running(r, ["all"], ["k"], "err", "mean", "m").select("k", F.round("m", 3).alias("err"))


@query("st1_mixed_sort", "SELECT player, yr, v FROM (" + S + "SELECT player, yr, CASE WHEN player % 4 = 0 THEN NULL ELSE pts END AS v FROM season) ORDER BY yr, v DESC NULLS LAST, player")
def st1(spark, d):
    v = F.when(F.col("player") % 4 != 0, F.col("pts"))
    return season(spark, d).select("player", "yr", v.alias("v")).orderBy(F.asc_nulls_last("yr"), F.desc_nulls_last("v"), "player")


@query("st4_repeatable_sample", "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS turn FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) AS BIGINT) % 10 = 3")
def st4(spark, d):
    """A tenth of the rows by hash of the key, and the hash as the order of a shuffle: the same on every run."""
    turn = F.md5(F.col("o_orderkey").cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", turn.alias("turn"))
    return rows.where(F.conv(F.substring("turn", 1, 7), 16, 10).cast("long") % 10 == 3)


@query("str2_numbers_in_text", "SELECT o_orderkey, translate(concat(o_orderpriority, '*+%,'), '*+%,', '') AS cleaned FROM orders")
def str2(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.translate(F.concat("o_orderpriority", F.lit("*+%,")), "*+%,", "").alias("cleaned"))


@query("str4_last_first_team", "SELECT c_custkey, concat('First', c_custkey, ' Last', c_nationkey) AS name, 'T' || c_nationkey AS team FROM customer")
def str4(spark, d):
    """'Last, First TEAM POS' as 'First Last' and the last token but one."""
    raw = F.concat(F.lit("Last"), "c_nationkey", F.lit(", First"), "c_custkey", F.lit(" T"), "c_nationkey", F.lit(" RB"))
    df = table(spark, d, "customer").select("c_custkey", raw.alias("raw"))
    last, rest = F.get(F.split("raw", ", "), F.lit(0)), F.split(F.get(F.split("raw", ", "), F.lit(1)), " ")
    return df.select("c_custkey", F.concat_ws(" ", F.get(rest, F.lit(0)), last).alias("name"), F.try_element_at(rest, F.lit(-2)).alias("team"))


@query("str9_camel_case_tokens", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), ' ') AS tokens FROM part")
def str9(spark, d):
    camel = F.regexp_replace(F.replace(F.initcap("p_type"), F.lit(" "), F.lit("")), "(?<=[a-z])(?=[A-Z])", " ")
    return table(spark, d, "part").select("p_partkey", F.upper(F.array_join(F.array_sort(F.array_distinct(F.split(camel, " "))), " ")).alias("tokens"))


@query("dt2_parse_stamp", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS parsed FROM orders")
def dt2(spark, d):
    text = F.date_format("o_orderdate", "MM-dd-yyyy HH:mm")
    return table(spark, d, "orders").select("o_orderkey", F.to_timestamp(text, "MM-dd-yyyy HH:mm").alias("parsed"))


@query("ma9_projected_points", Q + "SELECT part, round(coalesce(s1, 0) * 0.1 + coalesce(s2, 0) * 0.2 + coalesce((coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / nullif((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT, 0), 0) * 0.5, 6) AS pts FROM sources")
def ma9(spark, d):
    """A statistic that the source doesn't have comes from the average column, by column and not by value."""
    df = sources(spark, d).withColumn("avg_td", row_mean([F.col(c) for c in ("s1", "s2", "s3")]))
    weights = {"s1": 0.1, "s2": 0.2, "td": 0.5}
    return df.select("part", F.round(weighted_sum({c if c in df.columns else f"avg_{c}": w for c, w in weights.items()}), 6).alias("pts"))


@query("cst1_tolerant_cast", "SELECT o_orderkey, TRY_CAST(left(o_orderpriority, 1) AS DOUBLE) AS level, o_orderstatus FROM orders")
def cst1(spark, d):
    """A text column becomes numeric only if all of its values are; checked in one aggregation."""
    df = table(spark, d, "orders").select("o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("level"), "o_orderstatus")
    texts = [c for c, kind in df.dtypes if kind == "string"]
    bad = df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts)).first()
    return df.withColumns({c: F.col(c).try_cast("double") for c in texts if not bad[c]})


@query("ar2_shuffled_samples", S + "SELECT player, string_agg(CAST(yr AS VARCHAR), ',' ORDER BY md5(player || ':' || yr)) AS years, CAST(count(*) AS INT) AS n FROM season GROUP BY player")
def ar2(spark, d):
    """A player's samples in an order of its own, by a hash of player and sample, so that a repeated task shuffles alike."""
    turn = F.struct(F.md5(F.concat_ws(":", "player", "yr")).alias("turn"), "yr")
    rows = season(spark, d).groupBy("player").agg(F.array_sort(F.collect_list(turn)).alias("samples"))
    return rows.select("player", F.array_join(F.transform("samples", lambda x: x["yr"].cast("string")), ",").alias("years"), F.size("samples").alias("n"))


BZ6_SQL = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 0.01 + l_quantity, 4) AS targets FROM lineitem"


@query("bz6_regression_fill", BZ6_SQL)
def bz6(spark, d):
    """The target is linear in the features, so an exact fit gives back what was taken out."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice") * 0.01 + F.col("l_quantity")).alias("targets"))
    return models.fill_by_regression(df, "targets", ["l_quantity", "l_extendedprice", "l_tax"]).select("l_orderkey", "l_linenumber", F.round("targets", 4).alias("targets"))


BZ24_SQL = Q + """,
a AS (SELECT part, CAST(size AS DOUBLE) AS z, s1, s2, s3 FROM sources),
f1 AS (SELECT regr_slope(s1, z) AS b, regr_intercept(s1, z) AS k FROM a),
c1 AS (SELECT part, z, coalesce(s1, k + b * z) AS s1, s2, s3 FROM a, f1),
m2 AS (SELECT avg(z) AS mz, avg(s1) AS m1, avg(s2) AS my, var_pop(z) AS vz, var_pop(s1) AS v1, covar_pop(z, s1) AS z1, covar_pop(z, s2) AS zy, covar_pop(s1, s2) AS y1 FROM c1 WHERE s2 IS NOT NULL),
f2 AS (SELECT *, (zy * v1 - y1 * z1) / (vz * v1 - z1 * z1) AS bz, (y1 * vz - zy * z1) / (vz * v1 - z1 * z1) AS b1 FROM m2),
c2 AS (SELECT part, z, s1, coalesce(s2, my + bz * (z - mz) + b1 * (s1 - m1)) AS s2, s3 FROM c1, f2),
m3 AS (SELECT avg(z) AS mz, avg(s1) AS m1, avg(s2) AS m2, avg(s3) AS my, var_pop(z) AS a, covar_pop(z, s1) AS b, covar_pop(z, s2) AS c, var_pop(s1) AS d, covar_pop(s1, s2) AS e, var_pop(s2) AS f, covar_pop(z, s3) AS p, covar_pop(s1, s3) AS q, covar_pop(s2, s3) AS r FROM c2 WHERE s3 IS NOT NULL),
f3 AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM m3),
g3 AS (SELECT mz, m1, m2, my, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS bz,
  (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / det AS b1, (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det AS b2 FROM f3)
SELECT part, round(s1, 4) AS s1, round(s2, 4) AS s2, round(coalesce(s3, my + bz * (z - mz) + b1 * (s1 - g3.m1) + b2 * (s2 - g3.m2)), 4) AS s3 FROM c2, g3"""


@query("bz24_chained_imputation", BZ24_SQL)
def bz24(spark, d):
    return models.fill_chain(sources(spark, d), ["s1", "s2", "s3"], ["size"]).select("part", *(F.round(c, 4).alias(c) for c in ("s1", "s2", "s3")))


@query("bz28_position_weights", S + ", d AS (SELECT *, row_number() OVER (PARTITION BY yr, pos ORDER BY pts DESC, player) AS rn FROM season), a AS (SELECT pos, avg(pts) AS m FROM d WHERE rn <= CASE pos WHEN 'BUILDING' THEN 24 WHEN 'FURNITURE' THEN 36 ELSE 12 END GROUP BY pos) SELECT pos, round(m / sum(m) OVER (), 8) AS weight FROM a")
def bz28(spark, d):
    need = F.when(F.col("pos") == "BUILDING", 24).when(F.col("pos") == "FURNITURE", 36).otherwise(12)
    top = win.number(season(spark, d), ["yr", "pos"], best(), "rn").where("rn <= 36")  # the greatest need, cut before the shuffle
    a = top.where(F.col("rn") <= need).groupBy("pos").agg(F.avg("pts").alias("m"))
    return a.select("pos", F.round(F.col("m") / F.sum("m").over(Window.partitionBy()), 8).alias("weight"))  # a row per position


@query("bz29_salary_features", S + "SELECT player, yr, pts, round(coalesce(pts - lag(pts) OVER w, 0), 2) AS gap, CAST(row_number() OVER w - 1 AS INT) AS place, round(pts / max(pts) OVER (PARTITION BY yr, pos), 8) AS of_best FROM season WINDOW w AS (PARTITION BY yr, pos ORDER BY pts DESC, player)")
def bz29(spark, d):
    df = win.number(season(spark, d), ["yr", "pos"], best(), "place", start=0)
    gap = F.coalesce(F.col("pts") - F.lag("pts").over(Window.partitionBy("yr", "pos").orderBy(*best())), F.lit(0.0))
    return df.select("player", "yr", "pts", F.round(gap, 2).alias("gap"), "place", F.round(F.col("pts") / F.max("pts").over(Window.partitionBy("yr", "pos")), 8).alias("of_best"))


@query("bz33_membership_flags", "SELECT s_suppkey, CAST(s_nationkey IN (1, 2, 3, 4, 5) AS INT) AS power5, CAST(s_nationkey IN (1, 2) AS INT) AS top2 FROM supplier")
def bz33(spark, d):
    c = F.col("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", c.isin(1, 2, 3, 4, 5).cast("int").alias("power5"), c.isin(1, 2).cast("int").alias("top2"))


@query("bz34_draft_repair", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey WHEN c_custkey % 3 = 1 THEN 7 ELSE 2 END AS INT) AS rnd, CAST((CASE WHEN c_custkey % 3 = 0 THEN c_nationkey WHEN c_custkey % 3 = 1 THEN 7 ELSE 2 END - 1) * 32 + c_custkey % 32 AS BIGINT) AS overall FROM customer")
def bz34(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, "UNK").when(F.col("c_custkey") % 3 == 1, "UDFA").otherwise("2")
    rnd = F.when(F.col("raw") == "UNK", F.col("c_nationkey")).when(F.col("raw") == "UDFA", 7).otherwise(F.col("raw").try_cast("int"))
    return table(spark, d, "customer").withColumn("raw", raw).select("c_custkey", rnd.cast("int").alias("rnd"), ((rnd - 1) * 32 + F.col("c_custkey") % 32).cast("long").alias("overall"))


@query("bz38_per_game_context", S + ", q AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY team, yr ORDER BY pts) AS r FROM season) WHERE r = 1) SELECT s.player, s.yr, round(s.pts / (s.games + 1), 6) AS per_game, round(q.pts / (q.games + 1), 6) AS qb_per_game FROM season s LEFT JOIN q ON s.team = q.team AND s.yr = q.yr")
def bz38(spark, d):
    df = season(spark, d)
    low = win.extreme_rows(df, ["team", "yr"], [F.col("pts")]).select("team", "yr", F.round(F.col("pts") / (F.col("games") + 1), 6).alias("qb_per_game"))
    return df.join(low, ["team", "yr"], "left").select("player", "yr", F.round(F.col("pts") / (F.col("games") + 1), 6).alias("per_game"), "qb_per_game")


@query("bz41_output_table", S + "SELECT player, yr, pts, CAST(row_number() OVER (PARTITION BY yr ORDER BY pts DESC, player) AS INT) AS adp_rank FROM season WHERE yr = 2001 ORDER BY adp_rank")
def bz41(spark, d):
    return win.number(season(spark, d).where("yr = 2001"), ["yr"], best(), "adp_rank").select("player", "yr", "pts", "adp_rank").orderBy("adp_rank")


@query("bz45_best_model_per_year", S + ", m AS (SELECT yr, pos, avg(abs(pts - 150000 * games)) AS err FROM season GROUP BY yr, pos) SELECT yr, arg_min(pos, err) AS model, round(min(err), 7) AS err FROM m GROUP BY yr")
def bz45(spark, d):
    m = season(spark, d).groupBy("yr", "pos").agg(F.avg(F.abs(F.col("pts") - 150000 * F.col("games"))).alias("err"))
    return m.join(m.groupBy("yr").agg(F.min_by("pos", "err").alias("pos")), ["yr", "pos"]).select("yr", F.col("pos").alias("model"), F.round("err", 7).alias("err"))


@query("bz47_auction_cohort", S + ", f AS (SELECT player, min(yr) AS first FROM season GROUP BY player) SELECT s.player, yr, pts, CAST(yr = first AS INT) AS is_rookie FROM season s JOIN f USING (player) WHERE NOT (s.player % 11 = 0 AND yr < 2001)")
def bz47(spark, d):
    df = season(spark, d).withColumn("first", F.min("yr").over(Window.partitionBy("player")))
    return df.where("NOT (player % 11 = 0 AND yr < 2001)").select("player", "yr", "pts", (F.col("yr") == F.col("first")).cast("int").alias("is_rookie"))


@query("bz49_backfill_predictions", S + ", b AS (SELECT regr_slope(pts, games) AS b, regr_intercept(pts, games) AS a FROM season WHERE yr < 2001) SELECT player, yr, round(a + b * games, 3) AS pred FROM season, b WHERE yr = 2001 AND player NOT IN (SELECT player FROM season WHERE yr = 2000)")
def bz49(spark, d):
    df = season(spark, d)
    fit = df.where("yr < 2001").agg(F.regr_slope("pts", "games").alias("slope"), F.regr_intercept("pts", "games").alias("start"))
    missing = df.where("yr = 2001").join(df.where("yr = 2000").select("player"), "player", "left_anti")
    return missing.join(F.broadcast(fit)).select("player", "yr", F.round(F.col("start") + F.col("slope") * F.col("games"), 3).alias("pred"))  # one row


@query("bz52_years_union", S + "SELECT player, yr, pts FROM season WHERE yr IN (1999, 2000, 2001) AND pts IS NOT NULL")
def bz52(spark, d):
    """A union of one load per year is one scan with the years in its filter."""
    return season(spark, d).where(F.col("yr").isin(1999, 2000, 2001)).select("player", "yr", "pts").dropna(subset=["pts"])


@query("ml2_logistic_probability")
def ml2(spark, d):
    df = season(spark, d).select("player", "yr", F.col("games").cast("double").alias("x"), (F.col("pts") > 500000).cast("double").alias("label"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    out = LogisticRegression(regParam=0.01).fit(rows.where("yr < 2000")).transform(rows.where("yr >= 2000"))
    return out.select("player", "yr", F.round(vector_to_array("probability")[1], 5).alias("p"))


@query("ml3_forest_prediction")
def ml3(spark, d):
    df = season(spark, d).select("player", "yr", (F.col("pts") / 1e5).alias("label"), F.col("games").cast("double").alias("x"), F.col("team").cast("double").alias("t"))
    rows = VectorAssembler(inputCols=["x", "t"], outputCol="features").transform(df)
    return RandomForestRegressor(numTrees=10, maxDepth=4, seed=1).fit(rows.where("yr < 2000")).transform(rows.where("yr >= 2000")).select("player", "yr", F.round("prediction", 5).alias("prediction"))


@query("ml3_boosted_trees")
def ml3_boosted(spark, d):
    df = season(spark, d).select("player", "yr", (F.col("pts") / 1e5).alias("label"), F.col("games").cast("double").alias("x"), F.col("team").cast("double").alias("t"))
    rows = VectorAssembler(inputCols=["x", "t"], outputCol="features").transform(df)
    return GBTRegressor(maxIter=10, maxDepth=3, seed=1).fit(rows.where("yr < 2000")).transform(rows.where("yr >= 2000")).select("player", "yr", F.round("prediction", 5).alias("prediction"))


@query("ml1_huber_line")
def ml1_huber(spark, d):
    """A line that single outliers don't turn."""
    df = season(spark, d).select("player", "yr", (F.col("pts") / 1e5).alias("label"), F.col("games").cast("double").alias("x"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    return LinearRegression(loss="huber", epsilon=1.35).fit(rows.where("yr < 2000")).transform(rows.where("yr >= 2000")).select("player", "yr", F.round("prediction", 5).alias("prediction"))


@query("ml5_quantile_lines")
def ml5(spark, d):
    """The line of each position that leaves 0.8 of its seasons below, fitted to all rows."""
    lines = quantile_regression.fit(season(spark, d), ["games"], "pts", ["pos"], 0.8)
    return lines.select("pos", F.round(F.col("tf_b")[0], 2).alias("slope"), F.round("tf_a", 2).alias("intercept"))


@query("ml7_scaled_components")
def ml7(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = VectorAssembler(inputCols=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], outputCol="raw").transform(df)
    scaled = MinMaxScaler(inputCol="raw", outputCol="unit").fit(rows).transform(rows)
    out = PCA(k=2, inputCol="unit", outputCol="parts").fit(scaled).transform(scaled)
    return out.select("l_orderkey", "l_linenumber", F.round(vector_to_array("parts")[0], 5).alias("p1"), F.round(vector_to_array("parts")[1], 5).alias("p2"))


@query("ml13_spread_curves")
def ml13(spark, d):
    """Deviation and outer percentiles by prediction, each with the best number of bins."""
    df = season(spark, d).select((F.col("games") * 1.5).alias("pred"), (F.col("pts") / 1e5).alias("y_act"))
    return models.spread_curves(df, "pred", "y_act", [6, 8, 10, 12]).select("metric", "bins", "bin", F.round("x", 6).alias("x"), F.round("value", 6).alias("value"))


@query("ml16_tree_clusters")
def ml16(spark, d):
    df = season(spark, d).select((F.col("pts") / 1e5).alias("label"), F.col("games").cast("double").alias("x"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    out = DecisionTreeRegressor(maxDepth=3).setLeafCol("leaf").fit(rows).transform(rows)
    return out.groupBy("leaf").agg(F.round(F.avg("label"), 6).alias("mean"), F.round(F.stddev_samp("label"), 6).alias("sd"), F.count("*").alias("n"))


SM2_SQL = """WITH RECURSIVE p(k, p, cdf) AS (SELECT 0, exp(-2.0::DOUBLE), exp(-2.0::DOUBLE) UNION ALL SELECT k + 1, p * 2.0 / (k + 1), cdf + p * 2.0 / (k + 1) FROM p WHERE k < 15),
u AS (SELECT c_custkey, (CAST('0x' || substr(md5('3:' || c_custkey), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u FROM customer)
SELECT c_custkey, CAST((SELECT count(*) FROM p WHERE u > cdf) AS INT) AS missed FROM u"""


@query("sm2_games_missed", SM2_SQL)
def sm2(spark, d):
    """Poisson counts by inversion of a hashed uniform number, at most 16."""
    rate = F.lit(2.0)
    u = simulate.uniform(3, F.col("c_custkey"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(acc, i):
        p = acc["p"] * rate / i
        more = u > acc["cdf"]
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["k"] + more.cast("int")).alias("k"))

    return table(spark, d, "customer").select("c_custkey", F.aggregate(F.sequence(F.lit(1), F.lit(16)), start, step)["k"].alias("missed"))


@query("sm11_available_at_pick", S + ", a AS (SELECT player, avg(pts) AS m, count(*) AS n FROM season GROUP BY player), r AS (SELECT player, row_number() OVER (ORDER BY m DESC, player) AS adp FROM a WHERE n >= 6) SELECT player, CAST(p.pick AS INT) AS pick, CAST(adp >= p.pick AS INT) AS open FROM r, (SELECT unnest([1, 24, 25, 48]) AS pick) p WHERE adp <= 60")
def sm11(spark, d):
    a = season(spark, d).groupBy("player").agg(F.avg("pts").alias("m"), F.count("*").alias("n")).where("n >= 6")
    top = a.orderBy(F.desc("m"), "player").limit(60).withColumn("all", F.lit(1))  # a draft's list, whose length is the feature
    r = win.number(top, ["all"], [F.desc("m"), "player"], "adp")
    return r.select("player", "adp", F.explode(F.array(*map(F.lit, (1, 24, 25, 48)))).alias("pick")).select("player", "pick", (F.col("adp") >= F.col("pick")).cast("int").alias("open"))


@query("sm14_roster_fill", S + ", r AS (SELECT *, row_number() OVER (PARTITION BY yr, team, pos ORDER BY pts DESC, player) AS rn FROM season), s AS (SELECT *, CASE WHEN rn <= 1 THEN pos END AS slot FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY yr, team, slot IS NULL AND pos IN ('BUILDING', 'FURNITURE') ORDER BY pts DESC, player) AS fn FROM s) SELECT player, yr, CASE WHEN slot IS NOT NULL THEN slot WHEN pos IN ('BUILDING', 'FURNITURE') AND fn <= 2 THEN 'FLEX' ELSE 'BENCH' END AS slot FROM f")
def sm14(spark, d):
    s = win.number(season(spark, d), ["yr", "team", "pos"], best(), "rn").withColumn("open", (F.col("rn") > 1) & F.col("pos").isin("BUILDING", "FURNITURE"))
    f = win.number(s, ["yr", "team", "open"], best(), "fn")
    return f.select("player", "yr", F.when(F.col("rn") <= 1, F.col("pos")).when(F.col("open") & (F.col("fn") <= 2), F.lit("FLEX")).otherwise(F.lit("BENCH")).alias("slot"))


@query("sm13_marginal_value", S + ", b AS (SELECT pos, regr_slope(pts, games) AS b FROM season GROUP BY pos) SELECT player, yr, round(b * games - min(b * games) OVER (PARTITION BY yr, team), 4) AS marginal FROM season JOIN b USING (pos)")
def sm13(spark, d):
    df = season(spark, d)
    b = df.groupBy("pos").agg(F.regr_slope("pts", "games").alias("b"))
    v = F.col("b") * F.col("games")
    return df.join(F.broadcast(b), "pos").select("player", "yr", F.round(v - F.min(v).over(Window.partitionBy("yr", "team")), 4).alias("marginal"))

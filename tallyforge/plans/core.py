"""Queries for projections, filters, updates, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import half_even, look_up, ratio, row_mean, row_std, row_sum
from tallyforge.operators import relational as rel
from tallyforge.operators import stats
from tallyforge.operators import windows as win
from tallyforge.plans.registry import query, table
from tallyforge.plans.season import SEASON_SQL, SOURCES_SQL, best, season, sources

S = f"WITH {SEASON_SQL} "
Q = f"WITH {SOURCES_SQL} "
RANKS = {"AUTOMOBILE": 12, "BUILDING": 28, "FURNITURE": 44, "MACHINERY": 12}


@query("wn16_value_over_replacement", S + """, numbered AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY yr, pos) AS n,
    CASE pos WHEN 'AUTOMOBILE' THEN 12 WHEN 'BUILDING' THEN 28 WHEN 'FURNITURE' THEN 44 WHEN 'MACHINERY' THEN 12 END AS k
  FROM season WINDOW w AS (PARTITION BY yr, pos ORDER BY pts DESC, player))
SELECT player, yr, pos, pts, round(pts - CASE WHEN k IS NULL THEN NULL ELSE max(CASE WHEN rn = least(k, n) THEN pts END) OVER (PARTITION BY yr, pos) END, 2) AS vor FROM numbered""")  # fmt: skip
def wn16(spark, d):
    df = win.over_replacement(season(spark, d), ["yr", "pos"], "pos", "pts", RANKS, best(), "vor")
    return df.select("player", "yr", "pos", "pts", F.round("vor", 2).alias("vor"))


@query("prj2_pattern_columns", "SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders")
def prj2(spark, d):
    return rel.pick(table(spark, d, "orders"), lambda c: c.startswith("o_order"), ["o_orderkey"])


@query("prj5_prefixed_columns", "SELECT s_suppkey, s_name AS sup_s_name, s_nationkey AS sup_s_nationkey, s_acctbal AS sup_s_acctbal FROM supplier")
def prj5(spark, d):
    return rel.prefixed(table(spark, d, "supplier"), "sup_", ["s_suppkey"])


@query("prj9_drop_constant", "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 1")
def prj9(spark, d):
    nation = table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey", "n_regionkey", F.lit(7).alias("same"))
    return rel.drop_constant(nation, keep=["n_regionkey"])


@query("prj10_drop_columns_with_nulls", Q + "SELECT part, brand, size FROM sources")
def prj10(spark, d):
    return rel.drop_with_nulls(sources(spark, d))


@query("prj11_ratios", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / (l_quantity + 1), 9) AS price_per, round(l_tax / (l_discount + 10), 9) AS tax_rate, round(l_quantity / (l_linenumber + 100), 9) AS rate FROM lineitem")
def prj11(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(ratio(c("l_extendedprice"), c("l_quantity"), 1), 9).alias("price_per"),
        F.round(ratio(c("l_tax"), c("l_discount"), 10), 9).alias("tax_rate"), F.round(ratio(c("l_quantity"), c("l_linenumber"), 100), 9).alias("rate"),
    )


@query("prj12_one_hot", "SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_returnflag = 'A' AS INT) AS l_returnflag_A, CAST(l_returnflag = 'N' AS INT) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INT) AS l_returnflag_R FROM lineitem")
def prj12(spark, d):
    return rel.one_hot(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["A", "N", "R"])


@query("prj13_interactions", S + "SELECT player, yr, CAST(pos = 'BUILDING' AS INT) * pts AS building_pts, CAST(pos = 'BUILDING' AS INT) * games AS building_games FROM season")
def prj13(spark, d):
    flag = (F.col("pos") == "BUILDING").cast("int")
    return season(spark, d).select("player", "yr", (flag * F.col("pts")).alias("building_pts"), (flag * F.col("games")).alias("building_games"))


@query("flt1_season_week_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (year(l_shipdate) >= 1998 AND l_linenumber <= 5) OR (year(l_shipdate) < 1998 AND l_linenumber <= 4)")
def flt1(spark, d):
    y, n = F.year("l_shipdate"), F.col("l_linenumber")
    return table(spark, d, "lineitem").where(((y >= 1998) & (n <= 5)) | ((y < 1998) & (n <= 4))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("flt2_in_and_not_in", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
def flt2(spark, d):
    o = table(spark, d, "orders")
    return o.where(o.o_orderpriority.isin("1-URGENT", "2-HIGH") & ~o.o_orderstatus.isin("P")).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("flt3_excluded_pairs", S + "SELECT player, yr, pts FROM season WHERE NOT ((pos = 'BUILDING' AND team = 3) OR (pos = 'MACHINERY' AND team = 5))")
def flt3(spark, d):
    out = spark.createDataFrame([("BUILDING", 3), ("MACHINERY", 5)], "pos string, team int")
    return season(spark, d).join(F.broadcast(out), ["pos", "team"], "left_anti").select("player", "yr", "pts")


@query("flt5_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%STEEL%' AND p_name NOT LIKE '%1%'")
def flt5(spark, d):
    return table(spark, d, "part").where(F.col("p_type").like("%STEEL%") & ~F.col("p_name").like("%1%")).select("p_partkey", "p_type")


@query("flt8_games_filter", S + ", x AS (SELECT *, lead(games) OVER (PARTITION BY player ORDER BY yr) AS games_next FROM season) SELECT player, yr, games, games_next FROM x WHERE (games > 1 AND games_next > 1) OR (yr = 2001 AND games > 1)")
def flt8(spark, d):
    df = season(spark, d).withColumn("games_next", F.lead("games").over(Window.partitionBy("player").orderBy("yr")))
    return df.where(((F.col("games") > 1) & (F.col("games_next") > 1)) | ((F.col("yr") == 2001) & (F.col("games") > 1))).select("player", "yr", "games", "games_next")


@query("flt10_settings_predicate", S + "SELECT player, yr, pts FROM season WHERE pts >= 200000 AND games < 5")
def flt10(spark, d):
    df = season(spark, d)
    for column, op, value in (("pts", ">=", 200000), ("games", "<", 5)):
        df = rel.predicate(df, column, op, value)
    return df.select("player", "yr", "pts")


@query("flt11_train_predict_split", S + "SELECT player, yr, CASE WHEN yr < 2001 THEN 'train' ELSE 'predict' END AS part, CASE WHEN yr < 2001 THEN pts END AS y_act FROM season WHERE yr >= 1997")
def flt11(spark, d):
    early = F.col("yr") < 2001
    return season(spark, d).where("yr >= 1997").select("player", "yr", F.when(early, "train").otherwise("predict").alias("part"), F.when(early, F.col("pts")).alias("y_act"))


@query("flt12_outlier_anti_join", S + ", out AS (SELECT player, yr FROM season WHERE pts > 900000) SELECT player, yr, pts FROM season WHERE (player, yr) NOT IN (SELECT player, yr FROM out)")
def flt12(spark, d):
    df = season(spark, d)
    return df.join(df.where("pts > 900000").select("player", "yr"), ["player", "yr"], "left_anti").select("player", "yr", "pts")


@query("upd1_masked_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 100000 ELSE o_totalprice END AS price FROM orders")
def upd1(spark, d):
    c = F.col
    return table(spark, d, "orders").select("o_orderkey", F.when((c("o_orderstatus") == "F") & (c("o_totalprice") > 100000), F.lit(100000.0)).otherwise(c("o_totalprice")).alias("price"))


@query("upd2_fill_from_columns", Q + "SELECT part, coalesce(s1, s2, 0) AS a, coalesce(s3, 7) AS b FROM sources")
def upd2(spark, d):
    return sources(spark, d).select("part", F.coalesce("s1", "s2", F.lit(0.0)).alias("a"), F.coalesce("s3", F.lit(7.0)).alias("b"))


@query("upd3_median_fill", Q + "SELECT part, round(coalesce(s1, (SELECT quantile_cont(s1, 0.5) FROM sources)), 4) AS s1 FROM sources")
def upd3(spark, d):
    df = sources(spark, d)
    middle = stats.quantile(df, "s1", 0.5)
    return df.select("part", F.round(F.coalesce("s1", F.lit(middle)), 4).alias("s1"))


@query("upd6_cap_at_percentile", S + "SELECT player, yr, round(least(pts, (SELECT quantile_cont(pts, 0.95) FROM season)), 2) AS pts FROM season")
def upd6(spark, d):
    df = season(spark, d)
    high = stats.quantile(df, "pts", 0.95)
    return df.select("player", "yr", F.round(F.least("pts", F.lit(high)), 2).alias("pts"))


@query("upd7_dictionary_map", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS level FROM orders")
def upd7(spark, d):
    return table(spark, d, "orders").select("o_orderkey", look_up(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}).alias("level"))


@query("upd8_multipliers", S + "SELECT player, yr, round(pts * CASE player WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 4 THEN 1.1 ELSE 1 END, 2) AS pts FROM season")
def upd8(spark, d):
    factors = spark.createDataFrame([(1, 0.9), (2, 0.8), (4, 1.1)], "player long, factor double")
    df = season(spark, d).join(F.broadcast(factors), "player", "left")
    return df.select("player", "yr", F.round(F.col("pts") * F.coalesce("factor", F.lit(1.0)), 2).alias("pts"))


@query("jn1_inner_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def jn1(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("jn2_left_fold", Q + ", a AS (SELECT part, s1 FROM sources WHERE s1 IS NOT NULL), b AS (SELECT part, s2 FROM sources WHERE s2 IS NOT NULL), c AS (SELECT part, s3 FROM sources WHERE s3 IS NOT NULL) SELECT p.part, a.s1, b.s2, c.s3 FROM sources p LEFT JOIN a USING (part) LEFT JOIN b USING (part) LEFT JOIN c USING (part)")
def jn2(spark, d):
    df = sources(spark, d)
    return rel.join_all(df.select("part"), [df.where(F.col(s).isNotNull()).select("part", s) for s in ("s1", "s2", "s3")], ["part"])


@query("jn3_right_join", S + ", proj AS (SELECT c_custkey AS player FROM customer WHERE c_acctbal > 0) SELECT player, yr, pts FROM season RIGHT JOIN proj USING (player)")
def jn3(spark, d):
    proj = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("player"))
    return season(spark, d).select("player", "yr", "pts").join(proj, "player", "right")


@query("jn5_self_aggregate", S + "SELECT player, yr, pts, round(sum(pts) OVER (PARTITION BY team, yr), 2) AS team_pts, max(games) OVER (PARTITION BY team, yr) AS team_games FROM season")
def jn5(spark, d):
    df = win.with_totals(season(spark, d), ["team", "yr"], {"team_pts": F.sum("pts"), "team_games": F.max("games")})
    return df.select("player", "yr", "pts", F.round("team_pts", 2).alias("team_pts"), "team_games")


JN6 = """SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n, round(avg(s_acctbal), 4) AS bal FROM supplier
JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 5000) x ON n_nationkey = c_nationkey GROUP BY r_name, n_name"""


@query("jn6_sql_multi_join", JN6)
def jn6(spark, d):
    return spark.sql(
        JN6.replace("FROM supplier", "FROM {supplier}").replace("JOIN nation", "JOIN {nation}").replace("JOIN region", "JOIN {region}").replace("FROM customer", "FROM {customer}"),
        **{t: table(spark, d, t) for t in ("supplier", "nation", "region", "customer")},
    )


@query("jn9_shifted_key_join", S + "SELECT a.player, a.yr, a.pts, b.pts AS last_pts FROM season a LEFT JOIN season b ON a.player = b.player AND a.yr = b.yr + 1")
def jn9(spark, d):
    df = season(spark, d)
    last = df.select("player", (F.col("yr") + 1).alias("yr"), F.col("pts").alias("last_pts"))
    return df.select("player", "yr", "pts").join(last, ["player", "yr"], "left")


@query("jn10_inequality", S + "SELECT a.player, a.yr, CAST(count(b.yr) AS BIGINT) AS earlier, round(max(b.pts), 2) AS best_before FROM season a LEFT JOIN season b ON a.player = b.player AND b.yr < a.yr GROUP BY a.player, a.yr")
def jn10(spark, d):
    a = season(spark, d)
    b = a.select("player", F.col("yr").alias("before"), F.col("pts").alias("b_pts"))
    joined = a.alias("a").join(b.alias("b"), (F.col("a.player") == F.col("b.player")) & (F.col("b.before") < F.col("a.yr")), "left").select("a.player", "a.yr", "before", "b_pts")
    return joined.groupBy("player", "yr").agg(F.count("before").alias("earlier"), F.round(F.max("b_pts"), 2).alias("best_before"))


@query("jn12_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def jn12(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("jn13_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000)")
def jn13(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where(F.year("o_orderdate") == 2000)
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("jn14_arg_extreme_with_ties", "SELECT p_brand, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part) WHERE r = 1")
def jn14(spark, d):
    return win.extreme_rows(table(spark, d, "part"), ["p_brand"], [F.col("p_size")]).select("p_brand", "p_partkey", "p_size")


@query("jn16_fold_merge_pivot", S + "SELECT player, sum(CASE WHEN yr = 1999 THEN pts END) AS y1999, sum(CASE WHEN yr = 2000 THEN pts END) AS y2000 FROM season WHERE yr IN (1999, 2000) GROUP BY player")
def jn16(spark, d):
    out = season(spark, d).where(F.col("yr").isin(1999, 2000)).groupBy("player").pivot("yr", [1999, 2000]).agg(F.sum("pts"))
    return out.withColumnsRenamed({"1999": "y1999", "2000": "y2000"})


@query("jn19_missing_audit", S + "SELECT c_custkey AS player, c_name FROM customer LEFT JOIN (SELECT DISTINCT player FROM season WHERE yr = 2001) s ON c_custkey = player WHERE player IS NULL")
def jn19(spark, d):
    seen = season(spark, d).where("yr = 2001").select(F.col("player").alias("c_custkey"), F.lit(1).alias("seen")).distinct()
    return table(spark, d, "customer").join(seen, "c_custkey", "left").where("seen IS NULL").select(F.col("c_custkey").alias("player"), "c_name")


@query("ag1_named_aggregates", "SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS yr, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_quantity), 6) AS mean_l_quantity, max(l_quantity) AS max_l_quantity, round(sum(l_discount), 2) AS sum_l_discount, round(avg(l_discount), 6) AS mean_l_discount, max(l_discount) AS max_l_discount, CAST(count(*) AS BIGINT) AS games FROM lineitem GROUP BY ALL")
def ag1(spark, d):
    cols = ["l_quantity", "l_discount"]
    aggs = [a for c in cols for a in (F.round(F.sum(c), 2).alias(f"sum_{c}"), F.round(F.avg(c), 6).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}"))]
    return table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("yr")).agg(*aggs, F.count("*").alias("games"))


@query("ag5_two_level", "SELECT l_suppkey, yr, round(sum(a), 4) AS pred FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS yr, l_returnflag, avg(l_extendedprice) AS a FROM lineitem GROUP BY ALL) GROUP BY l_suppkey, yr")
def ag5(spark, d):
    inner = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("yr"), "l_returnflag").agg(F.avg("l_extendedprice").alias("a"))
    return inner.groupBy("l_suppkey", "yr").agg(F.round(F.sum("a"), 4).alias("pred"))


@query("ag7_any_value", "SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n, min(s_name) AS some_name FROM supplier GROUP BY s_nationkey")
def ag7(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_name").alias("some_name"))


@query("ag8_weighted_mean", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS wmean FROM lineitem GROUP BY ALL")
def ag8(spark, d):
    c = F.col
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.try_divide(F.sum(c("l_extendedprice") * c("l_quantity")), F.sum("l_quantity")), 4).alias("wmean"))


@query("ag9_pooled_deviation", S + ", x AS (SELECT team, pos, stddev_samp(pts) AS sd FROM season GROUP BY ALL) SELECT team, round(sqrt(sum(sd * sd)), 3) AS pooled FROM x GROUP BY team")
def ag9(spark, d):
    x = season(spark, d).groupBy("team", "pos").agg(F.stddev_samp("pts").alias("sd"))
    return x.groupBy("team").agg(F.round(F.sqrt(F.sum(F.col("sd") * F.col("sd"))), 3).alias("pooled"))


@query("ag10_group_quantile", S + "SELECT yr, round(quantile_cont(pts, 0.8), 3) AS p80, round(quantile_cont(pts, 0.5), 3) AS p50 FROM season GROUP BY yr")
def ag10(spark, d):
    out = stats.quantiles_by(season(spark, d), ["yr"], "pts", {"p80": 0.8, "p50": 0.5})
    return out.select("yr", F.round("p80", 3).alias("p80"), F.round("p50", 3).alias("p50"))


@query("ag11_tail_mean", S + "SELECT pos, round((quantile_cont(pts, 0.94) + quantile_cont(pts, 0.95) + quantile_cont(pts, 0.96) + quantile_cont(pts, 0.97)) / 4, 3) AS tail FROM season GROUP BY pos")
def ag11(spark, d):
    out = stats.quantiles_by(season(spark, d), ["pos"], "pts", {"a": 0.94, "b": 0.95, "c": 0.96, "d": 0.97})
    return out.select("pos", F.round((F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4, 3).alias("tail"))


@query("ag12_bin_summary", S + ", b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY yr ORDER BY pts, player) - 1) / ceil(count(*) OVER (PARTITION BY yr) / 10)) AS INT) AS bin FROM season) SELECT yr, bin, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(CAST(round(pts * 100) AS BIGINT)) AS DOUBLE) / (100 * count(*)), 3) AS mean, round(stddev_samp(pts), 3) AS sd, round(quantile_cont(pts, 0.99), 3) AS p99, round(quantile_cont(pts, 0.01), 3) AS p1 FROM b GROUP BY yr, bin")
def ag12(spark, d):
    b = win.equal_buckets(season(spark, d), ["yr"], "pts", False, [F.col("player")], 10, "bin")
    cells = b.groupBy("yr", "bin").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("pts") * 100).cast("long")).cast("double") / (100 * F.count("*")), 3).alias("mean"), F.round(F.stddev_samp("pts"), 3).alias("sd"))
    ends = stats.quantiles_by(b, ["yr", "bin"], "pts", {"p99": 0.99, "p1": 0.01})
    return cells.join(ends, ["yr", "bin"]).withColumns({c: F.round(c, 3) for c in ("p99", "p1")})


@query("ag13_mean_cv", Q + ", x AS (SELECT (s1 + s2 + s3) / 3 AS m, sqrt((pow(s1 - (s1 + s2 + s3) / 3, 2) + pow(s2 - (s1 + s2 + s3) / 3, 2) + pow(s3 - (s1 + s2 + s3) / 3, 2)) / 2) AS sd FROM sources) SELECT round(avg(CASE WHEN sd <> 0 THEN sd / m END), 6) AS cv FROM x")
def ag13(spark, d):
    cols = [F.col(c) for c in ("s1", "s2", "s3")]
    df = sources(spark, d).dropna(subset=["s1", "s2", "s3"]).select(row_mean(cols).alias("m"), row_std(cols).alias("sd"))
    return df.agg(F.round(F.avg(F.when(F.col("sd") != 0, F.col("sd") / F.col("m"))), 6).alias("cv"))


@query("ag14_median", S + "SELECT pos, yr, round(median(pts), 3) AS med FROM season GROUP BY ALL")
def ag14(spark, d):
    return stats.quantiles_by(season(spark, d), ["pos", "yr"], "pts", {"med": 0.5}).withColumn("med", F.round("med", 3))


@query("ag15_min_max_joined", S + "SELECT player, yr, min(yr) OVER (PARTITION BY player) AS first_yr, max(pts) OVER (PARTITION BY player) AS best FROM season")
def ag15(spark, d):
    w = Window.partitionBy("player")
    return season(spark, d).select("player", "yr", F.min("yr").over(w).alias("first_yr"), F.max("pts").over(w).alias("best"))


@query("ag16_nth_row", S + ", x AS (SELECT *, row_number() OVER (PARTITION BY team, yr ORDER BY pts DESC, player) AS rn, count(*) OVER (PARTITION BY team, yr) AS n FROM season) SELECT team, yr, max(CASE WHEN rn = least(5, n) THEN pts END) AS fifth FROM x GROUP BY team, yr")
def ag16(spark, d):
    df = win.number(season(spark, d), ["team", "yr"], best(), "rn").where("rn <= 5")  # cut before the shuffle
    return df.groupBy("team", "yr").agg(F.max_by("pts", "rn").alias("fifth"))


@query("ag17_distinct_counts", "SELECT CAST(count(DISTINCT l_suppkey) AS BIGINT) AS l_suppkey, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS l_returnflag, CAST(count(DISTINCT l_quantity) AS BIGINT) AS l_quantity FROM lineitem")
def ag17(spark, d):
    return table(spark, d, "lineitem").agg(*(F.count_distinct(c).alias(c) for c in ("l_suppkey", "l_returnflag", "l_quantity")))


@query("ag18_distinct_with_flag", "SELECT DISTINCT s_nationkey AS nation, 1 AS has_supplier FROM supplier")
def ag18(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit(1).alias("has_supplier")).distinct()


@query("ag20_keep_first", S + "SELECT player, yr, pts FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY pts DESC, yr) AS rn FROM season) WHERE rn = 1")
def ag20(spark, d):
    return win.keep_first(season(spark, d), ["player"], [F.desc("pts"), F.col("yr")]).select("player", "yr", "pts")


@query("ag22_correlations", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS qty_price, round(corr(l_quantity, l_discount), 6) AS qty_disc, round(corr(l_tax, l_extendedprice), 6) AS tax_price FROM lineitem")
def ag22(spark, d):
    r = lambda a, b, n: F.round(F.corr(a, b), 6).alias(n)
    return table(spark, d, "lineitem").agg(r("l_quantity", "l_extendedprice", "qty_price"), r("l_quantity", "l_discount", "qty_disc"), r("l_tax", "l_extendedprice", "tax_price"))


@query("ag23_pivot", "SELECT l_suppkey, coalesce(round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 2), 0) AS A, coalesce(round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 2), 0) AS N, coalesce(round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 2), 0) AS R FROM lineitem GROUP BY l_suppkey")
def ag23(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 2)).fillna(0.0)


@query("ag24_value_counts", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def ag24(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy("c_mktsegment")


@query("ag27_expanding", S + "SELECT player, yr, round(max(pts) OVER w, 2) AS best, round(sum(pts) OVER w, 2) AS total, round(avg(pts) OVER w, 4) AS mean FROM season WINDOW w AS (PARTITION BY player ORDER BY yr)")
def ag27(spark, d):
    df = season(spark, d)
    for agg, name in (("max", "best"), ("sum", "total"), ("mean", "mean")):
        df = win.running(df, ["player"], ["yr"], "pts", agg, name)
    return df.select("player", "yr", F.round("best", 2).alias("best"), F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"))


@query("ag28_experience_difference", S + ", x AS (SELECT *, yr - min(yr) OVER (PARTITION BY player) AS tenure FROM season) SELECT player, yr, CAST(tenure AS INT) AS tenure, round(pts - avg(pts) OVER (PARTITION BY tenure), 4) AS exp_diff, round(pts / avg(pts) OVER (PARTITION BY tenure), 6) AS exp_div FROM x")
def ag28(spark, d):
    df = season(spark, d).withColumn("tenure", F.col("yr") - F.min("yr").over(Window.partitionBy("player")))
    means = df.groupBy("tenure").agg(F.avg("pts").alias("mean"))  # a level is a hot key: aggregate, then join its few rows
    return df.join(F.broadcast(means), "tenure").select("player", "yr", "tenure", F.round(F.col("pts") - F.col("mean"), 4).alias("exp_diff"), F.round(F.try_divide("pts", "mean"), 6).alias("exp_div"))


@query("ag29_class_separation", S + ", m AS (SELECT pts > 500000 AS cls, median(pts) AS p, median(games) AS g FROM season GROUP BY 1) SELECT round(abs(max(CASE WHEN cls THEN p END) - max(CASE WHEN NOT cls THEN p END)) / (SELECT avg(abs(pts)) FROM season), 6) AS pts, round(abs(max(CASE WHEN cls THEN g END) - max(CASE WHEN NOT cls THEN g END)) / (SELECT avg(abs(games)) FROM season), 6) AS games FROM m")
def ag29(spark, d):
    df = season(spark, d).withColumn("cls", F.col("pts") > 500000)
    median = {c: stats.quantiles_by(df, ["cls"], c, {c: 0.5}) for c in ("pts", "games")}
    m = median["pts"].join(median["games"], "cls").agg(*(F.max(F.when(F.col("cls") == v, F.col(c))).alias(f"{c}_{v}") for c in ("pts", "games") for v in (True, False)))
    means = df.agg(*(F.avg(F.abs(c)).alias(f"{c}_m") for c in ("pts", "games")))
    both = m.join(F.broadcast(means))  # one row each
    return both.select(*(F.round(F.abs(F.col(f"{c}_True") - F.col(f"{c}_False")) / F.col(f"{c}_m"), 6).alias(c) for c in ("pts", "games")))


@query("ag30_histogram", "SELECT o_orderpriority, CAST(floor(o_totalprice / 50000) AS INT) AS slot, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def ag30(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", F.floor(F.col("o_totalprice") / 50000).cast("int").alias("slot")).agg(F.count("*").alias("n"))


@query("wn1_rolling3", S + "SELECT player, yr, round(avg(pts) OVER w, 4) AS pts_r3_mean, round(max(pts) OVER w, 2) AS pts_r3_max FROM season WINDOW w AS (PARTITION BY player ORDER BY yr ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def wn1(spark, d):
    df = win.rolling(win.rolling(season(spark, d), ["player"], ["yr"], ["pts"], 3, "mean"), ["player"], ["yr"], ["pts"], 3, "max")
    return df.select("player", "yr", F.round("pts_r3_mean", 4).alias("pts_r3_mean"), F.round("pts_r3_max", 2).alias("pts_r3_max"))


@query("wn2_rolling_full", S + "SELECT player, yr, round(CASE WHEN count(pts) OVER w < 3 THEN -1 ELSE avg(pts) OVER w END, 4) AS r FROM season WINDOW w AS (PARTITION BY player ORDER BY yr ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def wn2(spark, d):
    return win.rolling(season(spark, d), ["player"], ["yr"], ["pts"], 3, "mean", least=3, fill=-1.0).select("player", "yr", F.round("pts_r3_mean", 4).alias("r"))


@query("wn3_rolling_sum", S + "SELECT player, yr, CAST(sum(games) OVER w AS BIGINT) AS games3 FROM season WINDOW w AS (PARTITION BY player ORDER BY yr ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def wn3(spark, d):
    return win.rolling(season(spark, d), ["player"], ["yr"], ["games"], 3, "sum").select("player", "yr", F.col("games_r3_sum").alias("games3"))


@query("wn4_lead", S + "SELECT player, yr, lead(pts) OVER w AS pts_next, lead(games) OVER w AS games_next FROM season WINDOW w AS (PARTITION BY player ORDER BY yr)")
def wn4(spark, d):
    w = Window.partitionBy("player").orderBy("yr")
    return season(spark, d).select("player", "yr", F.lead("pts").over(w).alias("pts_next"), F.lead("games").over(w).alias("games_next"))


@query("wn5_lag_fallback", S + "SELECT player, yr, coalesce(lag(games) OVER (PARTITION BY player ORDER BY yr), games) AS last_games FROM season")
def wn5(spark, d):
    return season(spark, d).select("player", "yr", F.coalesce(F.lag("games").over(Window.partitionBy("player").orderBy("yr")), "games").alias("last_games"))


@query("wn6_neighbour_gaps", S + "SELECT player, yr, round(coalesce(pts - lead(pts) OVER w, 0), 2) AS to_next, round(coalesce(pts - lag(pts) OVER w, 0), 2) AS to_last FROM season WINDOW w AS (PARTITION BY team, yr ORDER BY pts DESC, player)")
def wn6(spark, d):
    w = Window.partitionBy("team", "yr").orderBy(*best())
    gap = lambda f: F.round(F.coalesce(F.col("pts") - f("pts").over(w), F.lit(0.0)), 2)
    return season(spark, d).select("player", "yr", gap(F.lead).alias("to_next"), gap(F.lag).alias("to_last"))


@query("wn7_rank_min", S + ", x AS (SELECT *, CASE WHEN games > 1 THEN games END AS g FROM season) SELECT player, yr, g, CASE WHEN g IS NOT NULL THEN CAST(rank() OVER (PARTITION BY team, yr ORDER BY g DESC NULLS LAST) AS INT) END AS r, CASE WHEN g IS NOT NULL THEN round(ln(rank() OVER (PARTITION BY team, yr ORDER BY g DESC NULLS LAST) + 1), 6) END AS log_r FROM x")
def wn7(spark, d):
    df = season(spark, d).withColumn("g", F.when(F.col("games") > 1, F.col("games")))
    return win.rank_min(df, ["team", "yr"], "g", "r").select("player", "yr", "g", "r", F.round(F.log(F.col("r") + 1), 6).alias("log_r"))


@query("wn8_unique_rank", S + "SELECT player, yr, CAST(row_number() OVER (PARTITION BY team, yr ORDER BY pts DESC, player) AS INT) AS r FROM season")
def wn8(spark, d):
    return win.number(season(spark, d), ["team", "yr"], best(), "r").select("player", "yr", "r")


@query("wn10_depth_chart", S + ", x AS (SELECT *, concat(left(pos, 2), CAST(row_number() OVER (PARTITION BY team, yr, pos ORDER BY pts DESC, player) - 1 AS VARCHAR)) AS label FROM season) SELECT player, yr, label FROM x WHERE label IN ('AU0', 'BU0', 'BU1', 'FU0', 'FU1', 'FU2')")
def wn10(spark, d):
    df = win.number(season(spark, d), ["team", "yr", "pos"], best(), "rn", start=0)
    label = F.concat(F.left("pos", F.lit(2)), F.col("rn").cast("string"))
    return df.select("player", "yr", label.alias("label")).where(F.col("label").isin("AU0", "BU0", "BU1", "FU0", "FU1", "FU2"))


@query("wn11_forward_fill", S + ", x AS (SELECT player, yr, CASE WHEN player % 3 = 0 AND yr % 2 = 0 THEN NULL ELSE pts END AS v FROM season) SELECT player, yr, last_value(v IGNORE NULLS) OVER (PARTITION BY player ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM x")
def wn11(spark, d):
    v = F.when((F.col("player") % 3 == 0) & (F.col("yr") % 2 == 0), None).otherwise(F.col("pts"))
    return win.forward_fill(season(spark, d).select("player", "yr", v.alias("v")), ["player"], ["yr"], ["v"])


@query("wn12_running_min", S + "SELECT player, yr, min(pts) OVER (PARTITION BY player ORDER BY yr) AS low FROM season")
def wn12(spark, d):
    return win.running(season(spark, d), ["player"], ["yr"], "pts", "min", "low").select("player", "yr", "low")


@query("wn13_share", S + "SELECT player, yr, round(pts / (sum(pts) OVER (PARTITION BY team, yr) + 0.5), 8) AS share FROM season")
def wn13(spark, d):
    return win.share(season(spark, d), ["team", "yr"], "pts", 0.5, "share").select("player", "yr", F.round("share", 8).alias("share"))


@query("wn14_team_difference", S + "SELECT player, yr, round(pts - avg(pts) OVER w, 7) AS to_mean, round(pts - min(pts) OVER w, 2) AS to_min, round(pts / sum(pts) OVER w, 8) AS part FROM season WINDOW w AS (PARTITION BY team, yr)")
def wn14(spark, d):
    c = F.col("pts")
    df = win.with_totals(season(spark, d), ["team", "yr"], {"m": F.avg("pts"), "least": F.min("pts"), "s": F.sum("pts")})
    return df.select("player", "yr", F.round(c - F.col("m"), 7).alias("to_mean"), F.round(c - F.col("least"), 2).alias("to_min"), F.round(c / F.col("s"), 8).alias("part"))


@query("wn15_equal_buckets", S + "SELECT player, yr, CAST(floor((row_number() OVER (PARTITION BY yr ORDER BY pts DESC, player) - 1) / ceil(count(*) OVER (PARTITION BY yr) / 6)) AS INT) AS b FROM season")
def wn15(spark, d):
    return win.equal_buckets(season(spark, d), ["yr"], "pts", True, [F.col("player")], 6, "b").select("player", "yr", "b")


@query("wn17_experience", S + ", x AS (SELECT player, yr, CASE WHEN player % 4 = 0 THEN NULL ELSE 1994 + player % 5 END AS drafted, min(yr) OVER (PARTITION BY player) AS first_yr FROM season), e AS (SELECT player, yr, greatest(yr - coalesce(drafted, first_yr), 0) AS exp FROM x) SELECT player, yr, round(least(exp, (SELECT quantile_cont(exp, 0.95) FROM e)), 4) AS exp FROM e")
def wn17(spark, d):
    drafted = F.when(F.col("player") % 4 != 0, 1994 + F.col("player") % 5)
    first = F.min("yr").over(Window.partitionBy("player"))
    e = season(spark, d).select("player", "yr", F.greatest(F.col("yr") - F.coalesce(drafted, first), F.lit(0)).alias("exp"))
    high = stats.quantile(e, "exp", 0.95)
    return e.select("player", "yr", F.round(F.least(F.col("exp").cast("double"), F.lit(high)), 4).alias("exp"))


@query("wn19_top_k_by_table", S + "SELECT player, yr, pos, r FROM (SELECT *, CAST(row_number() OVER (PARTITION BY yr, pos ORDER BY pts DESC, player) AS INT) AS r FROM season) WHERE r <= CASE pos WHEN 'AUTOMOBILE' THEN 5 WHEN 'BUILDING' THEN 10 WHEN 'MACHINERY' THEN 3 ELSE 0 END")
def wn19(spark, d):
    limits = spark.createDataFrame([("AUTOMOBILE", 5), ("BUILDING", 10), ("MACHINERY", 3)], "pos string, k int")
    top = win.number(season(spark, d), ["yr", "pos"], best(), "r").where("r <= 10")  # the greatest k, so that groups are cut before the shuffle
    return top.join(F.broadcast(limits), "pos").where("r <= k").select("player", "yr", "pos", "r")


@query("wn20_replacement_median", S + "SELECT pos, round(median(pts), 3) AS level FROM (SELECT *, row_number() OVER (PARTITION BY yr, pos ORDER BY pts DESC, player) AS rn FROM season) WHERE rn > 15 GROUP BY pos")
def wn20(spark, d):
    rest = win.after_top(season(spark, d), ["yr", "pos"], "pts", "player", 15)
    return stats.quantiles_by(rest, ["pos"], "pts", {"level": 0.5}).withColumn("level", F.round("level", 3))


@query("wn21_snake_order", "SELECT CAST(team AS INT) AS team, CAST(rnd AS INT) AS rnd, CAST((rnd - 1) * 12 + CASE WHEN rnd IN (1) OR (rnd > 2 AND rnd % 2 = 0) THEN team ELSE 13 - team END AS INT) AS pick FROM range(1, 13) a(team), range(1, 26) b(rnd)")
def wn21(spark, d):
    """Serial picks of a snake draft whose third round runs as the second."""
    grid = spark.range(1, 13).select(F.col("id").cast("int").alias("team"), F.explode(F.sequence(F.lit(1), F.lit(25))).alias("rnd"))
    forward = (F.col("rnd") == 1) | ((F.col("rnd") > 2) & (F.col("rnd") % 2 == 0))
    return grid.withColumn("pick", ((F.col("rnd") - 1) * 12 + F.when(forward, F.col("team")).otherwise(13 - F.col("team"))).cast("int"))


@query("st2_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def st2(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("st3_arg_min", "SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest FROM part GROUP BY p_brand")
def st3(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"))


@query("set1_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part")
def set1(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return rel.union_all([a, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))])


@query("set2_union_distinct", "SELECT c_nationkey AS nation, 'c' AS side FROM customer UNION SELECT s_nationkey, 's' FROM supplier")
def set2(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("side"))
    return a.union(table(spark, d, "supplier").select("s_nationkey", F.lit("s"))).distinct()


@query("set3_duplicate_slice", S + "SELECT player, yr, pos, pts FROM season UNION ALL SELECT player, yr, 'FLEX' AS pos, pts FROM season WHERE pos IN ('BUILDING', 'FURNITURE')")
def set3(spark, d):
    to = F.when(F.col("pos").isin("BUILDING", "FURNITURE"), F.array("pos", F.lit("FLEX"))).otherwise(F.array("pos"))
    return season(spark, d).withColumn("pos", F.explode(to)).select("player", "yr", "pos", "pts")


@query("set4_replace_by_key", S + "SELECT player, yr, pts FROM season WHERE player % 10 <> 0 UNION ALL SELECT player, CAST(2001 AS INT) AS yr, CAST(0 AS DOUBLE) AS pts FROM (SELECT DISTINCT player FROM season WHERE player % 10 = 0)")
def set4(spark, d):
    old = season(spark, d).select("player", "yr", "pts")
    new = old.where("player % 10 = 0").select("player", F.lit(2001).alias("yr"), F.lit(0.0).alias("pts")).distinct()
    return rel.replace_keys(old, new, ["player"])


@query("ma6_row_statistics", Q + "SELECT part, round((coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / nullif((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT, 0), 4) AS mean, round(coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0), 4) AS total FROM sources")
def ma6(spark, d):
    cols = [F.col(c) for c in ("s1", "s2", "s3")]
    return sources(spark, d).select("part", F.round(row_mean(cols), 4).alias("mean"), F.round(row_sum(cols), 4).alias("total"))


@query("ma3_round_half_even", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS half FROM lineitem")
def ma3(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", half_even(F.col("l_quantity") / 2, 0).alias("half"))

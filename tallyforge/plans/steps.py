"""Queries of single steps that composite queries build on, and of the history benchmark. Sums are of whole cents, so that
they are exact in any order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import clean_name, row_sum, scrub
from tallyforge.operators import relational as rel
from tallyforge.operators import stats
from tallyforge.operators import windows as win
from tallyforge.plans.registry import query, table
from tallyforge.plans.season import SEASON_SQL, SOURCES_SQL, best, season, sources

S = f"WITH {SEASON_SQL} "
Q = f"WITH {SOURCES_SQL} "


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


@query("prj1_subset_and_order", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def prj1(spark, d):
    return table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")


@query("jn7_derived_table", "SELECT p_partkey, p_retailprice, top FROM part JOIN (SELECT p_brand, max(p_retailprice) AS top FROM part GROUP BY p_brand) b ON part.p_brand = b.p_brand")
def jn7(spark, d):
    sql = "SELECT p_partkey, p_retailprice, top FROM {part} a JOIN (SELECT p_brand, max(p_retailprice) AS top FROM {part} GROUP BY p_brand) b ON a.p_brand = b.p_brand"
    return spark.sql(sql, part=table(spark, d, "part"))


@query("jn15_positional_zip", """WITH c AS (SELECT c_nationkey AS nation, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer),
s AS (SELECT s_nationkey AS nation, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier)
SELECT nation, CAST(place AS INT) AS place, c_name, s_name FROM c FULL JOIN s USING (nation, place)""")  # fmt: skip
def jn15(spark, d):
    """Two lists of a nation side by side: the place in each list is the key."""
    left = win.number(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_name"), ["nation"], ["c_custkey"], "place").drop("c_custkey")
    right = win.number(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_name"), ["nation"], ["s_suppkey"], "place").drop("s_suppkey")
    return left.join(right, ["nation", "place"], "full")


@query("jn17_suffixed_self_join", S + "SELECT a.player, a.yr, a.pts, a.games, b.pts AS pts_last, b.games AS games_last FROM season a JOIN season b ON a.player = b.player AND a.yr = b.yr + 1")
def jn17(spark, d):
    df = season(spark, d).select("player", "yr", "pts", "games")
    last = df.select("player", (F.col("yr") + 1).alias("yr"), F.col("pts").alias("pts_last"), F.col("games").alias("games_last"))
    return df.join(last, ["player", "yr"])


@query("ag4_average_by_group", "SELECT p_brand, sum(CAST(round(p_retailprice * 100) AS BIGINT)) / count(*) AS mean_cents FROM part GROUP BY p_brand")
def ag4(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg((F.sum(cents("p_retailprice")) / F.count("*")).alias("mean_cents"))


@query("ag19_distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def ag19(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("ag25_all_sums_by_group", S + "SELECT team, CAST(sum(games) AS BIGINT) AS games, CAST(sum(CAST(round(pts * 100) AS BIGINT)) AS BIGINT) AS cents FROM season GROUP BY team")
def ag25(spark, d):
    """The sums of all numeric columns beside the keys, whatever they are."""
    df = season(spark, d).select("team", "games", cents("pts").alias("cents"))
    return df.groupBy("team").agg(*(F.sum(c).alias(c) for c, kind in df.dtypes if c != "team" and kind in ("int", "bigint", "double")))


@query("wn9_count_in_group", S + "SELECT team, yr, player, CAST(row_number() OVER (PARTITION BY team, yr ORDER BY pts DESC, player) - 1 AS INT) AS place FROM season")
def wn9(spark, d):
    out = win.ranked(season(spark, d), ["team", "yr"], "pts", True, [F.col("player")], "place")
    return out.select("team", "yr", "player", (F.col("place") - 1).cast("int").alias("place"))


@query("str5_token_parts", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, array_to_string(string_split(p_name, ' ')[:-2], ' ') AS without_last, substring(p_brand, 1, 2) AS start, CAST(substring(p_brand, 7) AS INT) AS number FROM part")
def str5(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(
        "p_partkey", F.get(words, F.lit(0)).alias("first"), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ").alias("without_last"),
        F.substring("p_brand", 1, 2).alias("start"), F.substr(F.col("p_brand"), F.lit(7)).try_cast("int").alias("number"),
    )


@query("ma8_tolerant_total", Q + "SELECT part, s1 + s2 AS total, coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0) AS weighted FROM sources")
def ma8(spark, d):
    """Adds those of the named columns that exist, where null propagates; beside it the sum where null counts as 0."""
    df = sources(spark, d)
    there = [F.col(c) for c in ("s1", "s2", "not_there") if c in df.columns]
    return df.select("part", reduce(lambda a, b: a + b, there).alias("total"), row_sum([F.col(c) for c in ("s1", "s2", "s3")]).alias("weighted"))


@query("ma11_age_interactions", S + """, x AS (SELECT *, yr - min(yr) OVER (PARTITION BY player) AS age FROM season)
SELECT player, yr, pts * age AS pts_age, round(exp(-age / 4.0), 6) AS decay, pts / max(pts) OVER (PARTITION BY player) AS of_best, pts / (age + 1) AS pts_per_year FROM x""")  # fmt: skip
def ma11(spark, d):
    own = Window.partitionBy("player")
    df = season(spark, d).withColumn("age", F.col("yr") - F.min("yr").over(own))
    pts, age = F.col("pts"), F.col("age")
    return df.select("player", "yr", (pts * age).alias("pts_age"), F.round(F.exp(-age / 4.0), 6).alias("decay"), (pts / F.max("pts").over(own)).alias("of_best"), (pts / (age + 1)).alias("pts_per_year"))


@query("bz11_experience_benchmark", S + """, x AS (SELECT player, yr, yr - min(yr) OVER (PARTITION BY player) AS tenure, CAST(round(pts * 100) AS BIGINT) AS c FROM season),
f AS (SELECT min(yr) AS y2 FROM season WHERE yr > (SELECT min(yr) FROM season)),
h AS (SELECT t.tenure, y.yr, (SELECT sum(c) / count(*) FROM x WHERE x.tenure = t.tenure AND x.yr <= y.yr + CAST(y.yr <= y2 AS INT)) AS e FROM (SELECT DISTINCT tenure FROM x) t, (SELECT DISTINCT yr FROM x) y, f),
z AS (SELECT player, yr, tenure, c, last_value(e IGNORE NULLS) OVER (PARTITION BY player ORDER BY yr) AS e FROM x LEFT JOIN h USING (tenure, yr))
SELECT player, yr, CAST(tenure AS INT) AS tenure, e AS c_exp, c - e AS c_exp_diff, c / (e + 0.001) AS c_exp_frac,
  round(avg(c - e) OVER w, 3) AS c_exp_diff_r3_mean, max(c - e) OVER w AS c_exp_diff_r3_max FROM z WINDOW w AS (PARTITION BY player ORDER BY yr ROWS 2 PRECEDING)""")  # fmt: skip
def bz11(spark, d):
    """Each season against the mean of all seasons of the same experience so far, and how that gap moves."""
    df = season(spark, d).select("player", "yr", (F.col("yr") - F.min("yr").over(Window.partitionBy("player"))).alias("tenure"), cents("pts").alias("c"))
    history = stats.history_mean(df, "tenure", "yr", "c", "c_exp", ahead=2)
    df = win.forward_fill(df.join(F.broadcast(history), ["tenure", "yr"], "left"), ["player"], ["yr"], ["c_exp"])  # a row per tenure and year
    df = df.withColumns({"c_exp_diff": F.col("c") - F.col("c_exp"), "c_exp_frac": F.col("c") / (F.col("c_exp") + 0.001)})
    for agg in ("mean", "max"):
        df = win.rolling(df, ["player"], ["yr"], ["c_exp_diff"], 3, agg)
    return df.drop("c").withColumn("c_exp_diff_r3_mean", F.round("c_exp_diff_r3_mean", 3))


@query("bz21_range_deviation", Q + "SELECT part, (greatest(s1, s2, s3) - least(s1, s2, s3)) / 5 AS deviation FROM sources")
def bz21(spark, d):
    three = [F.col(c) for c in ("s1", "s2", "s3")]
    return sources(spark, d).select("part", ((F.greatest(*three) - F.least(*three)) / 5).alias("deviation"))


@query("bz31_rank_list", "SELECT c_custkey AS rank, c_name AS player, 'N' || c_nationkey AS team FROM customer WHERE c_acctbal >= 0")
def bz31(spark, d):
    """A ranking as it is downloaded: columns by place, rows without a value, name and team in one cell, pager rows."""
    customer = table(spark, d, "customer")
    raw = customer.select(F.col("c_custkey").cast("string"), F.when(F.col("c_acctbal") >= 0, F.concat_ws(" ", "c_name", F.concat(F.lit("N"), "c_nationkey"))))
    raw = raw.toDF("0", "1").unionByName(spark.createDataFrame([("Page 1 of 9", "next page")], "`0` string, `1` string"))
    df = raw.toDF("rank", "both").dropna().withColumn("rank", F.col("rank").try_cast("long")).where("rank IS NOT NULL")
    words = F.split("both", " ")
    return df.select("rank", clean_name(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).alias("player"), F.element_at(words, -1).alias("team"))


@query("bz35_measure_repair", "SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1) THEN CASE WHEN p_partkey % 9 = 0 THEN 20 ELSE p_retailprice / 100 END ELSE p_size END AS size FROM part")
def bz35(spark, d):
    """Tokens for a missing measure become null; then the second measurement, then a modelled value."""
    key = F.col("p_partkey")
    raw = F.when(key % 6 == 0, "-").when(key % 6 == 1, "UNK").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("*")))
    second = F.when(key % 9 != 0, F.col("p_retailprice") / 100)
    return table(spark, d, "part").select("p_partkey", F.coalesce(scrub(raw), second, F.lit(20.0)).alias("size"))


FOLD_SQL = "CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 7) AS BIGINT) % 5"


@query("ml10_out_of_fold_mean", f"""WITH x AS (SELECT c_custkey, c_mktsegment AS g, {FOLD_SQL} AS fold, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer),
f AS (SELECT g, fold, sum(c) AS s, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT g, sum(s) AS ts, sum(n) AS tn FROM f GROUP BY g)
SELECT c_custkey, fold, (ts - s) / nullif(tn - n, 0) AS predicted FROM x JOIN f USING (g, fold) JOIN t USING (g)""")  # fmt: skip
def ml10(spark, d):
    """Folds by hash of the key; a row's prediction is the mean of its class over the other folds. A few rows are joined."""
    fold = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 7), 16, 10).cast("long") % 5
    df = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("g"), fold.alias("fold"), cents("c_acctbal").alias("c"))
    parts = df.groupBy("g", "fold").agg(F.sum("c").alias("s"), F.count("*").alias("n"))
    whole = Window.partitionBy("g")
    others = parts.select("g", "fold", F.try_divide(F.sum("s").over(whole) - F.col("s"), F.sum("n").over(whole) - F.col("n")).alias("predicted"))
    return df.join(others, ["g", "fold"]).select("c_custkey", "fold", "predicted")


@query("ml15_class_weights", "WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, n, (SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n) AS weight FROM n")
def ml15(spark, d):
    """Weights for which all classes count alike, for a model's weight column."""
    n = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # over a row per class
    return n.withColumn("weight", F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")))


@query("sm8_selection_summary", """SELECT l_suppkey, count(*) AS picks, count(*) / (SELECT count(*) FROM lineitem) AS share, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) AS mean_cents,
round(quantile_cont(l_extendedprice, 0.8), 3) AS p80 FROM lineitem GROUP BY l_suppkey ORDER BY picks DESC, l_suppkey LIMIT 30""")  # fmt: skip
def sm8(spark, d):
    """How often each is selected, and at which price; the top 30."""
    items = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice")
    found = items.groupBy("l_suppkey").agg(F.count("*").alias("picks"), (F.sum(cents("l_extendedprice")) / F.count("*")).alias("mean_cents"), F.round(F.percentile("l_extendedprice", F.lit(0.8)), 3).alias("p80"))
    total = items.agg(F.count("*").alias("total"))  # one row
    top = found.orderBy(F.desc("picks"), "l_suppkey").limit(30)
    return top.join(F.broadcast(total)).select("l_suppkey", "picks", "mean_cents", "p80", (F.col("picks") / F.col("total")).alias("share")).orderBy(F.desc("picks"), "l_suppkey")


@query("sm9_forced_and_remaining", """WITH need(pos, need) AS (VALUES ('BUILDING', 2), ('FURNITURE', 3), ('MACHINERY', 1)), f AS (SELECT c_mktsegment AS pos, count(*) AS forced FROM customer WHERE c_custkey < 6 GROUP BY 1),
p AS (SELECT c_mktsegment AS pos, count(*) AS pool FROM customer WHERE c_custkey >= 6 AND c_custkey NOT IN (7, 9) GROUP BY 1)
SELECT pos, CAST(greatest(need - coalesce(forced, 0), 0) AS BIGINT) AS remaining, coalesce(pool, 0) AS pool FROM need LEFT JOIN f USING (pos) LEFT JOIN p USING (pos)""")  # fmt: skip
def sm9(spark, d):
    """Players who are added or dropped by force leave the pool; places that are still open by position."""
    players = table(spark, d, "customer").select(F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("pos"))
    added, dropped = spark.range(6).toDF("player"), spark.createDataFrame([(7,), (9,)], "player long")
    need = spark.createDataFrame([("BUILDING", 2), ("FURNITURE", 3), ("MACHINERY", 1)], "pos string, need long")
    forced = players.join(F.broadcast(added), "player", "left_semi").groupBy("pos").agg(F.count("*").alias("forced"))
    pool = players.join(F.broadcast(rel.union_all([added, dropped])), "player", "left_anti").groupBy("pos").agg(F.count("*").alias("pool"))
    out = rel.join_all(need, [forced, pool], ["pos"])
    return out.select("pos", F.greatest(F.col("need") - F.coalesce("forced", F.lit(0)), F.lit(0)).alias("remaining"), F.coalesce("pool", F.lit(0)).alias("pool"))

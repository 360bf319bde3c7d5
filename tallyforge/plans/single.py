"""Queries of single building blocks: projections, text, arithmetic, scaling, metrics, selection, penalised regression."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import clean_name, weighted_sum
from tallyforge.functions.text import similarity
from tallyforge.operators import models, stats
from tallyforge.operators import relational as rel
from tallyforge.operators import windows as win
from tallyforge.plans.registry import query, table
from tallyforge.plans.season import SEASON_SQL, SOURCES_SQL, best, season, sources
from tallyforge.sources.files import header_names

S = f"WITH {SEASON_SQL} "
Q = f"WITH {SOURCES_SQL} "


@query("prj6_constant_columns", "SELECT *, 2025 AS year, 'feed' AS source FROM nation")
def prj6(spark, d):
    return table(spark, d, "nation").withColumns({"year": F.lit(2025), "source": F.lit("feed")})


@query("prj7_drop_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def prj7(spark, d):
    """By name, by pattern, and names that aren't there."""
    df = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    return df.drop("s_name", "not_there", *(c for c in df.columns if c.endswith("nationkey")))


@query("prj8_unique_names", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def prj8(spark, d):
    """Of columns with one name the first stays."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("key"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), "r_name", F.col("r_name").alias("n_name"))
    return rel.first_of_names(n.alias("a").join(r.alias("b"), F.col("a.key") == F.col("b.key"))).drop("key")


@query("ag2_aggregates_by_dict", "SELECT l_returnflag, sum(CAST(l_quantity AS BIGINT)) AS l_quantity_sum, sum(l_linenumber) AS l_linenumber_sum, max(l_linenumber) AS l_linenumber_max FROM lineitem GROUP BY 1")
def ag2(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long"))
    wanted = {c: ["sum"] for c in ("l_quantity", "l_linenumber")} | {"l_linenumber": ["sum", "max"]}
    return df.groupBy("l_returnflag").agg(*(F.expr(f"{f}({c})").cast("long").alias(f"{c}_{f}") for c, fs in wanted.items() for f in fs))


@query("st5_order_by", "SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def st5(spark, d):
    table(spark, d, "part").createOrReplaceTempView("tf_part")
    return spark.sql("SELECT p_brand, p_size, p_partkey FROM tf_part ORDER BY p_brand, p_size DESC, p_partkey")


@query("str6_header_names", "SELECT n_nationkey AS nation_id, n_name AS nation_full_name, n_regionkey AS region_key_pct FROM nation")
def str6(spark, d):
    names = header_names(["Nation", "", "Region"], ["ID", "Full Name", "Key %"])
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").toDF(*names)


@query("str10_similarity", "SELECT n_nationkey, round(2 * list_sum(list_transform(list_distinct(string_split(n_name, '')), lambda c: least(length(n_name) - length(replace(n_name, c, '')), length(r_name) - length(replace(r_name, c, ''))))) / (length(n_name) + length(r_name)), 6) AS score FROM nation JOIN region ON n_regionkey = r_regionkey")
def str10(spark, d):
    pairs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.select("n_nationkey", F.round(similarity(F.col("n_name"), F.col("r_name")), 6).alias("score"))


@query("str11_concatenated", "SELECT o_orderkey, o_orderstatus || '_' || year(o_orderdate) AS label FROM orders")
def str11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("_", "o_orderstatus", F.year("o_orderdate")).alias("label"))


@query("str1_name_renames", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'Renamed One' WHEN c_custkey % 7 = 1 THEN 'Smith Jones' ELSE 'Amon Rast' END AS name FROM customer")
def str1_renames(spark, d):
    """Marks and suffixes go, hyphens become blanks, then known other names."""
    key = F.col("c_custkey") % 7
    raw = F.when(key == 0, "old n'ame III").when(key == 1, "Smith-Jones Jr.").otherwise("amon *rast, II")
    return table(spark, d, "customer").select("c_custkey", clean_name(raw, {"Old Name": "Renamed One"}).alias("name"))


@query("ma1_logs", "SELECT p_partkey, round(ln(p_retailprice), 8) AS l, round(ln(p_size + 1), 8) AS l1, round(exp(-p_size / 10.0), 8) AS e FROM part")
def ma1(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.log("p_retailprice"), 8).alias("l"), F.round(F.log(F.col("p_size") + 1.0), 8).alias("l1"), F.round(F.exp(-F.col("p_size") / 10.0), 8).alias("e"))


@query("ma2_roots", "SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 8) AS root, s_acctbal * s_acctbal AS square, abs(s_acctbal) AS size FROM supplier")
def ma2(spark, d):
    c = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", F.round(F.sqrt(F.abs(c)), 8).alias("root"), (c * c).alias("square"), F.abs(c).alias("size"))


@query("ma4_clip", "SELECT s_suppkey, least(greatest(s_acctbal, 0), 5000) AS clipped FROM supplier")
def ma4(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.least(F.greatest(F.col("s_acctbal"), F.lit(0.0)), F.lit(5000.0)).alias("clipped"))


@query("ma5_where", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 1 ELSE 0 END AS INT) AS bonus FROM lineitem")
def ma5(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(q >= 40, 3).when(q >= 20, 1).otherwise(0).alias("bonus"))


@query("ma7_weighted_sum", Q + "SELECT part, round(coalesce(s1, 0) * 0.1 + coalesce(s2, 0) * 0.5 + coalesce(s3, 0) * -2, 6) AS pts FROM sources")
def ma7(spark, d):
    return sources(spark, d).select("part", F.round(weighted_sum({"s1": 0.1, "s2": 0.5, "s3": -2}), 6).alias("pts"))


@query("bz51_columns_to_fill", Q + "SELECT part, round(coalesce(s1, s3), 6) AS s1, round(coalesce(s2, s3), 6) AS s2 FROM sources")
def bz51(spark, d):
    """The columns of a statistic are listed by source, without the one that fills them."""
    df = sources(spark, d)
    some = rel.columns_to_fill("s", ["1", "2", "3"], drop=["3"])
    return df.select("part", *(F.round(F.coalesce(c, "s3"), 6).alias(c) for c in some))


ML6_SQL = """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem), m AS (SELECT avg(q) AS m, stddev_pop(q) AS sd, min(q) AS lo, max(q) AS hi, median(q) AS med, quantile_cont(q, 0.75) - quantile_cont(q, 0.25) AS iqr FROM x)
SELECT l_orderkey, l_linenumber, round((q - m) / sd, 6) AS standard, round((q - lo) / (hi - lo), 6) AS unit, round((q - med) / iqr, 6) AS robust FROM x, m"""


@query("ml6_scalers", ML6_SQL)
def ml6(spark, d):
    """All three scalers from one row of statistics."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return models.scaled(x, "q").select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("standard", "unit", "robust")))


ML21_SQL = S + """, r AS (SELECT yr, player, pts, ln(row_number() OVER (PARTITION BY yr, pos ORDER BY pts DESC, player) + 1) AS x FROM season), y AS (SELECT yr, count(*) AS n, sum(x) AS sx, sum(pts) AS sy, sum(x * pts) AS xy, sum(x * x) AS xx FROM r GROUP BY yr),
c AS (SELECT yr, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(xy) OVER w AS xy, sum(xx) OVER w AS xx FROM y WINDOW w AS (ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT yr, (n * xy - sx * sy) / (n * xx - sx * sx) AS slope, (sy - (n * xy - sx * sy) / (n * xx - sx * sx) * sx) / n AS start FROM c WHERE n IS NOT NULL)
SELECT player, yr, round(start + slope * x, 1) AS predicted FROM r JOIN b USING (yr)"""  # fmt: skip


@query("ml21_rank_baseline", ML21_SQL)
def ml21(spark, d):
    """Points from the logarithm of the rank alone, learned from the years before: what a model has to beat."""
    r = win.ranked(season(spark, d), ["yr", "pos"], "pts", True, [F.col("player")], "rank").select("yr", "player", "pts", F.log(F.col("rank") + 1.0).alias("x"))
    return models.expanding_line(r, "yr", "x", "pts", "predicted").select("player", "yr", F.round("predicted", 1).alias("predicted"))


ML19B_SQL = S + """, x AS (SELECT games / 10.0 AS p, (pts > 400000)::INT AS y FROM season), m AS (SELECT sum(((p >= 0.5) AND y = 1)::INT)::DOUBLE AS tp, sum(((p >= 0.5) AND y = 0)::INT)::DOUBLE AS fp, sum(((p < 0.5) AND y = 1)::INT)::DOUBLE AS fn, sum(((p < 0.5) AND y = 0)::INT)::DOUBLE AS tn, avg((p - y) * (p - y)) AS brier FROM x)
SELECT round(brier, 8) AS brier, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 8) AS matthews FROM m"""  # fmt: skip


@query("ml19_class_metrics", ML19B_SQL)
def ml19_class(spark, d):
    x = season(spark, d).select((F.col("games") / 10.0).alias("p"), (F.col("pts") > 400000).cast("int").alias("y"))
    return stats.class_metrics(x, "p", "y").select(F.round("brier", 8).alias("brier"), F.round("matthews", 8).alias("matthews"))


@query("ml10_stratified_folds", "SELECT c_custkey, c_mktsegment, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 7) AS BIGINT), c_custkey) - 1) % 5 AS INT) AS fold FROM customer")
def ml10_stratified(spark, d):
    """Every class is dealt out evenly: a row's place in its class by hash of the key, modulo the folds."""
    turn = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 7), 16, 10).cast("long")
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment", turn.alias("turn"))
    out = win.ranked(df, ["c_mktsegment"], "turn", False, [F.col("c_custkey")], "place")
    return out.select("c_custkey", "c_mktsegment", ((F.col("place") - 1) % 5).cast("int").alias("fold"))


ML7_SQL = """WITH x AS (SELECT l_extendedprice AS y, l_quantity, l_discount, l_tax FROM lineitem),
f AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([corr(l_quantity, y), corr(l_discount, y), corr(l_tax, y)]) AS r, count(*) AS n FROM x)
SELECT feature, CAST(rank AS INT) AS rank FROM (SELECT feature, row_number() OVER (ORDER BY abs(r) DESC, feature) AS rank FROM f) WHERE rank <= 2"""


@query("ml7_best_features", ML7_SQL)
def ml7_best(spark, d):
    """The k features of greatest F value for a linear fit, which orders features as their squared correlation does."""
    found = stats.best_features(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 2)
    return spark.createDataFrame([(c, k + 1) for k, c in enumerate(found)], "feature string, rank int")


ML1_SQL = S + """, x AS (SELECT pos, CAST(games AS DOUBLE) AS x, pts / 1e5 AS y FROM season), m AS (SELECT pos, covar_pop(y, x) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM x GROUP BY pos),
b AS (SELECT pos, mx, my, c / (v + 0.5) AS ridge, sign(c) * greatest(abs(c) - 0.5, 0) / v AS lasso, sign(c) * greatest(abs(c) - 0.5 * 0.4, 0) / (v + 0.5 * 0.6) AS net FROM m)
SELECT pos, round(ridge, 6) AS ridge, round(lasso, 6) AS lasso, round(net, 6) AS net, round(my - ridge * mx, 6) AS ridge_start, round(my - lasso * mx, 6) AS lasso_start, round(my - net * mx, 6) AS net_start FROM b"""  # fmt: skip


@query("ml1_penalised_lines", ML1_SQL)
def ml1_penalised(spark, d):
    """Ridge, lasso and elastic net of one feature in closed form, all positions in one aggregation."""
    x = season(spark, d).select("pos", F.col("games").cast("double").alias("x"), (F.col("pts") / 1e5).alias("y"))
    out = x.groupBy("pos").agg(*models.moments("x", "y"))
    for name, part in (("ridge", 0.0), ("lasso", 1.0), ("net", 0.4)):
        out = models.penalised_line(out, name, 0.5, part)
    return out.select("pos", *(F.round(c, 6).alias(c) for n in ("ridge", "lasso", "net") for c in (n, f"{n}_start")))


PICKS_SQL = S.removeprefix("WITH ") + """, n AS (SELECT *, row_number() OVER (PARTITION BY yr, pos ORDER BY pts DESC, player) AS rn, count(*) OVER (PARTITION BY yr, pos) AS n, CASE pos WHEN 'AUTOMOBILE' THEN 12 WHEN 'BUILDING' THEN 28 WHEN 'FURNITURE' THEN 44 ELSE 12 END AS k FROM season),
v AS (SELECT yr, player, pts - max(CASE WHEN rn = least(k, n) THEN pts END) OVER (PARTITION BY yr, pos) AS vor, pts FROM n),
s AS (SELECT vor, row_number() OVER (PARTITION BY yr ORDER BY pts DESC, player) AS slot FROM v), m AS (SELECT slot, median(vor) AS med FROM s WHERE slot <= 300 GROUP BY slot)"""  # fmt: skip
BZ18_SQL = f"WITH {PICKS_SQL}" + """,
w AS (SELECT a.slot, sum((1 - pow(abs(a.slot - b.slot) / 13.0, 3)) * b.med) / sum(1 - pow(abs(a.slot - b.slot) / 13.0, 3)) AS smooth FROM m a JOIN m b ON abs(a.slot - b.slot) <= 12 GROUP BY a.slot)
SELECT CAST(slot AS INT) AS slot, round(smooth, 3) AS smooth, round(min(smooth) OVER (ORDER BY slot), 3) AS value FROM w"""  # fmt: skip


def pick_values(spark, d):
    """The median of the value over replacement of each slot of a draft over the years: slot, med."""
    ranks = {"AUTOMOBILE": 12, "BUILDING": 28, "FURNITURE": 44, "MACHINERY": 12, "HOUSEHOLD": 12}
    v = win.over_replacement(season(spark, d), ["yr", "pos"], "pos", "pts", ranks, best(), "vor")
    return win.number(v, ["yr"], best(), "slot").where("slot <= 300").groupBy("slot").agg(F.median("vor").alias("med"))


@query("bz18_value_curve", BZ18_SQL)
def bz18_curve(spark, d):
    """Value over replacement by pick: the median of each slot over the years, smoothed, then its running minimum. A slot is
    a place in the draft, of which there are 300, so the curve is a small table."""
    slots = pick_values(spark, d)
    curve = models.smoothed(slots, "slot", "med", 12, "smooth")
    value = F.min("smooth").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return curve.select("slot", F.round("smooth", 3).alias("smooth"), F.round(value, 3).alias("value"))


SM11_SQL = S + """, a AS (SELECT player, avg(pts) AS m, count(*) AS n FROM season GROUP BY player), r AS (SELECT player, row_number() OVER (ORDER BY m DESC, player) AS adp FROM a WHERE n >= 6)
SELECT player, CAST(adp >= 1 AS INT) AS pick_1, CAST(adp >= 24 AS INT) AS pick_24, CAST(adp >= 25 AS INT) AS pick_25, CAST(adp >= 48 AS INT) AS pick_48 FROM r WHERE adp <= 60"""  # fmt: skip


@query("sm11_pick_matrix", SM11_SQL)
def sm11_matrix(spark, d):
    """A row per player of a draft's list, a column per pick: 1 where the player should still be there."""
    a = season(spark, d).groupBy("player").agg(F.avg("pts").alias("m"), F.count("*").alias("n")).where("n >= 6")
    top = a.orderBy(F.desc("m"), "player").limit(60)  # the list's length is the feature
    r = win.number(top.withColumn("all", F.lit(1)), ["all"], [F.desc("m"), F.col("player")], "adp")
    long = r.select("player", "adp", F.explode(F.array(*map(F.lit, (1, 24, 25, 48)))).alias("pick"))
    flags = long.groupBy("player").pivot("pick", [1, 24, 25, 48]).agg(F.max((F.col("adp") >= F.col("pick")).cast("int")))
    return flags.withColumnsRenamed({str(k): f"pick_{k}" for k in (1, 24, 25, 48)})


SM13_SQL = S + """, p AS (SELECT player, pos, ln(1 + sum(games)) AS x, avg(pts) / 1e5 AS m, stddev_samp(pts) / 1e5 AS sd FROM season GROUP BY player, pos),
g AS (SELECT *, x - avg(x) OVER w AS dx, m - avg(m) OVER w AS dm, sd - avg(sd) OVER w AS ds, avg(m) OVER w AS mm, avg(sd) OVER w AS ms FROM p WHERE sd IS NOT NULL WINDOW w AS (PARTITION BY pos)),
b AS (SELECT sum(dx * dm) / sum(dx * dx) AS bm, sum(dx * ds) / sum(dx * dx) AS bs FROM g)
SELECT player, round(mm + bm * dx, 6) AS expected, round(ms + bs * dx, 6) AS deviation, round(m - mm - bm * dx, 6) AS marginal FROM g, b"""  # fmt: skip


@query("sm13_expected_points", SM13_SQL)
def sm13_expected(spark, d):
    """Mean and deviation of points by position and logarithm of the price, each one linear model with an intercept per
    position, and what a player brings beyond them. Positions come from sums by position, which are joined back."""
    p = season(spark, d).groupBy("player", "pos").agg(F.log(F.sum("games") + 1.0).alias("x"), (F.avg("pts") / 1e5).alias("m"), (F.stddev_samp("pts") / 1e5).alias("sd")).where("sd IS NOT NULL")
    out = models.lines_by_group(p, "pos", "x", {"m": "expected", "sd": "deviation"})
    return out.select("player", F.round("expected", 6).alias("expected"), F.round("deviation", 6).alias("deviation"), F.round(F.col("m") - F.col("expected"), 6).alias("marginal"))


SM13B_SQL = S + """, a AS (SELECT pos, avg(pts) AS w FROM season WHERE pos NOT IN ('AUTOMOBILE', 'MACHINERY') GROUP BY pos) SELECT pos, round(w / sum(w) OVER () * 120, 6) AS money FROM a"""


@query("sm13_remaining_money", SM13B_SQL)
def sm13_money(spark, d):
    """The money that is left, over the places that are still open, by their weights."""
    a = season(spark, d).where(~F.col("pos").isin("AUTOMOBILE", "MACHINERY")).groupBy("pos").agg(F.avg("pts").alias("w"))
    return a.select("pos", F.round(F.col("w") / F.sum("w").over(Window.partitionBy()) * 120, 6).alias("money"))  # a row per position

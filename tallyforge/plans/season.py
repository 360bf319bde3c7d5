"""The inputs that the queries share, in both dialects: a player is a customer, a season a year of orders, a team a nation,
a position a market segment; several price estimates of a part stand for projection sources. Points are sums of whole cents,
so that they are the same in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.registry import table

SEASON_SQL = """season AS (
  SELECT o_custkey AS player, CAST(year(o_orderdate) AS INT) AS yr, c_nationkey AS team, c_mktsegment AS pos,
    CAST(count(*) AS BIGINT) AS games, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS pts
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""

SOURCES_SQL = """sources AS (
  SELECT p_partkey AS part, p_brand AS brand, p_size AS size,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS s1,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice * 1.1 END AS s2,
    CASE WHEN p_partkey % 35 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN p_retailprice ELSE p_retailprice + p_size END AS s3
  FROM part)"""


def season(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("yr"), "o_totalprice")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team"), F.col("c_mktsegment").alias("pos"))
    sums = orders.groupBy("o_custkey", "yr").agg(F.count("*").alias("games"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100).alias("pts"))
    return sums.join(people, "o_custkey").select(F.col("o_custkey").alias("player"), "yr", "team", "pos", "games", "pts")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    return part.select(
        key.alias("part"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"),
        F.when(key % 7 != 0, price).alias("s1"), F.when(key % 5 != 0, price * 1.1).alias("s2"),
        F.when(key % 35 == 0, None).when(key % 11 == 0, price).otherwise(price + F.col("p_size")).alias("s3"),
    )


def best() -> list:
    """The order of a ranking: most points first, ties by player."""
    return [F.desc("pts"), F.col("player")]

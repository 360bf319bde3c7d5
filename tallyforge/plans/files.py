"""Queries of sources and sinks: each writes a table or file to the shared folder by one operator and reads it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import stats
from tallyforge.plans.registry import query, table
from tallyforge.plans.season import SEASON_SQL, season
from tallyforge.sources import files, tables
from tallyforge.sources.shared import folder

S = f"WITH {SEASON_SQL} "
SUPPLIERS = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"


def _suppliers(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")


@query("src1_csv_scan", SUPPLIERS)
def src1(spark, d):
    """A CSV feed with lines that have too few or too many cells, which are skipped."""
    with folder(spark) as path:
        lines = _suppliers(spark, d).select(F.concat_ws(",", "s_suppkey", "s_name", "s_acctbal").alias("value"))
        lines.unionByName(spark.createDataFrame([("broken,line",), ("not a number,x,y,z,1",)], "value string")).write.text(f"{path}/feed.csv")
        return files.read_delimited(spark, f"{path}/feed.csv", "s_suppkey long, s_name string, s_acctbal double", header=False).checkpoint()


@query("src2_tsv_scan", SUPPLIERS)
def src2(spark, d):
    """A tab-separated feed whose header has one name twice; columns go by place."""
    with folder(spark) as path:
        _suppliers(spark, d).toDF("Id", "Team", "Team ").write.option("sep", "\t").option("header", True).csv(f"{path}/feed.tsv")
        return files.read_delimited(spark, f"{path}/feed.tsv", "s_suppkey long, s_name string, s_acctbal double", sep="\t").checkpoint()


@query("src3_headerless_scan", SUPPLIERS)
def src3(spark, d):
    with folder(spark) as path:
        _suppliers(spark, d).write.option("header", False).csv(f"{path}/feed.csv")
        return files.read_delimited(spark, f"{path}/feed.csv", "s_suppkey long, s_name string, s_acctbal double", header=False).checkpoint()


@query("src4_two_row_header", "SELECT CAST(s_suppkey AS VARCHAR) AS supplier_id, s_name AS supplier_name, CAST(s_nationkey AS VARCHAR) AS home_nation_pct FROM supplier")
def src4(spark, d):
    """The upper header row is blank where its last text goes on."""
    with folder(spark) as path:
        rows = table(spark, d, "supplier").select(F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey").alias("value"), F.lit(1).alias("at"))
        head = spark.createDataFrame([("Supplier,,Home", -1), ("ID,Name,Nation%", 0)], "value string, at int")
        rows.unionByName(head).coalesce(1).orderBy("at").select("value").write.text(f"{path}/feed.csv")
        read = files.read_two_row_header(spark, f"{path}/feed.csv")
        return read.toDF(*("home_nation_pct" if c == "home_nationpct" else c for c in read.columns)).checkpoint()


@query("src5_value_stream", "SELECT s_name AS name, s_acctbal AS amount, CAST(s_nationkey AS VARCHAR) AS file FROM supplier WHERE s_acctbal IS NOT NULL")
def src5(spark, d):
    """One value per line: a long text is a name, the line after '$' an amount; a file of lines per nation."""
    cells = F.array(F.col("s_name"), F.lit("QB"), F.lit("$"), F.col("s_acctbal").cast("string"))
    lines = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("file"), "s_suppkey", F.posexplode(cells).alias("at", "line"))
    lines = lines.select("file", "line", (F.col("s_suppkey") * 4 + F.col("at")).alias("place"))
    return files.names_and_amounts(lines, "file", "line", "place").select("name", "amount", "file")


@query("src11_json_records", "SELECT s_suppkey, s_name, CAST(2000 + s_nationkey % 3 AS INT) AS year FROM supplier")
def src11(spark, d):
    """A JSON array of records per year, bound together."""
    with folder(spark) as path:
        df = table(spark, d, "supplier").select((2000 + F.col("s_nationkey") % 3).cast("int").alias("year"), F.struct("s_suppkey", "s_name").alias("r"))
        df.select("year", F.to_json(F.array("r")).alias("text")).write.parquet(f"{path}/json")
        return files.records(spark.read.parquet(f"{path}/json"), "text", "s_suppkey: bigint, s_name: string").checkpoint()


@query("src12_folder_of_years", "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def src12(spark, d):
    """Files of one year each, the year in their path only."""
    with folder(spark) as path:
        df = table(spark, d, "orders").select(F.concat_ws(",", "o_orderkey", "o_totalprice").alias("value"), F.year("o_orderdate").alias("y"))
        df.write.partitionBy("y").text(f"{path}/in")
        return files.read_years(spark, f"{path}/in", "o_orderkey long, o_totalprice double", r"y=(\d{4})", header=False, where="file_path").checkpoint()


@query("snk1_append", S + "SELECT player, yr, pts FROM season")
def snk1(spark, d):
    with folder(spark) as path:
        df = season(spark, d).select("player", "yr", "pts")
        for part in ("yr < 1996", "yr >= 1996"):
            tables.append(df.where(part), f"{path}/t", ["yr"])
        return spark.read.parquet(f"{path}/t").select("player", "yr", "pts").checkpoint()


@query("snk2_replace", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def snk2(spark, d):
    """The second write has other columns; nothing of the first is left."""
    with folder(spark) as path:
        tables.replace(table(spark, d, "nation"), f"{path}/t")
        tables.replace(table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name"), f"{path}/t")
        return spark.read.parquet(f"{path}/t").checkpoint()


@query("snk3_slice_replacement", S + "SELECT player, yr, CASE WHEN yr = 2001 THEN round(pts * 2, 2) ELSE pts END AS pts FROM season")
def snk3(spark, d):
    """One slice of a written table is replaced; the others stay as they were."""
    with folder(spark) as path:
        old = season(spark, d).select("player", "yr", "pts")
        tables.replace(old, f"{path}/t", ["yr"])
        new = old.where("yr = 2001").withColumn("pts", F.round(F.col("pts") * 2, 2))
        for _ in range(2):  # a repeated run changes nothing
            tables.replace_slices(new, f"{path}/t", ["yr"])
        return spark.read.parquet(f"{path}/t").select("player", "yr", "pts").checkpoint()


@query("snk5_csv_export", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def snk5(spark, d):
    with folder(spark) as path:
        files.write_csv(_suppliers(spark, d), f"{path}/out", 1)
        return files.read_delimited(spark, f"{path}/out", "s_suppkey long, s_name string, s_acctbal double").checkpoint()


@query("snk8_typed_write", "SELECT CAST(s_suppkey AS INT) AS id, CAST(s_nationkey AS SMALLINT) AS team, s_acctbal AS value FROM supplier")
def snk8(spark, d):
    with folder(spark) as path:
        df = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS team", "s_acctbal AS value")
        tables.replace(tables.typed(df, {"id": "int", "team": "smallint", "value": "double"}), f"{path}/t")
        return spark.read.parquet(f"{path}/t").checkpoint()


@query("snk9_delete_rows", S + "SELECT player, yr, pts FROM season WHERE NOT (yr = 1997 OR (yr = 1998 AND player % 3 = 0))")
def snk9(spark, d):
    """One slice loses all of its rows, another some; the rest isn't written again."""
    with folder(spark) as path:
        tables.replace(season(spark, d).select("player", "yr", "pts"), f"{path}/t", ["yr"])
        tables.delete_where(spark, f"{path}/t", "yr = 1997 OR (yr = 1998 AND player % 3 = 0)", ["yr"])
        return spark.read.parquet(f"{path}/t").select("player", "yr", "pts").checkpoint()


ML22_SQL = S + """, r AS (SELECT CASE pos WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 END AS pkey, pos AS model, games AS x, pts / 1e5 AS y FROM season)
SELECT CAST(pkey AS BIGINT) AS pkey, model, round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS score FROM r WHERE pkey BETWEEN 2 AND 3 GROUP BY ALL"""  # fmt: skip


@query("ml22_run_log", ML22_SQL)
def ml22(spark, d):
    """Three runs are logged with their parameters and scores; the last two are read back by their keys."""
    with folder(spark) as path:
        df = season(spark, d).select("pos", "games", (F.col("pts") / 1e5).alias("y"))
        for pos in ("AUTOMOBILE", "BUILDING", "FURNITURE"):
            fit = df.where(F.col("pos") == pos).agg(F.round(F.regr_slope("y", "games"), 6).alias("slope"), F.round(F.regr_r2("y", "games"), 6).alias("score"))
            last = tables.log_run(spark, f"{path}/runs", fit.select(F.lit(pos).alias("model"), "slope", "score"))
        return tables.runs_between(spark, f"{path}/runs", last - 1, last).select("pkey", "model", "slope", "score").checkpoint()


@query("bz50_slice_loader", S + "SELECT player, yr, pts, round(pts / games, 4) AS per_game FROM season WHERE pos = 'BUILDING'")
def bz50(spark, d):
    """A slice of a wide table that is kept in two parts, without its bookkeeping columns."""
    with folder(spark) as path:
        df = season(spark, d).withColumn("per_game", F.round(F.col("pts") / F.col("games"), 4))
        tables.replace(df.drop("per_game"), f"{path}/one", ["pos"])
        tables.replace(df.select("player", "yr", "per_game"), f"{path}/two")
        got = tables.load_slice(spark, f"{path}/one", {"pos": "BUILDING"}, ["games", "games_next", "season", "team", "pos"], [f"{path}/two"], ["player", "yr"])
        return got.select("player", "yr", "pts", "per_game").checkpoint()


@query("ml8_collinear_pruning", """WITH x AS (SELECT l_quantity, l_quantity * 2 + l_tax AS copy, l_discount, l_tax, l_extendedprice AS y FROM lineitem),
r AS (SELECT unnest(['l_quantity', 'copy', 'l_discount', 'l_tax']) AS c, unnest([abs(corr(l_quantity, y)), abs(corr(copy, y)), abs(corr(l_discount, y)), abs(corr(l_tax, y))]) AS v, abs(corr(l_quantity, copy)) AS twins FROM x),
k AS (SELECT c, v FROM r WHERE NOT (twins > 0.9 AND c IN ('l_quantity', 'copy') AND v < (SELECT max(v) FROM r WHERE c IN ('l_quantity', 'copy'))))
SELECT CAST(row_number() OVER (ORDER BY v DESC, c) - 1 AS INT) AS place, c AS column FROM k""")  # fmt: skip
def ml8(spark, d):
    df = table(spark, d, "lineitem").withColumn("copy", F.col("l_quantity") * 2 + F.col("l_tax"))
    cols = stats.collinear(df, ["l_quantity", "copy", "l_discount", "l_tax"], "l_extendedprice", 0.0, 0.9)
    return spark.createDataFrame(list(enumerate(cols)), "place int, column string")

"""Readers and writers for the file shapes that feeds come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, line_sep: str | None = None) -> DataFrame:
    """CSV or TSV with a fixed schema; malformed lines are skipped. Columns are named by position, so duplicate or
    drifting header names don't matter."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "DROPMALFORMED").option("enforceSchema", True)
    return (reader.option("lineSep", line_sep) if line_sep else reader).csv(path)


def header_names(top: list[str], below: list[str]) -> list[str]:
    """One name for each column of a two-row header: the upper row's last text so far and the lower row's, in lower case
    with underscores."""
    out, last = [], ""
    for a, b in zip(top, below, strict=True):
        last = a.strip() or last
        out.append("_".join(f"{last} {b}".lower().replace("/", " ").replace("%", "pct").split()))
    return out


def read_two_row_header(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A file whose first two lines are one header; only those two lines reach the driver."""
    top, below = (r[0].split(sep) for r in spark.read.text(path).limit(2).collect())
    rows = spark.read.option("sep", sep).option("header", False).csv(path)
    names = header_names(top, below)
    first = [F.coalesce(F.col(c), F.lit("")) for c in rows.columns]
    is_header = lambda line: F.concat_ws("\x1f", *first) == F.lit("\x1f".join(x.strip() for x in line))
    return rows.where(~is_header(top) & ~is_header(below)).toDF(*names)


def names_and_amounts(lines: DataFrame, file: str, line: str, place: str, shortest: int = 7) -> DataFrame:
    """Pairs out of a stream of one value per line: a text longer than `shortest` is a name, the line after '$' an amount;
    the n-th name of a file belongs to the n-th amount. Ordinals are counted file by file."""
    order = Window.partitionBy(file).orderBy(place)
    marked = lines.where(F.trim(line) != "").withColumn("tf_last", F.lag(line).over(order))
    n = F.row_number().over(order).alias("n")
    names = marked.where((F.length(line) > shortest) & line_is_text(line)).select(file, n, F.col(line).alias("name"))
    amounts = marked.where(F.trim("tf_last") == "$").select(file, n, F.col(line).try_cast("double").alias("amount"))
    return names.join(amounts, [file, "n"]).select(file, "n", "name", "amount")


def line_is_text(line: str):
    return F.col(line).try_cast("double").isNull()


def read_years(spark: SparkSession, path: str, schema: str, pattern: str = r"(\d{4})", header: bool = True, where: str = "file_name") -> DataFrame:
    """All files of a folder with the year that is in their name, or in their path (where="file_path")."""
    rows = spark.read.schema(schema).option("header", header).option("recursiveFileLookup", True).csv(path)
    return rows.withColumn("year", F.regexp_extract(F.col("_metadata")[where], pattern, 1).try_cast("int"))


def records(df: DataFrame, text: str, schema: str) -> DataFrame:
    """A JSON array of flat objects per row as rows; text that isn't JSON gives none."""
    return df.select(*(c for c in df.columns if c != text), F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """A table for other programs; a small result may be asked for in a few files."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).csv(path)

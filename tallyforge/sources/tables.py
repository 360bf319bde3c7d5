"""Tables in folders: append, replace, replace a slice, delete rows, and a log of model runs.

A table is a Parquet folder, partitioned by the columns of its slices where it has any. Writers cast to the table's schema
first, so that every part of it has the same types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.shared import delete_path, has_path


def typed(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of schema, in its order and with its types; what doesn't fit a type is an error, not a null."""
    return df.select(*(F.col(c).cast(kind).alias(c) for c, kind in schema.items()))


def append(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partitions or [])).parquet(path)


def replace(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """The whole table anew, with df's schema."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*(partitions or [])).parquet(path)


def replace_slices(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Replace exactly the slices that df has rows in."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def delete_where(spark: SparkSession, path: str, predicate: str, partitions: list[str]) -> None:
    """Delete the rows for which predicate is true. Only slices that have such rows are written again; a slice that loses
    all of its rows is removed. The list of these slices, not their rows, reaches the driver."""
    table = spark.read.parquet(path)
    gone = F.coalesce(F.expr(predicate), F.lit(False))
    hit = table.groupBy(*partitions).agg(F.count_if(gone).alias("tf_gone"), F.count("*").alias("tf_all")).where("tf_gone > 0")
    some = [r.asDict() for r in hit.where("tf_gone < tf_all").select(*partitions).collect()]
    whole = [r.asDict() for r in hit.where("tf_gone = tf_all").select(*partitions).collect()]
    if some:
        keys = spark.createDataFrame([tuple(r[p] for p in partitions) for r in some], table.select(*partitions).schema)
        rest = table.join(F.broadcast(keys), partitions, "left_semi").where(~gone)
        aside = f"{path}.rest"
        replace(rest, aside, partitions)  # a slice isn't read while it is replaced
        replace_slices(spark.read.schema(table.schema).parquet(aside).select(table.columns), path, partitions)
        delete_path(spark, aside)
    for r in whole:
        delete_path(spark, path + "".join(f"/{p}={r[p]}" for p in partitions))


def log_run(spark: SparkSession, path: str, rows: DataFrame, key: str = "pkey") -> int:
    """Append one run's rows under the next free key, which is returned. One writer at a time is expected."""
    last = spark.read.parquet(path).agg(F.max(key)).first()[0] if has_path(spark, path) else None
    mine = (last or 0) + 1
    append(rows.withColumn(key, F.lit(mine).cast("long")), path)
    return mine


def runs_between(spark: SparkSession, path: str, first: int, last: int, key: str = "pkey") -> DataFrame:
    """The rows of a range of runs."""
    return spark.read.parquet(path).where(F.col(key).between(first, last))


def load_slice(spark: SparkSession, path: str, where: dict, drop: list[str], parts: list[str] | None = None, on: list[str] | None = None) -> DataFrame:
    """One slice of a table, which partitions prune, with the columns of further tables that go on with it (wide tables are
    kept in parts), without bookkeeping columns; those that it doesn't have are skipped."""
    df = spark.read.parquet(path)
    for c, v in where.items():
        df = df.where(F.col(c) == v)
    for other in parts or []:
        df = df.join(spark.read.parquet(other), on, "left")
    return df.drop(*drop)

"""Helpers that several training-data operators share: shared storage, size-checked joins, gapless ranks."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.ship import ship
from tallyforge.sources.shared import delete_path, has_path, shared_root  # noqa: F401

#: The white space that separates words in all of these operators: blank and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows up to which a side of (id, flag) rows is sent to every executor: about 64 MB as a hash table.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of an Arrow batch; a longer text comes alone.
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 25
#: Rows in a run of a gapless rank.
RUN_ROWS = 2_048


class Scratch:
    """A folder in the shared storage for the tables between the steps of one operator."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{shared_root(spark)}/tallyforge/{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> str:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        return path

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again: its lineage is cut and a lost executor costs nothing that was done before."""
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A Scratch that is deleted at the end; what leaves the block must have been checkpointed."""
    room = Scratch(spark)
    shared_root(spark)
    try:
        yield room
    finally:
        delete_path(spark, room.path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before a step in Python workers: bound the Arrow batches (smaller settings stay) and give workers the package."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def join_ids(df: DataFrame, ids: DataFrame, on: str | list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df joined with a narrow table by its key columns. The table is broadcast only when it has at most `limit` rows; a larger
    one is joined by shuffle, where adaptive execution splits skewed keys."""
    few = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), on, how)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row's label is held out: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside higher-order functions an expression is otherwise computed for
    each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def gapless(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with a number from 0 without gaps inside each group, by hash of the columns of `order` and then themselves.

    A group is dealt into runs of about RUN_ROWS rows by hash; only the runs' sizes are summed up in order, so no task
    holds a group, however large. Rows that agree in all of `order` share a run, so the last of them should be a row's own
    number. Null groups count as a group. df is read twice and must be a written table.
    """
    run, rank, base, size = (fresh(df, x) for x in ("tf_run", "tf_rank", "tf_base", "tf_size"))
    most = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    runs = max(1, -(-most // RUN_ROWS))
    dealt = df.withColumn(run, F.pmod(F.xxhash64(*order), F.lit(runs)))
    sizes = dealt.groupBy(group, run).agg(F.count("*").alias(size))
    before = Window.partitionBy(group).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col(group).alias("g_"), F.col(run).alias("r_"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias(base))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(group, run).orderBy(*order)) - 1)
    out = ranked.join(bases, F.col(group).eqNullSafe(F.col("g_")) & (F.col(run) == F.col("r_")))
    return out.withColumn(name, (F.col(base) + F.col(rank)).cast("long")).drop("g_", "r_", run, rank, base)

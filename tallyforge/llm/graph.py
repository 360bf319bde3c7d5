"""Connected components by contraction, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch


def components(room: Scratch, edges: DataFrame) -> DataFrame:
    """id and root of every node of the edges (a, b): the root is the least node that can be reached.

    In a round each node takes the least of itself and its neighbours for its parent, parents are replaced by their
    parents until nothing changes, and the edges are mapped to those roots; edges inside a root are gone. Every lookup
    table is written first, so that both sides of a join are dealt by its key and a hot root is split.
    """
    edges = room.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = room.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("root")))
        while True:
            above = parents.select(F.col("id").alias("root"), F.col("root").alias("top"))
            jumped = room.keep(parents.join(above, "root").select("id", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            parents = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        if roots is None:
            roots = parents
        else:
            nxt = parents.select(F.col("id").alias("root"), F.col("root").alias("top"))
            roots = room.keep(roots.join(nxt, "root", "left").select("id", F.coalesce("top", "root").alias("root")))
        side = lambda c: parents.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        edges = room.keep(edges.join(side("a"), "a").join(side("b"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root"))

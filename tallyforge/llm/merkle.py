"""Merkle manifest of a table: a leaf per row, a tree per group, and a tree over the groups' roots.

A leaf is the SHA-256 of a row's fields, each `-` if null and else its UTF-8 length, a colon and itself. Leaves are numbered
in the order of their key inside their group; FAN consecutive nodes make a parent, the SHA-256 of their digests as text, until
one node, the group's root, is left. The groups' roots, the null group first and the others in bytewise order, make a tree of
the same kind.

Each level is a window over (group, parent index) whose full frame holds a node's siblings and the parent's preimage alike;
the first node of each frame stands for the parent in the next level. A frame has at most FAN rows, and numbers come from
range partitions whose sizes are summed up in order, so no task holds a group, however large. Paths go down again: a node's
path is its own siblings and then its parent's path, so only a sixteenth of the rows is joined to the leaves.

Repeated rows and equal keys are all leaves, in the order of key and digest; null keys come first. A group of one row has its
leaf as root. An empty table has an empty manifest. A text of any length, an empty one included, is one field. Extra columns
are ignored unless they are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, join_ids

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The columns that tell groups apart and order them: the null group first.
GROUP = ["tf_named", "tf_group"]
STEP = "struct<left:string,right:string>"


def leaf(**fields: Column) -> Column:
    """The digest of a row's fields, in the order given."""
    text = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def numbered(room: Scratch, df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df as a written table with tf_i, a row's number from 0 in its group, and tf_n, the group's rows."""
    cut = room.keep(df.repartitionByRange(*group, *order).withColumn("tf_run", F.spark_partition_id()))
    sizes = cut.groupBy(*group, "tf_run").agg(F.count("*").alias("tf_size"))
    of_group = Window.partitionBy(*group)  # a row for each range partition that the group reaches into
    before = of_group.orderBy("tf_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*group, "tf_run", F.coalesce(F.sum("tf_size").over(before), F.lit(0)).alias("tf_base"), F.sum("tf_size").over(of_group).alias("tf_n"))
    placed = cut.withColumn("tf_place", F.row_number().over(Window.partitionBy(*group, "tf_run").orderBy(*order)) - 1)
    out = join_ids(placed, room.keep(bases), [*group, "tf_run"], "inner").withColumn("tf_i", F.col("tf_base") + F.col("tf_place"))
    return room.keep(out.drop("tf_run", "tf_base", "tf_place"))


def _framed(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Nodes of groups with more than one, with their parent's number and all digests of its children."""
    parent = nodes.where("tf_n > 1").withColumn("tf_up", F.expr(f"tf_i div {FAN}"))
    frame = Window.partitionBy(*group, "tf_up").orderBy("tf_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parent.withColumn("tf_all", F.collect_list("tf_digest").over(frame))


def levels(room: Scratch, nodes: DataFrame, group: list[str]) -> list[DataFrame]:
    """The nodes of each level, from the leaves to the level where the largest group has one node."""
    out, largest = [nodes], nodes.agg(F.max("tf_n")).first()[0] or 0
    while largest > 1:
        first = _framed(out[-1], group).where(f"tf_i % {FAN} = 0")  # the parents, once each
        up = first.select(*group, F.col("tf_up").alias("tf_i"), F.expr(f"(tf_n + {FAN - 1}) div {FAN}").alias("tf_n"), F.sha2(F.array_join("tf_all", ""), 256).alias("tf_digest"))
        out.append(room.keep(up))
        largest = -(-largest // FAN)
    return out


def tops(tree: list[DataFrame], group: list[str]) -> DataFrame:
    """The root of each group."""
    found = [nodes.where("tf_n = 1").select(*group, "tf_digest") for nodes in tree]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def paths(tree: list[DataFrame], group: list[str], above: DataFrame) -> DataFrame:
    """The leaves of a tree with their group's row of `above` and tf_path: the siblings to the left and right of a leaf and of
    each node over it, then the path of the group's root, which `above` has as tf_path."""
    extra = [c for c in above.columns if c not in (*group, "tf_path")]
    over = None
    for nodes in reversed(tree):
        done = nodes.where("tf_n = 1").join(above, group)
        if over is not None:
            at = F.expr(f"int(tf_i % {FAN})")
            left, right = F.slice("tf_all", F.lit(1), at), F.slice("tf_all", at + 2, F.lit(FAN))
            step = F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
            parent = over.select(*group, F.col("tf_i").alias("tf_up"), *extra, F.col("tf_path").alias("tf_rest"))
            below = _framed(nodes, group).join(parent, [*group, "tf_up"]).withColumn("tf_path", F.concat(step, "tf_rest"))
            done = done.unionByName(below.drop("tf_up", "tf_all", "tf_rest"))
        over = done
    return over


def manifest(room: Scratch, docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: its key and group under their names, leaf, subroot, root, path (an array of left and
    right sibling digests, from the leaf up) and the carried columns. It reads tables in the room."""
    carry = carry or {}
    names = [f"tf_c{k}" for k in range(len(carry))]
    rows = docs.select(F.col(group).isNotNull().alias("tf_named"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("tf_group"), F.col(key).alias("tf_key"), leaf(**{c: F.col(c) for c in fields}).alias("tf_digest"), *(c.alias(n) for c, n in zip(carry.values(), names, strict=True)))
    tree = levels(room, numbered(room, room.keep(rows), GROUP, ["tf_key", "tf_digest"]), GROUP)
    roots = room.keep(tops(tree, GROUP).withColumn("tf_all_groups", F.lit(0)))
    upper = levels(room, numbered(room, roots, ["tf_all_groups"], GROUP), ["tf_all_groups"])
    root = upper[-1].first()
    whole = upper[0].select("tf_all_groups").distinct().withColumn("tf_path", F.array().cast(f"array<{STEP}>"))
    above = room.keep(paths(upper, ["tf_all_groups"], whole).select(*GROUP, F.col("tf_digest").alias("subroot"), "tf_path"))
    out = paths(tree, GROUP, above)
    named = F.when(F.col("tf_named"), F.col("tf_group")).cast(docs.schema[group].dataType)
    return out.select(F.col("tf_key").alias(key), named.alias(group), F.col("tf_digest").alias("leaf"), "subroot", F.lit(root["tf_digest"] if root else None).cast("string").alias("root"), F.col("tf_path").alias("path"), *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, start, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)

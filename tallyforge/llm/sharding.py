"""Sharding by Karmarkar-Karp differencing: groups of equal texts that stay whole, shards of nearly equal bytes.

Groups are summed up on the cluster. Those of at least a HEAVY-th of a shard's share are items of their own, at most
shards * HEAVY by that definition; all others are dealt by hash into shards * BUNDLES bundles, each an item. So the number
of items depends on the number of shards only. Differencing then starts from one partial partition per item and
repeatedly replaces the two of largest spread by their sum, the one's largest part on the other's smallest.

A null text is equal to the empty one here. Every row gets a shard and a slot, repeated rows one each. A group larger than
a shard's share can't be split and makes its shard larger. An empty table gives an empty result. Only the id and the text
are read, so columns of any other name change nothing.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import gapless, scratch

SHARDS = 24
HEAVY = 512
BUNDLES = 64
#: Bytes that each document takes beside its text.
EXTRA = 8


def difference(sizes: list[int], parts: int) -> list[int]:
    """The part of each item by Karmarkar-Karp differencing."""
    if not sizes:
        return []
    heap = []
    for i, size in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        heap.append((-size, i, np.array([0] * (parts - 1) + [size], dtype=np.int64), [None] * (parts - 1) + [i]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, held_a = heapq.heappop(heap)
        _, _, b, held_b = heapq.heappop(heap)
        sums = a + b[::-1]  # both ascending: largest on smallest
        held = [x if y is None else y if x is None else (x, y) for x, y in zip(held_a, held_b[::-1], strict=True)]
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]
        heapq.heappush(heap, (-int(sums[-1]), serial, sums, [held[k] for k in order]))
        serial += 1
    out = [0] * len(sizes)
    for part, tree in enumerate(heap[0][3]):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            elif x is not None:
                out[x] = part
    return out


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and slot of every document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    with scratch(docs.sparkSession) as room:
        rows = room.keep(docs.select(F.col(key), (F.octet_length(whole) + EXTRA).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.unhex(F.md5(whole)).alias("tf_group"), F.monotonically_increasing_id().alias("tf_number")))
        rows = rows.withColumn("tf_bundle", F.pmod(F.xxhash64("tf_group"), F.lit(shards * BUNDLES)).cast("int"))
        groups = room.keep(rows.groupBy("tf_group", "tf_bundle").agg(F.sum("size").alias("bytes")))
        total = groups.agg(F.sum("bytes")).first()[0] or 0
        is_heavy = F.col("bytes") * (shards * HEAVY) >= F.lit(max(total, 1))
        heavy = [(bytes(r["tf_group"]), r["bytes"]) for r in groups.where(is_heavy).orderBy("tf_group").collect()]
        light = {r["tf_bundle"]: r["n"] for r in groups.where(~is_heavy).groupBy("tf_bundle").agg(F.sum("bytes").alias("n")).collect()}
        part = difference([light.get(k, 0) for k in range(shards * BUNDLES)] + [n for _, n in heavy], shards)
        bundle_shard = F.split(F.lit(",".join(map(str, part[: shards * BUNDLES]))), ",").cast("array<int>")
        own = docs.sparkSession.createDataFrame([(bytearray(g), p) for (g, _), p in zip(heavy, part[shards * BUNDLES :], strict=True)], "tf_group binary, tf_shard int")
        placed = rows.join(F.broadcast(own), "tf_group", "left").withColumn("shard", F.coalesce("tf_shard", F.get(bundle_shard, F.col("tf_bundle"))))
        placed = room.keep(placed.select(key, "size", "text_crc32", "shard", "tf_number"))
        return gapless(placed, "shard", [key, "tf_number"], "slot").drop("tf_number").checkpoint()

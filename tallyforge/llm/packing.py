"""Packing: optimal length buckets from the global histogram, token-budget batches inside each bucket.

All lengths go into one histogram of the distinct lengths. A dynamic program over it chooses the bucket boundaries for
which the padding over all documents is least; each is a length that is present. Inside a bucket documents get gapless
numbers, and a batch takes as many of them as fit the token budget at the bucket's padded length; a document longer than
the budget is a batch of its own. Only the histogram reaches the driver: d distinct lengths add up to d * d / 2 words at
least, so it grows at most with the square root of the corpus, and one long text adds one entry.

The tokens of length and budget are words, cut at blanks and the controls 9 to 13; pack() takes any other length column.
Null and empty texts have length 0 and go to the first bucket. An empty table gives an empty result. Repeated rows, null
and repeated ids, each get a place of their own; no group of them is one task. Only the id and the length are read, so
columns of any other name change nothing. A text of any length counts whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import gapless, scratch, words_of

BUCKETS = 16
BUDGET = 65_536


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The at most `buckets` boundaries, each a length of the histogram, for which the padded total is least; the last
    is the greatest length. A document goes to the first boundary that isn't below its length."""
    lengths = np.array(sorted(histogram), dtype=np.float64)
    if not len(lengths):
        return []
    below = np.concatenate([[0.0], np.cumsum([histogram[int(x)] for x in lengths], dtype=np.float64)])
    n = len(lengths)
    cost = np.concatenate([[0.0], np.full(n, np.inf)])  # least padded total of the first j lengths with at most k buckets
    cuts = []
    for _ in range(min(buckets, n)):
        cost, cut = _next_bucket(cost, below, lengths)
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def _next_bucket(cost: np.ndarray, below: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least cost[i] + (below[j] - below[i]) * lengths[j - 1] over i < j, and its i. The best i never falls
    as j grows, so each j is searched only between the best i of the j around it: log(n) rounds of about 2 n sums."""
    n = len(lengths)
    step, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    step[0] = 0.0
    first, last = np.array([1]), np.array([n])
    least, most = np.array([0]), np.array([n - 1])
    while len(first):
        j = (first + last) // 2
        size = np.minimum(most, j - 1) - least + 1
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        i = np.arange(size.sum()) - np.repeat(at - least, size)
        of = np.repeat(j, size)
        total = cost[i] + (below[of] - below[i]) * lengths[of - 1]
        best = np.minimum.reduceat(total, at)
        hit = np.flatnonzero(total == np.repeat(best, size))
        found = i[hit[np.searchsorted(hit, at)]]
        step[j], cut[j] = best, found
        sides = ((first, j - 1, least, found), (j + 1, last, found, most))
        first, last, least, most = (np.concatenate(x) for x in zip(*sides, strict=True))
        some = first <= last
        first, last, least, most = first[some], last[some], least[some], most[some]
    return step, cut


def pack(rows: DataFrame, length: str, key: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """key, length, bucket, bucket_len, batch (in the bucket), slot (in the batch), padding for each row."""
    with scratch(rows.sparkSession) as room:
        number = "tf_number" if key != "tf_number" else "tf_number_"
        narrow = room.keep(rows.select(F.col(key), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length"), F.monotonically_increasing_id().alias(number)))
        top = F.greatest(F.col("length"), F.lit(1))
        bounds = boundaries({r["top"]: r["n"] for r in narrow.groupBy(top.alias("top")).agg(F.count("*").alias("n")).collect()}, buckets) or [1]
        bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("length")))
        dealt = gapless(narrow.withColumn("bucket", bucket), "bucket", [key, number], "place")
        of = lambda values: F.get(F.array(*[F.lit(x).cast("long") for x in values]), F.col("bucket"))
        fit = of([max(1, budget // b) for b in bounds])
        return dealt.select(
            key, "length", "bucket", of(bounds).alias("bucket_len"), F.floor(F.col("place") / fit).cast("long").alias("batch"),
            (F.col("place") % fit).cast("long").alias("slot"), (of(bounds) - F.col("length")).alias("padding"),
        ).checkpoint()


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """pack() by the number of words."""
    return pack(docs.select(F.col(key), F.size(words_of(F.col(text))).alias("tf_length")), "tf_length", key)

"""Feature agglomeration: columns that say the same become one.

Correlations of all columns come from one pass over the rows (gram.sums). What is clustered are columns, not rows: each group's
matrix is one row of (columns + 1) squared numbers, so groups are clustered beside each other in tasks and nothing reaches the driver.
The distance of two columns is 1 - correlation, that of two clusters the mean over their pairs of columns (average linkage).

Rows with a null or NaN in one of the columns are left out of the correlations and get null for the clusters that have such a column. A
column that is constant in a group has correlation 0 with all others and counts 0 where it is pooled. Ties go to the columns
that come first. An empty table has no groups and so no clusters; null groups are a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.ship import ship
from tallyforge.operators.gram import joined, sums


def chain(distance: np.ndarray) -> list[tuple[float, int, int]]:
    """The merges of average linkage as (height, a column of one side, a column of the other), lowest first.

    A chain runs from a cluster to its nearest one and on, until two are each other's nearest and merge; for average linkage
    these merges are those of always taking the nearest pair, found in time square in the columns."""
    d, n = distance.astype(float).copy(), len(distance)
    np.fill_diagonal(d, np.inf)
    size, alive, path, merges = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not path:
            path.append(int(np.flatnonzero(alive)[0]))
        while True:
            here = path[-1]
            near = np.where(alive, d[here], np.inf)
            next_ = int(near.argmin())
            if len(path) > 1 and near[path[-2]] <= near[next_]:
                next_ = path[-2]
                break
            path.append(next_)
        path = path[:-2]
        a, b = min(here, next_), max(here, next_)
        merges.append((float(d[a, b]), a, b))
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a, a] = np.inf
        size[a], alive[b] = size[a] + size[b], False
    return sorted(merges, key=lambda m: m[0])  # a later merge of the same columns isn't lower, so equal heights keep their order


def cut(merges: list[tuple[float, int, int]], n: int, clusters: int | None, height: float | None) -> list[int]:
    """Each column's cluster, numbered by their first columns: the merges up to a height, or until so many clusters are left."""
    use = [m for k, m in enumerate(merges) if (clusters is None or k < n - clusters) and (height is None or m[0] <= height)]
    top = list(range(n))

    def root(k: int) -> int:
        while top[k] != k:
            k = top[k]
        return k

    for _, a, b in use:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    number = {r: k for k, r in enumerate(sorted({root(k) for k in range(n)}))}
    return [number[root(k)] for k in range(n)]


def clustered(df: DataFrame, cols: list[str], by: list[str], clusters: int | None = None, height: float | None = None) -> DataFrame:
    """For each group: by, tf_cluster (each column's cluster from 0), tf_mean and tf_sd (each column's), tf_rows."""
    if len(cols) < 2:
        raise ValueError("two columns at least")
    if (clusters is None) == (height is None) or (clusters is not None and clusters < 1):
        raise ValueError("give the number of clusters (from 1) or the greatest height of a merge")
    ship(df.sparkSession)
    matrices = sums(df, cols[:-1], cols[-1], by)
    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for flat in t["tf_m"]:
                m = np.asarray(flat, float).reshape(len(cols) + 1, -1)
                n, mean = m[0, 0], m[0, 1:] / m[0, 0]
                cov = m[1:, 1:] / n - np.outer(mean, mean)
                var = np.maximum(np.diag(cov), 0.0)
                sd = np.where(var > 1e-12 * np.maximum(1e-300, np.diag(m)[1:] / n), np.sqrt(var), 0.0)
                scale = np.where(sd > 0, sd, 1.0)
                r = np.where(np.outer(sd > 0, sd > 0), cov / np.outer(scale, scale), 0.0)
                out.append((cut(chain(1 - r), len(cols), clusters, height), mean.tolist(), sd.tolist(), int(n)))
            yield pd.concat([t.drop(columns="tf_m").reset_index(drop=True), pd.DataFrame(out, columns=["tf_cluster", "tf_mean", "tf_sd", "tf_rows"])], axis=1)

    return matrices.mapInPandas(run, f"{head}tf_cluster array<int>, tf_mean array<double>, tf_sd array<double>, tf_rows long")


def pooled(df: DataFrame, found: DataFrame, cols: list[str], by: list[str], name: str) -> DataFrame:
    """df with the array `name`: for each cluster of a row's group the mean of its standardised columns. Rows of a group without
    clusters are left out."""
    out = joined(df, found, by)
    known = lambda k: F.when(~F.isnan(F.col(cols[k]).cast("double")), F.col(cols[k]).cast("double"))
    place = lambda k: F.when(F.col("tf_sd")[k] > 0, (known(k) - F.col("tf_mean")[k]) / F.col("tf_sd")[k]).when(known(k).isNotNull(), 0.0)
    values = F.array(*(place(k) for k in range(len(cols))))
    members = lambda c: F.filter(F.arrays_zip(F.col("tf_cluster").alias("c"), F.col("tf_place").alias("v")), lambda x: x["c"] == c)
    mean = lambda c: F.transform(F.array(members(c)), lambda m: F.aggregate(m, F.lit(0.0), lambda s, x: s + x["v"]) / F.size(m))[0]
    out = out.withColumn("tf_place", values)
    return out.withColumn(name, F.transform(F.sequence(F.lit(0), F.array_max("tf_cluster")), mean)).drop("tf_place", "tf_cluster", "tf_mean", "tf_sd", "tf_rows")

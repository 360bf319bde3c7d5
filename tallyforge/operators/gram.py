"""Linear models of many features from Gram matrices: one pass over the rows, everything else on (features + 2) squared numbers.

sums() adds up the products of one, the features and the target for each group. Tasks add up batches with matrix products and send one
matrix for each group they saw, so no group is held or shuffled by row, however large. Ridge, lasso, elastic net, least squares
and Bayesian ridge are fitted to these matrices alone; search() finds penalties by successive halving over folds, where a
fold's training matrix is the group's less the fold's own, so no trial reads a row.

The objective is half the mean squared error and weight * (l1 * sum of |b| + (1 - l1) / 2 * sum of b ** 2), with a free
intercept. Rows where a feature or the target is null or NaN are left out. Null groups are a group. A feature that is constant
in a group gets 0. Groups without rows have no model; an empty table has none at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.ship import ship
from tallyforge.sources.shared import folder, kept, shared_root

#: Groups whose matrices a task holds before it sends them on.
HELD = 512
#: Most rows of a table of groups that are sent to every task.
FEW = 1_000
#: Coordinate descent ends when no coefficient moves by more than this share of the largest, or after ROUNDS.
TOLERANCE, ROUNDS = 1e-13, 20_000
#: Rounds of the evidence updates, and the rates and shapes of their Gamma priors.
UPDATES, PRIOR = 1_000, 1e-6


def sums(df: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """The columns of `by` and, for each group, tf_m: the sums of products of (1, features, target) with themselves, row by row."""
    ship(df.sparkSession)
    names = [*features, target]
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in names]
    good = whole[0]
    for w in whole[1:]:
        good = good & w
    rows = df.where(good).select(F.to_json(F.struct(*by)).alias("tf_key") if by else F.lit("{}").alias("tf_key"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(names)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            x = np.column_stack([np.ones(len(b)), b.iloc[:, 1:].to_numpy(float)])
            code, keys = pd.factorize(b["tf_key"])
            for k, key in enumerate(keys):
                part = x[code == k] if len(keys) > 1 else x
                found[key] = found.get(key, 0) + part.T @ part
            if len(found) > HELD:
                yield pd.DataFrame({"tf_key": list(found), "m": [m.ravel().tolist() for m in found.values()]})
                found = {}
        if found:
            yield pd.DataFrame({"tf_key": list(found), "m": [m.ravel().tolist() for m in found.values()]})

    cells = rows.mapInPandas(run, "tf_key string, m array<double>").select("tf_key", F.posexplode("m").alias("k", "v")).groupBy("tf_key", "k").agg(F.sum("v").alias("v"))
    m = F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"])
    whole_m = cells.groupBy("tf_key").agg(m.alias("tf_m"))
    if not by:
        return whole_m.select("tf_m")
    back = F.from_json("tf_key", T.StructType([df.schema[c] for c in by]))
    return whole_m.select(back.alias("tf_key"), "tf_m").select("tf_key.*", "tf_m")


def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float, float]:
    """Of a matrix of sums: the features' covariances, theirs with the target, its variance, means, the target's mean, rows."""
    n, mean = m[0, 0], m[0, 1:] / max(m[0, 0], 1.0)
    c = m[1:, 1:] / max(n, 1.0) - np.outer(mean, mean)
    return c[:-1, :-1], c[:-1, -1], c[-1, -1], mean[:-1], mean[-1], n


def elastic_net(cov: np.ndarray, with_y: np.ndarray, weight: float, l1: float) -> np.ndarray:
    """Coefficients by coordinate descent on covariances; without a lasso part, in closed form."""
    p = len(with_y)
    still = np.diag(cov) <= 1e-14 * max(1e-300, np.diag(cov).max(initial=0.0))
    b = np.zeros(p)
    if weight * l1 == 0:
        use = np.flatnonzero(~still)
        if len(use):
            b[use] = np.linalg.lstsq(cov[np.ix_(use, use)] + weight * np.eye(len(use)), with_y[use], rcond=None)[0]
        return b
    for _ in range(ROUNDS):
        moved = 0.0
        for j in np.flatnonzero(~still):
            rest = with_y[j] - cov[j] @ b + cov[j, j] * b[j]
            new = np.sign(rest) * max(abs(rest) - weight * l1, 0.0) / (cov[j, j] + weight * (1 - l1))
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved <= TOLERANCE * max(1.0, np.abs(b).max()):
            break
    return b


def bayesian_ridge(cov: np.ndarray, with_y: np.ndarray, var_y: float, n: float) -> tuple[np.ndarray, float, float]:
    """Coefficients of greatest evidence, and the precisions of the noise and of the coefficients."""
    size, axes = np.linalg.eigh(cov * n)
    size, along = np.maximum(size, 0.0), axes.T @ with_y * n
    noise, spread = 1 / max(var_y, 1e-300), 1.0
    b = np.zeros(len(size))
    for _ in range(UPDATES):
        old, b = b, noise * along / (spread + noise * size)
        known = (noise * size / (spread + noise * size)).sum()
        error = max(var_y * n - 2 * along @ b + (size * b * b).sum(), 0.0)
        spread = (known + 2 * PRIOR) / ((b * b).sum() + 2 * PRIOR)
        noise = (n - known + 2 * PRIOR) / (error + 2 * PRIOR)
        if np.abs(b - old).sum() < 1e-12 * max(1e-300, np.abs(b).sum()):
            break
    return axes @ (noise * along / (spread + noise * size)), noise, spread


def fitted(matrices: DataFrame, weight: float = 0.0, l1: float = 0.0, bayesian: bool = False) -> DataFrame:
    """matrices, as sums() gives them, with tf_b (the coefficients), tf_a (the intercept) and tf_n (the rows) of each group's model in
    place of tf_m; of a Bayesian ridge also tf_noise and tf_spread, the precisions. Where matrices has columns weight and l1, as
    search() gives them, these count for their group."""
    ship(matrices.sparkSession)
    keys = [f for f in matrices.schema.fields if f.name != "tf_m"]
    extra = ", tf_noise double, tf_spread double" if bayesian else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            own = zip(t["weight"], t["l1"], strict=True) if {"weight", "l1"} <= set(t.columns) else [(weight, l1)] * len(t)
            for flat, penalty in zip(t["tf_m"], own, strict=True):
                m = np.asarray(flat, float)
                cov, with_y, var_y, mean, mean_y, n = centred(m.reshape(int(round(len(m) ** 0.5)), -1))
                b, *more = bayesian_ridge(cov, with_y, var_y, n) if bayesian else (elastic_net(cov, with_y, *penalty),)
                out.append((b.tolist(), float(mean_y - mean @ b), n, *more))
            yield pd.concat([t.drop(columns="tf_m").reset_index(drop=True), pd.DataFrame(out, columns=["tf_b", "tf_a", "tf_n", "tf_noise", "tf_spread"][: 5 if bayesian else 3])], axis=1)

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys)
    return matrices.mapInPandas(run, f"{head}tf_b array<double>, tf_a double, tf_n double{extra}")


def predicted(df: DataFrame, models: DataFrame, features: list[str], by: list[str], name: str) -> DataFrame:
    """df with the value of its group's model; null for a group without one or a missing feature."""
    names = {c: f"tf_by{k}" for k, c in enumerate(by)}
    side = models.select(*(F.col(c).alias(n) for c, n in names.items()), "tf_a", "tf_b")
    on: Column = F.lit(True)
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    out = df.join(side, on, "left") if by else df.join(F.broadcast(side), how="left")  # without groups there is one model
    value = F.col("tf_a")
    for k, c in enumerate(features):
        value = value + F.col("tf_b")[k] * F.col(c)
    return out.withColumn(name, value).drop("tf_a", "tf_b", *names.values())


def _errors(trials: DataFrame, by: list[str]) -> DataFrame:
    """Rows of (by, trial, weight, l1, fold, whole matrix, fold's matrix) with the mean squared error on the fold of the model
    that is fitted to the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for weight, l1, whole, part in zip(t["weight"], t["l1"], t["whole"], t["part"], strict=True):
                size = int(round(len(part) ** 0.5))
                part = np.asarray(part, float).reshape(size, size)
                cov, with_y, _, mean, mean_y, _ = centred(np.asarray(whole, float).reshape(size, size) - part)
                b = elastic_net(cov, with_y, weight, l1)
                v = np.concatenate([[-(mean_y - mean @ b)], -b, [1.0]])  # the residual as a sum over (1, features, target)
                out.append(float(v @ part @ v / max(part[0, 0], 1.0)))
            yield t.drop(columns=["whole", "part"]).assign(error=out)

    kinds = "".join(f"`{c}` {trials.schema[c].dataType.simpleString()}, " for c in by)
    return trials.mapInPandas(run, f"{kinds}trial int, weight double, l1 double, fold int, error double")


def search(df: DataFrame, features: list[str], target: str, by: list[str], fold: str, folds: int, grid: list[tuple[float, float]], keep: float = 0.5, first: int = 2) -> DataFrame:
    """The best (weight, l1) of a grid for each group by successive halving, and its mean error over all folds: by, trial,
    weight, l1, error.

    Every trial and fold is a row. A rung tries what is left on `first` more folds; then each group goes on with the best
    `keep` of its trials (at least one) by the mean so far, ties by number, until all folds are used. Losers are dropped by a join;
    only the number of the rung is on the driver. Folds are whole numbers from 0; a row without one takes no part.
    """
    spark = df.sparkSession
    with folder(spark) as path:
        parts = kept(sums(df.where(F.col(fold).between(0, folds - 1)).withColumn("tf_fold", F.col(fold).cast("int")), features, target, [*by, "tf_fold"]), f"{path}/parts")
        cells = parts.select(*by, F.posexplode("tf_m").alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))
        whole = cells.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("whole"))
        both = kept(joined(parts, whole, by).withColumnsRenamed({"tf_m": "part", "tf_fold": "fold"}), f"{path}/both")
        trials = spark.createDataFrame([(k, float(w), float(x)) for k, (w, x) in enumerate(grid)], "trial int, weight double, l1 double")
        alive = both.select(*by).distinct().join(F.broadcast(trials))  # the grid, for each group
        done, used, rung = None, 0, 0
        while used < folds:
            fresh = both.where(F.col("fold").between(used, used + first - 1))
            rows = joined(fresh, alive, by).select(*by, "trial", "weight", "l1", "fold", "whole", "part")
            found = kept(_errors(rows, by), f"{path}/rung{rung}")
            done = found if done is None else done.unionByName(found)
            used, rung = used + first, rung + 1
            score = done.groupBy(*by, "trial", "weight", "l1").agg(F.avg("error").alias("error"), F.count("*").alias("n"))
            furthest = score.groupBy(*by).agg(F.max("n").alias("m"))
            score = kept(joined(score, furthest, by).where("n = m").drop("n", "m"), f"{path}/score{rung}")
            best = score.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("error", "trial"))).alias("all"))
            ahead = best.select(*by, F.explode(F.slice("all", F.lit(1), F.greatest(F.lit(1), F.ceil(F.size("all") * keep).cast("int")))).alias("x")).select(*by, F.col("x.trial").alias("trial"))
            alive = joined(score.drop("error"), ahead, [*by, "trial"])
        win = score.groupBy(*by).agg(F.min_by(F.struct("trial", "weight", "l1", "error"), F.struct("error", "trial")).alias("x"))
        return win.select(*by, "x.*").checkpoint()


def joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a joined with b, a table of groups, by keys that may be null. Up to FEW rows of b are sent to every task, as a shuffle by group would
    bring the rows of a large one to one task. To count them, b is computed before the join, once."""
    shared_root(a.sparkSession)  # for the checkpoint
    side = b.withColumnsRenamed({c: f"j_{c}" for c in keys}).checkpoint()
    few = side.limit(FEW + 1).count() <= FEW
    on = [F.col(c).eqNullSafe(F.col(f"j_{c}")) for c in keys]
    return (a.join(F.broadcast(side) if few else side, on) if keys else a.join(F.broadcast(side))).drop(*(f"j_{c}" for c in keys))

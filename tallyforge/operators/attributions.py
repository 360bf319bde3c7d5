"""What each feature adds to a prediction: exact for linear models, Shapley values over tree paths for tree models.

A tree model becomes a table of its leaves: tree, weight, value and, for each feature on the leaf's path, the interval that
leads there and the share of training rows that follow it. A feature that is taken out of a prediction goes both ways at
its splits, in those shares. With one leaf's conditions independent of all others', a leaf's Shapley values need only the
features on its own path, of which there are at most as many as the tree is deep, so they are exact without going through subsets
of all features.

The leaves are bounded by the model (trees * 2 ** depth). Rows stay where they are: no shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.ship import ship
from tallyforge.operators.gram import joined

#: Rows of a batch whose values are worked out at once.
ROWS = 1_000


def linear(df: DataFrame, models: DataFrame, means: DataFrame, features: list[str], by: list[str], name: str) -> DataFrame:
    """df with `name`, the coefficient times the distance from the group's mean for each feature in order, and `name`_base, the
    group's mean prediction; they add up to the prediction. models are gram.fitted()'s, means has by and tf_mean. A missing feature
    makes its own part null; rows of a group without a model are left out."""
    out = joined(df, joined(models.select(*by, "tf_a", "tf_b"), means.select(*by, "tf_mean"), by), by)
    parts = F.array(*(F.col("tf_b")[k] * (F.col(c) - F.col("tf_mean")[k]) for k, c in enumerate(features)))
    base = F.col("tf_a")
    for k in range(len(features)):
        base = base + F.col("tf_b")[k] * F.col("tf_mean")[k]
    return out.withColumns({name: parts, f"{name}_base": base}).drop("tf_a", "tf_b", "tf_mean")


def group_means(matrices: DataFrame, features: int) -> DataFrame:
    """tf_mean of each group's first `features` columns in place of gram.sums()'s tf_m."""
    mean = F.transform(F.sequence(F.lit(1), F.lit(features)), lambda k: F.get("tf_m", k) / F.get("tf_m", F.lit(0)))
    return matrices.withColumn("tf_mean", mean).drop("tf_m")


def signed_weights(models: DataFrame, by: list[str], most: int) -> DataFrame:
    """by and tf_w: each group's coefficients of greatest size, ties by their order, and 0 in place of the others."""
    cells = F.transform("tf_b", lambda b, k: F.struct((-F.abs(b)).alias("size"), k.alias("k")))
    best = F.transform(F.slice(F.array_sort(cells), 1, most), lambda x: x["k"])
    out = models.select(*by, "tf_b", best.alias("tf_best"))
    return out.select(*by, F.transform("tf_b", lambda b, k: F.when(F.array_contains("tf_best", k), b).otherwise(0.0)).alias("tf_w"))


def signed_score(df: DataFrame, models: DataFrame, features: list[str], by: list[str], most: int, name: str) -> DataFrame:
    """df with the weighted mean of the `most` features that count most in its group's model, each standardised in the group and turned to
    rise with the prediction: a feature of negative coefficient becomes ln(greatest - x + 1). The weights are the coefficients'
    sizes; one of 0 doesn't count, nor does a feature that is constant. A missing feature that counts makes the score null, as does a group without any
    that counts; rows of a group without a model are left out. Groups are summed up and joined back; no task holds one."""
    w = lambda k: F.col("tf_w")[k]
    whole = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    top = df.groupBy(*by).agg(F.array(*(F.max(whole(c)) for c in features)).alias("tf_top"))
    out = joined(df, joined(signed_weights(models, by, most), top, by), by)
    turned = [F.when(w(k) < 0, F.log(F.col("tf_top")[k] - whole(c) + 1)).when(w(k) > 0, whole(c)) for k, c in enumerate(features)]
    out = out.withColumns({f"tf_t{k}": t for k, t in enumerate(turned)})
    cells = [F.struct(F.avg(f"tf_t{k}").alias("m"), F.stddev_pop(f"tf_t{k}").alias("sd")) for k in range(len(features))]
    out = joined(out, out.groupBy(*by).agg(F.array(*cells).alias("tf_scale")), by)
    counts = [(w(k) != 0) & (F.col("tf_scale")[k]["sd"] > 0) for k in range(len(features))]
    score, n = F.lit(0.0), F.lit(0)
    for k, c in enumerate(counts):
        score = score + F.when(c, F.abs(w(k)) * (F.col(f"tf_t{k}") - F.col("tf_scale")[k]["m"]) / F.col("tf_scale")[k]["sd"]).otherwise(0.0)
        n = n + c.cast("int")
    return out.withColumn(name, F.try_divide(score, n)).drop("tf_w", "tf_top", "tf_scale", *(f"tf_t{k}" for k in range(len(features))))


def tree_leaves(model) -> pd.DataFrame:
    """The leaves of a tree, forest or boosted regression model of Spark ML without categorical features: tree, weight, value, and
    path, a list of (feature, low, high, share): the leaf wants low < feature <= high, as does `share` of those rows that come
    to the feature's splits on its path."""
    trees = list(model.trees) if hasattr(model, "trees") else [model]
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    if "RandomForest" in type(model).__name__:
        weights = [w / sum(weights) for w in weights]
    rows = []

    def walk(tree: int, node, path: dict) -> None:
        if node.numDescendants() == 0:
            rows.append((tree, float(weights[tree]), float(node.prediction()), [(f, *p) for f, p in sorted(path.items())]))
            return
        split = node.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("categorical splits have no interval")
        f, t = int(split.featureIndex()), float(split.threshold())
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        sides = node.leftChild(), node.rightChild()
        counts = [float(s.impurityStats().count()) for s in sides]
        for side, n, ends in zip(sides, counts, ((low, min(high, t)), (max(low, t), high)), strict=True):
            walk(tree, side, {**path, f: (*ends, share * n / sum(counts))})

    for k, t in enumerate(trees):
        walk(k, t._call_java("rootNode"), {})
    return pd.DataFrame(rows, columns=["tree", "weight", "value", "path"])


def shapley(x: np.ndarray, leaves: pd.DataFrame) -> tuple[np.ndarray, float]:
    """Each row's value for each feature, and the base: the prediction with all features taken out."""
    out, base = np.zeros(x.shape), 0.0
    for weight, value, path in zip(leaves["weight"], leaves["value"], leaves["path"], strict=True):
        share = np.array([p[3] for p in path])
        base += weight * value * float(np.prod(share))
        if not len(path):
            continue
        n = len(path)
        follows = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in path]).astype(float)
        order = np.array([math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) for k in range(n)])
        for i, (f, *_) in enumerate(path):
            known = np.zeros((n, len(x)))  # of how many other features are known: products over them, and shares of the rest
            known[0] = 1.0
            for j in range(n):
                if j != i:
                    known[1:] = known[1:] * share[j] + known[:-1] * follows[j]
                    known[0] *= share[j]
            out[:, f] += weight * value * (follows[i] - share[i]) * (order @ known)
    return out, base


def trees(df: DataFrame, model, features: list[str], name: str) -> DataFrame:
    """df with `name`, the Shapley value of each feature in order, and `name`_base; they add up to the model's prediction. A row
    that lacks a feature gets null for both. Only the features go to Python workers."""
    ship(df.sparkSession)
    leaves = tree_leaves(model)
    base = shapley(np.zeros((0, len(features))), leaves)[1]

    @F.pandas_udf("array<double>")
    def values(rows: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(rows), ROWS):
            x = np.array([[math.nan if v is None else v for v in row] for row in rows.iloc[k : k + ROWS]], float).reshape(-1, len(features))
            good = ~np.isnan(x).any(axis=1)
            out += [v.tolist() if ok else None for v, ok in zip(shapley(np.nan_to_num(x), leaves)[0], good, strict=True)]
        return pd.Series(out, dtype=object)

    out = df.withColumn(name, values(F.array(*(F.col(c).cast("double") for c in features))))
    return out.withColumn(f"{name}_base", F.when(F.col(name).isNotNull(), F.lit(base)))

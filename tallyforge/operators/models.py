"""Model operators on Spark ML and, where it has none, on grouped Arrow functions or closed forms."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import row_mean
from tallyforge.functions.ship import ship
from tallyforge.operators.stats import quantiles_by
from tallyforge.operators.windows import ranked
from tallyforge.sources.shared import folder, kept, shared_root


def fill_by_regression(df: DataFrame, target: str, features: list[str], intercept: bool = True) -> DataFrame:
    """Missing values of target from a linear model over the rows that have it; rows without a feature stay missing."""
    rows = VectorAssembler(inputCols=features, outputCol="tf_x", handleInvalid="skip").transform(df.dropna(subset=features))
    model = LinearRegression(featuresCol="tf_x", labelCol=target, fitIntercept=intercept, predictionCol="tf_p").fit(rows.where(F.col(target).isNotNull()))
    guess = F.lit(float(model.intercept))
    for c, w in zip(features, model.coefficients, strict=True):
        guess = guess + F.col(c) * F.lit(float(w))
    return df.withColumn(target, F.coalesce(F.col(target).cast("double"), guess))


def fill_chain(df: DataFrame, order: list[str], first: list[str]) -> DataFrame:
    """Each column of `order` is filled from `first` and from the columns filled before it."""
    known = list(first)
    for c in order:
        df = fill_by_regression(df, c, known)
        known.append(c)
    return df


def monotone(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The rising sequence of least weighted squared distance to y, by pooling neighbours."""
    blocks: list[list[float]] = []  # mean, weight, length
    for value, weight in zip(y, w, strict=True):
        blocks.append([float(value), float(weight), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            m, n, k = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[2] = (b[0] * b[1] + m * n) / (b[1] + n), b[1] + n, b[2] + k
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def spread_curves(df: DataFrame, predicted: str, actual: str, bins: list[int]) -> DataFrame:
    """How the deviation, the 99th and the 1st percentile of the actual values go with the prediction: metric, bins, bin, x,
    value. For every number of bins to choose from, rows go into bins of equal count by prediction, and a monotone curve is
    fitted to the bins; per metric that number is taken whose curve is nearest to its bins. Rows are ranked once; what a
    task fits are bins, whose number is a parameter."""
    shared_root(df.sparkSession)  # for the checkpoint
    rows = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).select(F.lit(1).alias("tf_one"), F.col(predicted).alias("p"), F.col(actual).alias("a"))
    total = rows.groupBy("tf_one").agg(F.count("*").alias("tf_all"))
    rows = ranked(rows, ["tf_one"], "p", False, [F.col("a")], "tf_rank").join(F.broadcast(total), "tf_one")
    rows = rows.withColumn("bins", F.explode(F.array(*map(F.lit, bins)))).withColumn("bin", F.floor((F.col("tf_rank") - 1) / F.ceil(F.col("tf_all") / F.col("bins"))).cast("int"))
    ends = quantiles_by(rows, ["bins", "bin"], "a", {"p99": 0.99, "p1": 0.01})
    cells = rows.groupBy("bins", "bin").agg(F.avg("p").alias("x"), F.stddev_samp("a").alias("sd")).join(ends, ["bins", "bin"]).dropna()

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("bin", kind="stable")
        out = []
        for metric in ("sd", "p99", "p1"):
            value = monotone(t[metric].to_numpy(float), np.ones(len(t)))
            out.append(pd.DataFrame({"metric": metric, "bins": t["bins"], "bin": t["bin"], "x": t["x"], "value": value, "mse": ((value - t[metric]) ** 2).mean()}))
        return pd.concat(out)

    ship(df.sparkSession)
    curves = cells.groupBy("bins").applyInPandas(fit, "metric string, bins int, bin int, x double, value double, mse double").checkpoint()
    best = curves.groupBy("metric").agg(F.min_by("bins", F.struct("mse", "bins")).alias("bins"))
    return curves.join(F.broadcast(best), ["metric", "bins"]).drop("mse")  # three rows


def stack(df: DataFrame, features: list[str], label: str, fold: str, models: dict, folds: int, best: int) -> DataFrame:
    """df with each model's out-of-fold prediction (p_<name>), the mean of the best models' (best_mean) and a meta model's on
    all of them (stacked). Of 1 to `best` models in the order of their out-of-fold error that many are averaged for which the
    mean's error is least. Each model is a regressor that is fitted on the other folds; one row of errors reaches the driver. Fits
    read the rows many times, so df is computed once and kept.
    """
    with folder(df.sparkSession) as path:
        rows = VectorAssembler(inputCols=features, outputCol="tf_x").transform(kept(df, f"{path}/rows"))
        parts = []
        for k in range(folds):
            train, test = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
            for name, model in models.items():
                test = model.copy().setFeaturesCol("tf_x").setLabelCol(label).setPredictionCol(f"p_{name}").fit(train).transform(test)
            parts.append(test)
        oof = reduce(lambda a, b: a.unionByName(b), parts).drop("tf_x").checkpoint()
    names = [f"p_{n}" for n in models]
    error = lambda p: F.avg((F.col(label) - p) * (F.col(label) - p))
    errors = oof.agg(*(error(F.col(p)).alias(p) for p in names)).first().asDict()
    order = sorted(names, key=lambda p: (errors[p], p))
    means = [row_mean([F.col(p) for p in order[:k]]) for k in range(1, min(best, len(order)) + 1)]
    found = oof.agg(*(error(m).alias(str(k)) for k, m in enumerate(means))).first()
    meta = VectorAssembler(inputCols=names, outputCol="tf_p").transform(oof.withColumn("best_mean", means[int(np.argmin(found))]))
    return LinearRegression(featuresCol="tf_p", labelCol=label, predictionCol="stacked", regParam=0.01).fit(meta).transform(meta).drop("tf_p")


def scaled(df: DataFrame, col: str) -> DataFrame:
    """df with standard, unit and robust: less mean over deviation, place between least and greatest, less median over the
    range of the middle half. A constant column gives null; so does a table without values."""
    c = F.col(col)
    one = df.agg(F.avg(c).alias("tf_m"), F.stddev_pop(c).alias("tf_sd"), F.min(c).alias("tf_lo"), F.max(c).alias("tf_hi"))
    middle = quantiles_by(df.select(F.lit(1).alias("tf_one"), c.alias("tf_v")), ["tf_one"], "tf_v", {f"tf_q{k}": q for k, q in enumerate((0.25, 0.5, 0.75))})
    out = df.join(F.broadcast(one)).join(F.broadcast(middle), how="left")  # one row each
    out = out.withColumns({"standard": F.try_divide(c - F.col("tf_m"), F.col("tf_sd")), "unit": F.try_divide(c - F.col("tf_lo"), F.col("tf_hi") - F.col("tf_lo")), "robust": F.try_divide(c - F.col("tf_q1"), F.col("tf_q2") - F.col("tf_q0"))})
    return out.drop("tf_m", "tf_sd", "tf_lo", "tf_hi", "tf_q0", "tf_q1", "tf_q2", "tf_one")


def moments(x: str, y: str) -> list:
    """Aggregates that penalised_line() needs."""
    return [F.covar_pop(y, x).alias("tf_c"), F.var_pop(x).alias("tf_v"), F.avg(x).alias("tf_mx"), F.avg(y).alias("tf_my")]


def penalised_line(df: DataFrame, name: str, weight: float, l1: float) -> DataFrame:
    """Slope `name` and its intercept that make half the mean squared error and weight * (l1 * |slope| + (1 - l1) / 2 *
    slope ** 2) least; l1 is 0 for ridge, 1 for lasso, between for an elastic net."""
    c, v = F.col("tf_c"), F.col("tf_v")
    slope = F.try_divide(F.signum(c) * F.greatest(F.abs(c) - weight * l1, F.lit(0.0)), v + weight * (1 - l1))
    return df.withColumn(name, slope).withColumn(f"{name}_start", F.col("tf_my") - F.col(name) * F.col("tf_mx"))


def expanding_line(df: DataFrame, period: str, x: str, y: str, name: str) -> DataFrame:
    """df with each row's value on the line fitted to all earlier periods; rows of the first period are left out. The fits
    come from running sums over periods."""
    sums = df.groupBy(period).agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"))
    w = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, -1)  # a row per period
    s = sums.select(period, *(F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "xy", "xx"))).where("n IS NOT NULL")
    slope = F.try_divide(F.col("n") * F.col("xy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("xx") - F.col("sx") * F.col("sx"))
    fit = s.select(period, slope.alias("tf_b"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("tf_a"))
    return df.join(fit, period).withColumn(name, F.col("tf_a") + F.col("tf_b") * F.col(x)).drop("tf_a", "tf_b")


def smoothed(curve: DataFrame, place: str, value: str, width: int, name: str) -> DataFrame:
    """A curve over whole places, each value the mean of its neighbours up to `width` places away, whose weight falls with
    the cube of the distance. A curve is bounded by its places, so its pairs are too: 2 * width + 1 of a place."""
    near = curve.select(F.explode(F.sequence(F.col(place) - width, F.col(place) + width)).alias("tf_at"), F.col(place).alias("tf_from"), F.col(value).alias("tf_y"))
    w = 1 - F.pow(F.abs(F.col("tf_at") - F.col("tf_from")) / (width + 1.0), F.lit(3.0))
    means = near.groupBy("tf_at").agg((F.sum(w * F.col("tf_y")) / F.sum(w)).alias(name))
    return curve.join(means, F.col(place) == F.col("tf_at")).drop("tf_at")


def lines_by_group(df: DataFrame, group: str, x: str, targets: dict[str, str]) -> DataFrame:
    """df with the value of a linear model for each target: one slope over all groups, an intercept for each group. The slope
    is the sum of the groups' co-moments over the sum of their variances."""
    n = F.count("*").cast("double")
    sums = df.groupBy(group).agg(F.avg(x).alias("tf_mx"), (F.var_pop(x) * n).alias("tf_v"), *(F.avg(y).alias(f"tf_m_{y}") for y in targets), *((F.covar_pop(y, x) * n).alias(f"tf_c_{y}") for y in targets))
    slope = sums.agg(*(F.try_divide(F.sum(f"tf_c_{y}"), F.sum("tf_v")).alias(f"tf_b_{y}") for y in targets))  # one row
    out = df.join(sums.drop("tf_v"), group).join(F.broadcast(slope))
    out = out.withColumns({name: F.col(f"tf_m_{y}") + F.col(f"tf_b_{y}") * (F.col(x) - F.col("tf_mx")) for y, name in targets.items()})
    return out.drop("tf_mx", *(f"tf_{k}_{y}" for k in "mcb" for y in targets))

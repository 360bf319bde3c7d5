"""Quantile regression on all rows: linear functions of many features that leave a share q of each group below.

The pinball loss is smoothed over a band around the line, of half width h, which makes it quadratic near the line and leaves it as
it is elsewhere. Newton steps follow from sums over the rows: one pass is one aggregation of built-in functions by group, which
Spark adds up before it shuffles, so what is shuffled is a row of sums for each group and task. h halves while the steps are small and
enough rows lie in the band. The best line of all passes by the true loss is taken, and at last its intercept is made the exact
q-quantile of what the slopes leave, so that the share below is q to within one row and ties.

Rows with a null or NaN in a feature or the target are left out. Null groups are a group. A feature that is constant in a group
gets 0. Groups without rows have no line; an empty table has none at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.ship import ship
from tallyforge.operators.gram import centred, elastic_net, joined, sums
from tallyforge.operators.stats import quantiles_by
from tallyforge.sources.shared import folder, kept

#: The band isn't made narrower with fewer rows than this for each coefficient inside.
INSIDE = 3
_STATE = "tf_key string, mean array<double>, sd array<double>, at array<double>, h double, best double, line array<double>, n double"


def _start(matrices: DataFrame, q: float) -> DataFrame:
    """Least squares, moved up by the normal quantile of what it leaves."""
    z = NormalDist().inv_cdf(q)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for key, flat in zip(t["tf_key"], t["tf_m"], strict=True):
                m = np.asarray(flat, float)
                cov, with_y, var_y, mean, mean_y, n = centred(m.reshape(int(round(len(m) ** 0.5)), -1))
                b = elastic_net(cov, with_y, 0.0, 0.0)
                sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
                sd[sd <= 1e-7 * np.maximum(1e-300, np.abs(mean))] = 0.0
                rest = float(np.sqrt(max(var_y - b @ with_y, 1e-12 * max(var_y, 1e-300))))
                at = [float(mean_y + z * rest), *(b * sd).tolist()]
                out.append((key, mean.tolist(), sd.tolist(), at, max(rest, 1e-300), float("inf"), at, n))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _STATE.split(", ")])

    return matrices.mapInPandas(run, _STATE)


def _summed(rows: DataFrame, state: DataFrame, p: int, q: float) -> DataFrame:
    """state with tf_loss, tf_in (rows in the band) and tf_s, the gradient and the upper half of the second derivative."""
    x = joined(rows, state.select("tf_key", "mean", "sd", "at", "h"), ["tf_key"])
    z = [F.lit(1.0), *(F.when(F.col("sd")[k] > 0, (F.col(f"x{k}") - F.col("mean")[k]) / F.col("sd")[k]).otherwise(0.0) for k in range(p))]
    x = x.withColumns({f"z{k}": c for k, c in enumerate(z)})
    line = F.col("at")[0]
    for k in range(1, p + 1):
        line = line + F.col("at")[k] * F.col(f"z{k}")
    x = x.withColumn("r", F.col("y") - line)
    r, h = F.col("r"), F.col("h")
    x = x.withColumns({"pull": F.least(F.greatest((h - r) / (2 * h), F.lit(0.0)), F.lit(1.0)) - q, "inside": (F.abs(r) < h).cast("double")})
    first = [F.sum(F.col("pull") * F.col(f"z{k}")) for k in range(p + 1)]
    second = [F.sum(F.col("inside") * F.col(f"z{j}") * F.col(f"z{k}")) for j in range(p + 1) for k in range(j, p + 1)]
    found = x.groupBy("tf_key").agg(F.sum(F.greatest(q * r, (q - 1) * r)).alias("tf_loss"), F.sum("inside").alias("tf_in"), F.array(*first, *second).alias("tf_s"))
    return joined(state, found, ["tf_key"])


def _step(summed: DataFrame, p: int) -> DataFrame:
    upper = [(j, k) for j in range(p + 1) for k in range(j, p + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for r in t.itertuples(index=False):
                at, s, h = np.asarray(r.at, float), np.asarray(r.tf_s, float), r.h
                best, line = (r.tf_loss, at) if r.tf_loss < r.best else (r.best, np.asarray(r.line, float))
                curve = np.zeros((p + 1, p + 1))
                for (j, k), v in zip(upper, s[p + 1 :], strict=True):
                    curve[j, k] = curve[k, j] = v / (2 * h)
                step = -np.linalg.lstsq(curve, s[: p + 1], rcond=1e-10)[0]
                if r.tf_in < p + 1:  # too few rows near the line to tell how far: one band towards the gradient
                    step, h = -np.sign(s[: p + 1]) * h, h * 2
                size = np.abs(step).sum()
                if size > 4 * h:
                    step *= 4 * h / size
                elif size < h and r.tf_in > INSIDE * (p + 1):
                    h /= 2
                out.append((r.tf_key, list(r.mean), list(r.sd), (at + step).tolist(), h, float(best), line.tolist(), r.n))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _STATE.split(", ")])

    return summed.mapInPandas(run, _STATE)


def fit(df: DataFrame, features: list[str], target: str, by: list[str], q: float, passes: int = 16) -> DataFrame:
    """by, tf_b (the slopes), tf_a (the intercept) and tf_n (the rows) of each group's line, as gram.predicted() takes them."""
    if not features or not 0 < q < 1:
        raise ValueError("one feature at least, and 0 < q < 1")
    spark, p = df.sparkSession, len(features)
    ship(spark)
    names = [f"x{k}" for k in range(p)]
    good = F.lit(True)
    for c in [*features, target]:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    key = F.to_json(F.struct(*by)) if by else F.lit("{}")
    with folder(spark) as path:
        rows = df.where(good).select(key.alias("tf_key"), *(F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)), F.col(target).cast("double").alias("y"))
        rows = kept(rows, f"{path}/rows")
        state = kept(_start(sums(rows, names, "y", ["tf_key"]), q), f"{path}/state")
        for k in range(passes):
            state = kept(_step(_summed(rows, state, p, q), p), f"{path}/state{k}")
        slope = F.transform(F.arrays_zip(F.slice("line", 2, p).alias("b"), F.col("sd").alias("s")), lambda x: F.when(x["s"] > 0, x["b"] / x["s"]).otherwise(0.0))
        lines = state.select("tf_key", slope.alias("tf_b"), F.col("n").alias("tf_n"))
        rest = F.col("y")
        for k, c in enumerate(names):
            rest = rest - F.col("tf_b")[k] * F.col(c)
        start = quantiles_by(joined(rows, lines, ["tf_key"]).select("tf_key", rest.alias("tf_r")), ["tf_key"], "tf_r", {"tf_a": q})
        out = joined(lines, start, ["tf_key"])
        if not by:
            return out.select("tf_b", "tf_a", "tf_n").checkpoint()
        back = F.from_json("tf_key", T.StructType([df.schema[c] for c in by]))
        return out.select(back.alias("tf_key"), "tf_b", "tf_a", "tf_n").select("tf_key.*", "tf_b", "tf_a", "tf_n").checkpoint()

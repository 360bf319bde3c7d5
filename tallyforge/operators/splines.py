"""Natural cubic smoothing splines, one per group, with the penalty chosen by leaving one knot out.

Rows of a group are first added up into at most KNOTS cells of equal width of its range; a cell's knot is the mean of its x, its value the mean of
y and its weight the number of rows. So what one task fits is bounded however many rows a group has, and where x has fewer values than cells,
such as places of a list, every value is a knot of its own. The curve makes sum of weight * (y - curve) ** 2 + penalty * integral of
curve'' ** 2 least. It comes from a banded system (five diagonals) in time in proportion to the knots. The error of leaving
each knot out needs only the middle diagonals of that system's inverse, which a backward pass gives.

Rows where x or y is null or NaN are left out. Null groups are a group. One or two knots give the line through them. Ties in x are
one knot. An empty table has no curves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.ship import ship

KNOTS = 512
#: Penalties to choose from, in units of (range of x) ** 3 times the mean weight, so that they don't depend on scales.
GRID = tuple(10.0 ** (k / 4) for k in range(-36, 9))


def solve(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each penalty (rows) the curve at the knots, its second derivative there, and the residuals each knot would have if
    it were left out. At least three knots with rising x."""
    n, lam = len(x), np.asarray(penalties, float)
    h, v = np.diff(x), 1 / w
    q0, q2 = 1 / h[:-1], 1 / h[1:]
    q1 = -q0 - q2
    m = n - 2
    # The system's diagonals: one row per penalty.
    b0 = (h[:-1] + h[1:]) / 3 + lam[:, None] * (q0**2 * v[:-2] + q1**2 * v[1:-1] + q2**2 * v[2:])
    b1 = h[1:-1] / 6 + lam[:, None] * (q1[:-1] * q0[1:] * v[1:-2] + q2[:-1] * q1[1:] * v[2:-1])
    b2 = lam[:, None] * (q2[:-2] * q0[2:] * v[2:-2])
    right = np.diff(np.diff(y) / h)
    d, l1, l2, z = (np.zeros((len(lam), m + 2)) for _ in range(4))  # two more, of zeros, so that ends need no cases
    for i in range(m):
        one, two = l1[:, i - 1] if i else 0.0, l2[:, i - 2] if i > 1 else 0.0
        d[:, i] = b0[:, i] - (one**2 * d[:, i - 1] if i else 0.0) - (two**2 * d[:, i - 2] if i > 1 else 0.0)
        if i < m - 1:
            l1[:, i] = (b1[:, i] - (one * l2[:, i - 1] * d[:, i - 1] if i else 0.0)) / d[:, i]
        if i < m - 2:
            l2[:, i] = b2[:, i] / d[:, i]
        z[:, i] = right[i] - (one * z[:, i - 1] if i else 0.0) - (two * z[:, i - 2] if i > 1 else 0.0)
    bend, s0, s1, s2 = (np.zeros((len(lam), m + 2)) for _ in range(4))  # the solution, and the middle of the inverse
    for i in range(m - 1, -1, -1):
        bend[:, i] = z[:, i] / d[:, i] - l1[:, i] * bend[:, i + 1] - l2[:, i] * bend[:, i + 2]
        s1[:, i] = -l1[:, i] * s0[:, i + 1] - l2[:, i] * s1[:, i + 1]
        s2[:, i] = -l1[:, i] * s1[:, i + 1] - l2[:, i] * s0[:, i + 2]
        s0[:, i] = 1 / d[:, i] - l1[:, i] * s1[:, i] - l2[:, i] * s2[:, i]
    pad = lambda a, before: np.pad(a[:, :m], ((0, 0), (before, 2 - before)))
    a0, a1, a2 = np.pad(q0, (0, 2)), np.pad(q1, (1, 1)), np.pad(q2, (2, 0))  # a knot's part in the system's rows i, i - 1, i - 2
    curve = y - lam[:, None] * v * (pad(bend, 0) * a0 + pad(bend, 1) * a1 + pad(bend, 2) * a2)
    own = a0**2 * pad(s0, 0) + a1**2 * pad(s0, 1) + a2**2 * pad(s0, 2) + 2 * a0 * a1 * pad(s1, 1) + 2 * a1 * a2 * pad(s1, 2) + 2 * a0 * a2 * pad(s2, 2)
    left_out = (y - curve) / np.maximum(lam[:, None] * v * own, 1e-300)
    return curve, np.pad(bend[:, :m], ((0, 0), (1, 1))), left_out


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """The curve at the knots, its second derivative, the penalty, and the mean squared error of leaving a knot out (by weight).
    Without a penalty, that of GRID with the least error is taken."""
    if len(x) < 3:
        return y.copy(), np.zeros(len(x)), float(penalty or 0.0), float("nan")
    some = np.array([penalty]) if penalty is not None else np.array(GRID) * (x[-1] - x[0]) ** 3 * w.mean()
    curve, bend, left_out = solve(x, y, w, some)
    error = (w * left_out**2).sum(1) / w.sum()
    k = int(np.argmin(error))
    return curve[k], bend[k], float(some[k]), float(error[k])


def _cell(x: str, knots: int):
    share = F.coalesce(F.try_divide(F.col(x) - F.col("tf_lo"), F.col("tf_hi") - F.col("tf_lo")), F.lit(0.0))
    return F.least(F.greatest(F.floor(share * knots), F.lit(0)), F.lit(knots - 1)).cast("int")


def curves(df: DataFrame, by: list[str], x: str, y: str, penalty: float | None = None, knots: int = KNOTS) -> DataFrame:
    """A row per group and knot: by, x, n (rows), y (mean), fitted, bend (second derivative), penalty, error; and where its cell is."""
    ship(df.sparkSession)
    good = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    rows = df.where(good).select(*(F.col(c).alias(f"tf_by{k}") for k, c in enumerate(by)), F.col(x).cast("double").alias("tf_x"), F.col(y).cast("double").alias("tf_y"))
    keys = [f"tf_by{k}" for k in range(len(by))]
    values = rows.groupBy(*keys, "tf_x").agg(F.sum("tf_y").alias("tf_s"), F.count("*").alias("tf_n"))  # ties are one from here on
    edges = values.groupBy(*keys).agg(F.min("tf_x").alias("tf_lo"), F.max("tf_x").alias("tf_hi")).withColumnsRenamed({k: f"e_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in keys]
    placed = values.join(edges, on) if keys else values.join(F.broadcast(edges))
    cells = placed.groupBy(*keys, "tf_lo", "tf_hi", _cell("tf_x", knots).alias("tf_cell")).agg((F.sum(F.col("tf_x") * F.col("tf_n")) / F.sum("tf_n")).alias("x"), F.sum("tf_n").alias("n"), (F.sum("tf_s") / F.sum("tf_n")).alias("y"))
    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("x", kind="stable").reset_index(drop=True)
        curve, bend, chosen, error = fit(t["x"].to_numpy(float), t["y"].to_numpy(float), t["n"].to_numpy(float), penalty)
        return t[[*keys, "x", "n", "y", "tf_lo", "tf_hi", "tf_cell"]].assign(fitted=curve, bend=bend, penalty=chosen, error=error)

    out = cells.groupBy(*keys).applyInPandas(run, f"{kinds}x double, n long, y double, tf_lo double, tf_hi double, tf_cell int, fitted double, bend double, penalty double, error double")
    return out.withColumnsRenamed(dict(zip(keys, by, strict=True)))


def pieces(x: np.ndarray, y: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """A row for what lies before the first knot, between neighbours and behind the last: where it starts, and the polynomial's
    four coefficients from there. Before and behind, it is the line that the curve ends in."""
    h = np.diff(x)
    slope = np.diff(y) / h
    start, stop = slope - h / 6 * (2 * bend[:-1] + bend[1:]), slope + h / 6 * (bend[:-1] + 2 * bend[1:])
    inner = np.column_stack([x[:-1], y[:-1], start, bend[:-1] / 2, np.diff(bend) / (6 * h)])
    ends = [[x[0], y[0], start[0] if len(h) else 0.0, 0.0, 0.0], [x[-1], y[-1], stop[-1] if len(h) else 0.0, 0.0, 0.0]]
    return np.vstack([ends[:1], inner, ends[1:]])


def at(df: DataFrame, found: DataFrame, by: list[str], x: str, name: str, knots: int = KNOTS) -> DataFrame:
    """df with its group's curve at x: cubic between knots, the end's line beyond them; null without a curve or an x. Each of a
    group's cells has a row with the pieces before and behind its knot, so a row of df meets one row, by group and cell."""
    ship(df.sparkSession)
    keys = {c: f"tf_at{k}" for k, c in enumerate(by)}
    side = found.select(*(F.col(c).alias(k) for c, k in keys.items()), "tf_lo", "tf_hi", "tf_cell", "x", "fitted", "bend")
    kinds = "".join(f"{k} {side.schema[k].dataType.simpleString()}, " for k in keys.values())

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("x", kind="stable")
        piece = pieces(t["x"].to_numpy(float), t["fitted"].to_numpy(float), t["bend"].to_numpy(float))
        cell = np.arange(knots)
        before = np.searchsorted(t["tf_cell"].to_numpy(), cell)  # a cell has one knot or none
        behind = np.searchsorted(t["tf_cell"].to_numpy(), cell, "right")
        split = np.where(behind > before, np.append(t["x"].to_numpy(float), np.inf)[before], np.inf)
        out = pd.DataFrame({k: [t[k].iloc[0]] * knots for k in keys.values()})
        return out.assign(tf_cell=cell, tf_split=split, tf_l=list(piece[before]), tf_r=list(piece[behind]))

    parts = side.groupBy(*keys.values()).applyInPandas(run, f"{kinds}tf_cell int, tf_split double, tf_l array<double>, tf_r array<double>")
    edges = side.select(*keys.values(), "tf_lo", "tf_hi").distinct()
    on = lambda names: [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    rows = (df.join(edges, on(keys), "left") if by else df.join(F.broadcast(edges), how="left")).drop(*keys.values())
    rows = rows.withColumn("tf_row_cell", _cell(x, knots)).join(parts, [*on(keys), F.col("tf_row_cell") == F.col("tf_cell")], "left")
    piece = F.when(F.col(x) < F.col("tf_split"), F.col("tf_l")).otherwise(F.col("tf_r"))
    far = F.col(x) - piece[0]
    value = piece[1] + far * (piece[2] + far * (piece[3] + far * piece[4]))
    return rows.withColumn(name, F.when(F.col(x).isNotNull(), value)).drop(*keys.values(), "tf_lo", "tf_hi", "tf_row_cell", "tf_cell", "tf_split", "tf_l", "tf_r")

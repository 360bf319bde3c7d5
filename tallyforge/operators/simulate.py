"""Simulation: truncated normal draws, lineups under a budget, and what many trials select.

Draws and trials are rows; each trial is solved on its own by a dynamic program, so trials spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.normal import shares, with_truncated
from tallyforge.functions.ship import ship


def uniform(seed: int, *cols):
    """A number in (0, 1) that depends on the seed and the columns only, so a repeated task draws the same: the first 52 bits
    of their MD5, which every engine has."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / float(2**52)


_LIMITS = ("mean", "sd", "low", "high")


def _with_shares(df: DataFrame) -> DataFrame:
    """df with the shares of its distributions below their limits, once for all draws of a row."""
    ship(df.sparkSession)
    return df.withColumns(dict(zip(("tf_below_low", "tf_below_high"), shares(*map(F.col, _LIMITS)), strict=True)))


def _drawn(df: DataFrame, u) -> DataFrame:
    return with_truncated(df, u, (F.col("tf_below_low"), F.col("tf_below_high")), *map(F.col, _LIMITS), "points")


def draws(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n truncated-normal draws per row of key, mean, sd, low, high: key, draw, points."""
    long = _with_shares(df).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return _drawn(long, uniform(seed, F.col(key), F.col("draw"))).select(key, "draw", "points")


def best_lineup(points: np.ndarray, price: np.ndarray, kind: np.ndarray, need: dict[str, int], budget: int) -> list[int]:
    """The rows of the best lineup: exactly need[k] of each kind, total price at most the budget. Exact dynamic program
    over (kinds so far, money); empty if there is none."""
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for k, n in need.items():
        rows = np.flatnonzero(kind == k)
        layers: list[dict[int, tuple[float, tuple]]] = [best] + [{} for _ in range(n)]
        for r in rows:
            for taken in range(n - 1, -1, -1):
                for spent, (value, chosen) in layers[taken].items():
                    at = spent + int(price[r])
                    if at <= budget and layers[taken + 1].get(at, (-np.inf,))[0] < value + points[r]:
                        layers[taken + 1][at] = (value + points[r], (chosen, int(r)))
        best = layers[n]
    if not best:
        return []
    node, out = max(best.values(), key=lambda x: x[0])[1], []
    while node:
        node, r = node
        out.append(r)
    return out[::-1]


def trials(players: DataFrame, n: int, need: dict[str, int], budget: int, seed: int = 1) -> DataFrame:
    """n lineups, each on its own draws: trial, player, price. players: player, kind, price (whole), mean, sd, low, high;
    they are a draft's candidates, a list that is bounded by the draft and not by the data."""
    numbered = _with_shares(players).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = _drawn(numbered, uniform(seed, F.col("player"), F.col("trial")))

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("player", kind="stable").reset_index(drop=True)
        rows = best_lineup(t["points"].to_numpy(), t["price"].to_numpy(), t["kind"].to_numpy(), need, budget)
        return t.loc[rows, ["trial", "player", "price"]]

    return drawn.select("trial", "player", "kind", "price", "points").groupBy("trial").applyInPandas(solve, "trial int, player long, price int")


def selection(chosen: DataFrame, n: int) -> DataFrame:
    """Per player the share of trials that select them, mean and 80th percentile of the price."""
    return chosen.groupBy("player").agg((F.count("*") / n).alias("selected"), F.avg("price").alias("mean_price"), F.percentile("price", F.lit(0.8)).alias("p80_price"))

"""Statistics: imputation by regression, consensus of sources, labels, cumulative history, model metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import half_even, row_mean, row_std
from tallyforge.operators.windows import ranked


def consensus(df: DataFrame, sources: list[str], name: str, digits: int = 2) -> DataFrame:
    """Fill missing sources by the row's mean; mean and deviation over the filled row. A deviation of 0,
    or under 1e-9 out of rounding, becomes mean * (mean of deviation / mean over the rows that have one)."""
    mean, filled = row_mean([F.col(c) for c in sources]), [F.coalesce(c, f"avg_{name}") for c in sources]
    df = df.withColumn(f"avg_{name}", mean).withColumns(dict(zip(sources, filled, strict=True)))
    df = df.withColumn(f"std_{name}", row_std([F.col(c) for c in sources]))
    usable = F.when(F.col(f"std_{name}") > 1e-9, F.try_divide(F.col(f"std_{name}"), F.col(f"avg_{name}")))
    df = df.join(F.broadcast(df.agg(F.avg(usable).alias("tf_cv"))))  # one row
    std = F.when(F.col(f"std_{name}") <= 1e-9, F.col(f"avg_{name}") * F.col("tf_cv")).otherwise(F.col(f"std_{name}"))
    return df.withColumn(f"std_{name}", half_even(std, digits)).withColumn(f"avg_{name}", half_even(F.col(f"avg_{name}"), digits)).drop("tf_cv")


def slope_through_origin(df: DataFrame, x: str, y: str, name: str = "slope") -> DataFrame:
    """One row with the slope. Whole numbers are squared and summed up as doubles, so that large ones don't overflow."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(F.try_divide(F.sum(a * b), F.sum(a * a)).alias(name))


def fill_by_slope(df: DataFrame, x: str, y: str, use, factor: float = 2.0) -> DataFrame:
    """Missing y become slope * x, the slope through the origin over the rows of `use`; below 0, factor * x."""
    guess = F.col("tf_slope") * F.col(x)
    df = df.join(F.broadcast(slope_through_origin(df.where(use), x, y, "tf_slope")))
    return df.withColumn(y, F.coalesce(F.col(y), F.when(guess < 0, factor * F.col(x)).otherwise(guess))).drop("tf_slope")


def history_mean(df: DataFrame, level: str, period: str, col: str, name: str, ahead: int = 0) -> DataFrame:
    """For each level and period the mean over all rows of that level up to the period; the first `ahead` periods, which
    have little history, look one period further. The grid of levels and periods is completed, so a level without a row in
    a period still has its history. Both sides of the grid are distinct values."""
    sums = df.groupBy(level, period).agg(F.sum(col).alias("s"), F.count(col).alias("n"))
    periods = [r[0] for r in sums.select(period).distinct().orderBy(period).collect()]
    grid = sums.select(level).distinct().withColumn(period, F.explode(F.lit(periods)))
    w = Window.partitionBy(level).orderBy(period)
    so_far, further = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, 1)
    mean = lambda over: F.try_divide(F.sum("s").over(over), F.sum("n").over(over))
    value = F.when(F.col(period).isin(periods[:ahead]), mean(further)).otherwise(mean(so_far)) if ahead else mean(so_far)
    return grid.join(sums, [level, period], "left").select(level, period, value.alias(name))


def over_performers(df: DataFrame, period: str, actual: str, expected: str, games: str, order: list, top: int, place: int, quantile: float, least_games: int, name: str) -> DataFrame:
    """1 for those of a period's top that beat expectation by at least the quantile of that gap, reach the points of the
    given place and have enough games; else 0. Only the top's rows are returned."""
    w = Window.partitionBy(period)
    best = df.withColumn("tf_rn", F.row_number().over(Window.partitionBy(period).orderBy(*order))).where(F.col("tf_rn") <= top)
    gap = F.col(actual) - F.col(expected)
    best = best.withColumns({"tf_gap": F.percentile(gap, F.lit(quantile)).over(w), "tf_line": F.max(F.when(F.col("tf_rn") == F.least(F.lit(place), F.count("*").over(w)), F.col(actual))).over(w)})
    good = (gap >= F.col("tf_gap")) & (F.col(actual) >= F.col("tf_line")) & (F.col(games) > least_games)
    return best.withColumn(name, good.cast("int")).drop("tf_rn", "tf_gap", "tf_line")


def clamp_interval(df: DataFrame, pred: str, std: str, low: str, high: str, width: float = 1.5) -> DataFrame:
    """In this order: a deviation below 0 becomes 1; a high below the prediction and a low above it move by width * std."""
    df = df.withColumn(std, F.when(F.col(std) < 0, F.lit(1.0)).otherwise(F.col(std)))
    df = df.withColumn(high, F.when(F.col(high) < F.col(pred), F.col(pred) + width * F.col(std)).otherwise(F.col(high)))
    return df.withColumn(low, F.when(F.col(low) > F.col(pred), F.col(pred) - width * F.col(std)).otherwise(F.col(low)))


def collinear(df: DataFrame, cols: list[str], target: str, least: float, most: float) -> list[str]:
    """Columns by falling correlation with the target, at least `least`, and at most `most` with one already taken. All
    correlations come from one aggregation."""
    pairs = [(a, b) for i, a in enumerate([*cols, target]) for b in [*cols, target][i + 1 :]]
    r = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs)).first().asDict()
    of = lambda a, b: abs(r.get(f"{a}|{b}", r.get(f"{b}|{a}")) or 0)
    out: list[str] = []
    for c in sorted(cols, key=lambda c: (-of(c, target), c)):
        if of(c, target) >= least and all(of(c, o) <= most for o in out):
            out.append(c)
    return out


def quantile(df: DataFrame, col: str, q: float, few: int = 100_000, accuracy: int = 10_000) -> float | None:
    """The exact linearly interpolated quantile of a whole column, null values aside.

    An exact percentile keeps every distinct value in one task. Here approximate percentiles give a bracket around the
    wanted ranks, a scan counts what lies below it, and the bracket is narrowed the same way until at most `few` values are
    left, which are sorted on the driver; a bracket of one value is the answer. So no task and no driver holds the column.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where("x IS NOT NULL")
    n = x.count()
    if not n:
        return None
    rank = q * (n - 1)
    low = int(rank)
    high, below, rows = min(low + 1, n - 1), 0, n
    while rows > few:
        near = [max(0.0, (low - below) / rows - 2 / accuracy), min(1.0, (high - below + 1) / rows + 2 / accuracy)]
        a, b = x.agg(F.percentile_approx("x", [float(v) for v in near], accuracy)).first()[0]
        under, inside = x.agg(F.count_if(F.col("x") < a), F.count_if(F.col("x").between(a, b))).first()
        if a == b and below + under <= low and high < below + under + inside:
            return a
        if inside == rows or not (below + under <= low and high < below + under + inside):
            return quantiles_by(df.select(F.lit(1).alias("tf_one"), col), ["tf_one"], col, {"q": q}).first()["q"]
        x, below, rows = x.where(F.col("x").between(a, b)), below + under, inside
    values = sorted(r["x"] for r in x.collect())
    a, b = values[low - below], values[high - below]
    return a + (b - a) * (rank - low)


def class_metrics(df: DataFrame, chance: str, label: str, cut: float = 0.5) -> DataFrame:
    """One row: the Brier score of a chance and the Matthews correlation of its verdict at `cut`; null if a margin is empty."""
    p, y, said = F.col(chance), F.col(label), F.col(chance) >= cut
    count = lambda c: F.count_if(c).cast("double")
    cells = df.agg(F.avg((p - y) * (p - y)).alias("brier"), count(said & (y == 1)).alias("tp"), count(said & (y == 0)).alias("fp"), count(~said & (y == 1)).alias("fn"), count(~said & (y == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select("brier", F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("matthews"))


def best_features(df: DataFrame, features: list[str], target: str, k: int) -> list[str]:
    """The k features of greatest F value of a linear fit, which is r2 * (n - 2) / (1 - r2) and so grows with the squared
    correlation. One aggregation."""
    r = df.agg(*(F.corr(c, target).alias(c) for c in features)).first().asDict()
    return sorted(features, key=lambda c: (-abs(r[c] or 0.0), c))[:k]


def quantiles_by(df: DataFrame, keys: list[str], col: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of each group by name, null values aside, without a task that holds a group:
    the rows at the wanted places come from ranked(). Groups of a null key are left out."""
    x = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("tf_x"))
    n = x.groupBy(*keys).agg(F.count("*").alias("tf_all"))
    places = ranked(x, keys, "tf_x", False, [], "tf_rank").join(n, keys)
    want = {name: q * (F.col("tf_all") - 1) for name, q in quantiles.items()}
    at = lambda place: F.max(F.when(F.col("tf_rank") - 1 == place, F.col("tf_x")))
    ends = [c for name, w in want.items() for c in (at(F.floor(w)).alias(f"tf_a_{name}"), at(F.ceil(w)).alias(f"tf_b_{name}"), F.max(w - F.floor(w)).alias(f"tf_f_{name}"))]
    value = lambda name: F.when(F.col(f"tf_a_{name}") == F.col(f"tf_b_{name}"), F.col(f"tf_a_{name}")).otherwise(F.col(f"tf_a_{name}") * (1 - F.col(f"tf_f_{name}")) + F.col(f"tf_b_{name}") * F.col(f"tf_f_{name}"))
    return places.groupBy(*keys).agg(*ends).select(*keys, *(value(name).alias(name) for name in quantiles))

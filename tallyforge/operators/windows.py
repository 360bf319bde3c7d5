"""Ordered operators: each takes and returns a DataFrame and names its output columns. Ties need a full order in `order`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def rolling(df: DataFrame, keys: list[str], order: list, cols: list[str], n: int, agg: str, least: int = 1, fill: float | None = None, prefix: str = "") -> DataFrame:
    """agg over the last n rows (not n periods), nulls skipped; with fewer than `least` values the result is `fill`."""
    w = _over(keys, order).rowsBetween(1 - n, 0)
    f = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[agg]
    return df.withColumns({f"{prefix}{c}_r{n}_{agg}": F.when(F.count(c).over(w) >= least, f(c).over(w)).otherwise(F.lit(fill)) for c in cols})


def forward_fill(df: DataFrame, keys: list[str], order: list, cols: list[str]) -> DataFrame:
    """The last non-null value so far; leading nulls stay."""
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def rank_min(df: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    """Descending rank with ties on the lowest; null has none."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(col))
    return df.withColumn(name, F.when(F.col(col).isNotNull(), F.rank().over(w)))


def number(df: DataFrame, keys: list[str], order: list, name: str, start: int = 1) -> DataFrame:
    return df.withColumn(name, F.row_number().over(_over(keys, order)) + (start - 1))


def share(df: DataFrame, keys: list[str], col: str, epsilon: float, name: str) -> DataFrame:
    """The row's part of its group's sum."""
    return with_totals(df, keys, {"tf_sum": F.sum(col)}).withColumn(name, F.col(col) / (F.col("tf_sum") + epsilon)).drop("tf_sum")


def with_totals(df: DataFrame, keys: list[str], totals: dict) -> DataFrame:
    """df with aggregates of each row's group by name. Groups are summed up before they are shuffled and joined back, so that no task holds
    one, as a window without an order would; null keys are a group."""
    return _by_keys(df, df.groupBy(*keys).agg(*(t.alias(name) for name, t in totals.items())), keys)


def over_replacement(df: DataFrame, keys: list[str], kind: str, points: str, ranks: dict[str, int], order: list, name: str) -> DataFrame:
    """Points less those of the k-th of the group, k by `kind` and at most the group's size; null for an unknown kind."""
    return over_replacements(df, keys, kind, points, {name: ranks}, order)


def over_replacements(df: DataFrame, keys: list[str], kind: str, points: str, boards: dict[str, dict[str, int]], order: list) -> DataFrame:
    """over_replacement() for several tables of ranks at once, by the names of their columns.

    Only each group's first rows, as many as the greatest k, are ranked (a limit that works before the shuffle): the k-th, or
    the last of a smaller group, is the last of the first k. These lines are joined back.
    """
    most = max(k for ranks in boards.values() for k in ranks.values())
    top = df.withColumn("tf_rn", F.row_number().over(_over(keys, order))).where(F.col("tf_rn") <= most)
    k = {name: F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(kind)] for name, ranks in boards.items()}
    lines = top.groupBy(*keys).agg(*(F.max_by(points, F.when(F.col("tf_rn") <= k[name], F.col("tf_rn"))).alias(f"tf_{name}") for name in boards))
    value = {name: F.when(F.col(kind).isin(*ranks), F.col(points) - F.col(f"tf_{name}")) for name, ranks in boards.items()}
    return _by_keys(df, lines, keys, "left").withColumns(value).drop(*(f"tf_{name}" for name in boards))


def _by_keys(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined with an aggregate of its own, by keys that may be null. As nothing is filtered by the join, both sides read
    the same and what they compute in common is computed once."""
    names = {k: f"tf_k{i}" for i, k in enumerate(keys)}
    return df.join(groups.withColumnsRenamed(names), _all([F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]), how).drop(*names.values())


def after_top(df: DataFrame, keys: list[str], by: str, ties: str, n: int) -> DataFrame:
    """The rows behind each group's first n by falling `by` and then rising `ties`; only the first n are ranked."""
    order = [F.desc(by), F.col(ties)]
    top = df.withColumn("tf_rn", F.row_number().over(_over(keys, order))).where(F.col("tf_rn") <= n)
    last = top.groupBy(*keys).agg(F.max_by(F.struct(F.col(by).alias("by"), F.col(ties).alias("tie")), "tf_rn").alias("tf_last"))
    behind = (F.col(by) < F.col("tf_last.by")) | ((F.col(by) == F.col("tf_last.by")) & (F.col(ties) > F.col("tf_last.tie")))
    return _by_keys(df, last, keys).where(behind).drop("tf_last")


def ranked(df: DataFrame, keys: list[str], by: str, descending: bool, ties: list, name: str, runs: int = 64) -> DataFrame:
    """row_number of each group by a number and then by `ties`, without a task that holds a group.

    Approximate percentiles cut each group into runs of its range; a row's place is the number of rows in the runs before
    and its place in its own. The result is exact wherever the cuts lie. Nulls come last. df is computed twice.
    """
    cuts = df.groupBy(*keys).agg(F.percentile_approx(by, [k / runs for k in range(1, runs)], 10_000).alias("tf_cuts"))
    run = F.size(F.filter("tf_cuts", lambda x: x < F.col(by)))
    run = F.when(F.col(by).isNull(), F.lit(runs)).otherwise(F.lit(runs - 1) - run if descending else run)
    dealt = _by_keys(df, cuts, keys).withColumn("tf_run", run).drop("tf_cuts")
    sizes = dealt.groupBy(*keys, "tf_run").agg(F.count("*").alias("tf_n"))
    before = Window.partitionBy(*keys).orderBy("tf_run").rowsBetween(Window.unboundedPreceding, -1)  # at most runs + 1 rows
    sizes = sizes.withColumn("tf_base", F.coalesce(F.sum("tf_n").over(before), F.lit(0))).drop("tf_n")
    first = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    placed = dealt.withColumn("tf_place", F.row_number().over(_over([*keys, "tf_run"], [first, *ties])))
    out = _by_keys(placed, sizes, [*keys, "tf_run"])
    return out.withColumn(name, F.col("tf_base") + F.col("tf_place")).drop("tf_base", "tf_place", "tf_run")


def _all(conditions: list):
    return reduce(lambda a, b: a & b, conditions)


def equal_buckets(df: DataFrame, keys: list[str], by: str, descending: bool, ties: list, n: int, name: str) -> DataFrame:
    """ceil(N / n) rows per bucket in the order of a number and then of `ties`; the last ones come out short or empty."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / n).alias("tf_size"))
    out = _by_keys(ranked(df, keys, by, descending, ties, "tf_rank"), sizes, keys)
    return out.withColumn(name, F.floor((F.col("tf_rank") - 1) / F.col("tf_size")).cast("int")).drop("tf_rank", "tf_size")


def running(df: DataFrame, keys: list[str], order: list, col: str, agg: str, name: str) -> DataFrame:
    """agg over all rows so far."""
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    f = {"min": F.min, "max": F.max, "sum": F.sum, "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}[agg]
    return df.withColumn(name, f(col).over(w))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order."""
    return number(df, keys, order, "tf_first").where("tf_first = 1").drop("tf_first")


def extreme_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first rows of each key with all ties."""
    return df.withColumn("tf_rank", F.rank().over(_over(keys, order))).where("tf_rank = 1").drop("tf_rank")

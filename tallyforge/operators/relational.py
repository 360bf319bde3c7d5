"""Relational operators over whole frames: column sets by pattern or by data, set operations, unions and lookups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, test: Callable[[str], bool], keys: list[str]) -> DataFrame:
    """The keys and all columns whose name passes."""
    return df.select(*keys, *(c for c in df.columns if c not in keys and test(c)))


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns))


def drop_constant(df: DataFrame, keep: list[str]) -> DataFrame:
    """Without the columns of exactly one distinct value (nulls aside). One aggregation; one row of counts reaches the driver."""
    counts = df.agg(*(F.count_distinct(c).alias(c) for c in df.columns)).first().asDict()
    return df.drop(*(c for c, n in counts.items() if n == 1 and c not in keep))


def drop_with_nulls(df: DataFrame) -> DataFrame:
    """Without the columns that have a null."""
    nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns)).first().asDict()
    return df.drop(*(c for c, n in nulls.items() if n))


def one_hot(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values})


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By name; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose key isn't in new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def join_all(first: DataFrame, others: list[DataFrame], on: list[str], how: str = "left") -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, how), others, first)


def predicate(df: DataFrame, column: str, operator: str, value: float) -> DataFrame:
    """A filter out of a settings table; only comparison operators and known columns pass."""
    if operator not in ("<", "<=", ">", ">=", "==", "!=") or column not in df.columns:
        raise ValueError(f"not a predicate: {column} {operator}")
    c, v = F.col(column), F.lit(value)
    return df.where({"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v, "==": c == v, "!=": c.isNull() | (c != v)}[operator])


def first_of_names(df: DataFrame) -> DataFrame:
    """Of columns that share a name, as after a join, the first one."""
    names, seen, keep = [], set(), []
    for k, c in enumerate(df.columns):
        names.append(f"{c}__{k}")
        if c.lower() not in seen:
            seen.add(c.lower())
            keep.append(F.col(names[-1]).alias(c))
    return df.toDF(*names).select(*keep)


def columns_to_fill(stat: str, sources: list[str], drop: list[str] = ()) -> list[str]:
    """The columns of a statistic, one per source, without those of `drop`."""
    return [f"{stat}{s}" for s in sources if s not in drop]

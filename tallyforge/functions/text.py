"""Text similarity, out of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(a: Column, b: Column) -> Column:
    """Twice the number of common signs, without regard to order, over the length of both; 1 for two empty texts. Each
    distinct sign of one text is counted in both by what is left without it."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, sign, F.lit("")))
    signs = F.array_distinct(F.filter(F.split(a, ""), lambda x: x != ""))
    common = F.aggregate(signs, F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * common / total)

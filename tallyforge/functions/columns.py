"""Column builders: null-aware row statistics, tolerant casts, safe ratios, text cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """a / (b + epsilon); null where the divisor is 0."""
    return F.try_divide(a, b + F.lit(epsilon))


def present(cols: list[Column]) -> Column:
    """The non-null values of a row as an array."""
    return F.filter(F.array(*[c.cast("double") for c in cols]), lambda x: x.isNotNull())


def row_mean(cols: list[Column]) -> Column:
    """Mean over the row's non-null values; null if there is none."""
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    return F.try_divide(row_sum(cols), n)


def row_sum(cols: list[Column]) -> Column:
    """Sum over the row where null counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])


def row_std(cols: list[Column]) -> Column:
    """Sample deviation over the row's non-null values; null for fewer than two."""
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    mean = row_mean(cols)
    squares = reduce(lambda a, b: a + b, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols])
    return F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1)))


def weighted_sum(weights: dict[str, float]) -> Column:
    """Sum of column * weight where null counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w)) for c, w in weights.items()])


def half_even(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits)


def no_nan(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


#: The marks and suffixes that are deleted from names, in this order.
NAME_MARKS = ["*", "'", "+", "%", ",", "III", "II", ".", "Jr"]


def title(c: Column) -> Column:
    """Every letter that doesn't follow a letter large, all others small. Where only blanks stand before words, that is
    initcap; other texts are gone through sign by sign."""
    signs = F.split(c, "")
    after_letter = lambda i: F.coalesce(F.get(signs, i - 1).rlike(r"\p{L}"), F.lit(False))
    slow = F.array_join(F.transform(signs, lambda x, i: F.when((i > 0) & after_letter(i), F.lower(x)).otherwise(F.upper(x))), "")
    return F.when(c.rlike(r"[^\p{L} ]\p{L}"), slow).otherwise(F.initcap(c))


def clean_name(c: Column, renames: dict[str, str] | None = None) -> Column:
    """Delete marks and suffixes, hyphens to blanks, letters that follow none large, trimmed; then known renames."""
    for mark in NAME_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(""))
    c = F.trim(title(F.replace(c, F.lit("-"), F.lit(" "))))
    for old, new in (renames or {}).items():
        c = F.when(c == old, F.lit(new)).otherwise(c)
    return c


def clean_number(c: Column) -> Column:
    """Text without * + % , $ and blanks as a number; null if it is none."""
    return F.translate(F.trim(c), "*+%,$  ", "").try_cast("double")


def scrub(c: Column, missing: tuple[str, ...] = ("-", "#DIV/0!", "#VALUE!", "UNK", "")) -> Column:
    """Tokens for a missing value become null, then a tolerant cast."""
    return F.when(F.trim(c).isin(*missing), None).otherwise(clean_number(c))


def feet_inches(c: Column) -> Column:
    """'6-2' as inches."""
    part = F.split(c, "-")
    return F.get(part, F.lit(0)).try_cast("int") * 12 + F.get(part, F.lit(1)).try_cast("int")


def look_up(c: Column, table: dict, default=None) -> Column:
    """The table's value for a column; what isn't in it gets the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[c], F.lit(default)) if default is not None else pairs[c]

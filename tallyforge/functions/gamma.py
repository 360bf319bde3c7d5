"""Gamma draws as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.normal import inverse

#: Tries of the rejection method; one fails with a chance below 1 in 20, so all do in fewer than one of 10 ** 15 draws.
TRIES = 12


def gamma(shape: Column, uniforms: Callable[[Column], tuple[Column, Column]]) -> Column:
    """A draw of a gamma distribution of shape from 1 on and scale 1; null below. uniforms gives, for the number of a try, two
    independent numbers in (0, 1). A try cubes a shifted normal draw (Marsaglia and Tsang 2000); the first that passes counts, and
    should none pass, the distribution's mode-like value shape - 1 / 3."""
    d = shape - F.lit(1 / 3)
    c = 1 / F.sqrt(9 * d)

    def attempt(k: Column) -> Column:
        u, v = uniforms(k)
        return F.struct(inverse(u).alias("z"), F.ln(v).alias("l"))

    def cubed(x: Column) -> Column:
        return F.pow(1 + c * x["z"], F.lit(3.0))

    passes = lambda x: (cubed(x) > 0) & (x["l"] < x["z"] * x["z"] / 2 + d - d * cubed(x) + d * F.ln(F.greatest(cubed(x), F.lit(1e-300))))
    first = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(TRIES)), attempt), passes), F.lit(0))
    return F.when(shape >= 1, d * F.coalesce(F.pow(1 + c * first["z"], F.lit(3.0)), F.lit(1.0)))

"""Normal distributions as column expressions: distribution function, its inverse, truncated and skewed draws."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The coefficients of the inverse normal distribution of algorithm AS 241 (Wichura 1988), numerators and
# denominators from the constant term up, for the middle, the tails and the far tails.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
#: Beyond so many deviations the distribution function is taken as 0 or 1; the terms of its series up to there.
REACH, TERMS = 7.5, 120


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def _fraction(x: Column, parts: tuple) -> Column:
    return _polynomial(x, parts[0]) / _polynomial(x, parts[1])


def inverse(p: Column) -> Column:
    """The standard normal quantile of a chance strictly between 0 and 1; null outside."""

    def of(x: Column) -> Column:
        middle = _let(F.lit(0.180625) - (x - 0.5) * (x - 0.5), lambda r: _fraction(r, MIDDLE)) * (x - 0.5)
        outer = _let(F.sqrt(-F.ln(F.least(x, 1 - x))), lambda r: F.when(r <= 5, _fraction(r - 1.6, TAIL)).otherwise(_fraction(r - 5, FAR)))
        return F.when((x > 0) & (x < 1), F.when(F.abs(x - 0.5) <= 0.425, middle).otherwise(F.signum(x - 0.5) * outer))

    return _let(p, of)


def distribution(z: Column) -> Column:
    """The standard normal distribution function: one half and the density times the sum of z, z ** 3 / 3, z ** 5 / 15, ... The
    series is summed up in batches; the session's workers must have this package (ship())."""
    return F.when(F.isnan(z), 1.0).otherwise(_below(z.cast("double")))


@F.pandas_udf(T.DoubleType())
def _below(z: pd.Series) -> pd.Series:
    x = z.to_numpy(float)
    far = np.abs(x) >= REACH
    term = np.where(far, 0.0, x)
    at, total = term, term.copy()
    for k in range(1, TERMS + 1):
        term = term * at * at / (2 * k + 1)
        total += term
    return pd.Series(np.where(far, np.where(x > 0, 1.0, 0.0), 0.5 + np.exp(-at * at / 2) / math.sqrt(2 * math.pi) * total))


def shares(mean: Column, sd: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """How much of a normal distribution lies below low and below high; null without a deviation."""
    return distribution(F.try_divide(low - mean, sd)), distribution(F.try_divide(high - mean, sd))


def truncated(u: Column, below: tuple[Column, Column], mean: Column, sd: Column, low: Column, high: Column) -> Column:
    """The quantile at u of a normal distribution between low and high, of which `below` are the shares; without a positive
    deviation, the mean inside the limits."""
    p = F.least(F.greatest(below[0] + u * (below[1] - below[0]), F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.least(F.greatest(F.when(sd > 0, mean + sd * inverse(p)).otherwise(mean), low), high)


def with_truncated(df: DataFrame, u: Column, below: tuple[Column, Column], mean: Column, sd: Column, low: Column, high: Column, name: str) -> DataFrame:
    """df with truncated() as a column, by columns one after the other, which Spark compiles, as it does not compile functions of
    array elements: for many draws."""
    x, r = F.col("tf_x"), F.col("tf_r")
    df = df.withColumn("tf_x", F.least(F.greatest(below[0] + u * (below[1] - below[0]), F.lit(1e-12)), F.lit(1 - 1e-12)))
    near = F.abs(x - 0.5) <= 0.425
    df = df.withColumn("tf_r", F.when(near, F.lit(0.180625) - (x - 0.5) * (x - 0.5)).otherwise(F.sqrt(-F.ln(F.least(x, 1 - x)))))
    outer = F.when(r <= 5, _fraction(r - 1.6, TAIL)).otherwise(_fraction(r - 5, FAR))
    df = df.withColumn("tf_z", F.when(near, _fraction(r, MIDDLE) * (x - 0.5)).otherwise(F.signum(x - 0.5) * outer))
    value = F.least(F.greatest(F.when(sd > 0, mean + sd * F.col("tf_z")).otherwise(mean), low), high)
    return df.withColumn(name, value).drop("tf_x", "tf_r", "tf_z")


def skewed(u: Column, v: Column, skew: float) -> Column:
    """A standard skew-normal draw of a given skew parameter from two independent uniform numbers."""
    d = skew / math.sqrt(1 + skew * skew)
    return F.lit(d) * F.abs(inverse(u)) + F.lit(math.sqrt(1 - d * d)) * inverse(v)

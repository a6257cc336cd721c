"""Special functions that Spark lacks, as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; a plain expression is repeated in each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def log_factorial(k: Column) -> Column:
    """ln(k!) for a whole number k >= 0."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i))


def erf(x: Column) -> Column:
    """The error function by its series of positive terms; beyond 6 it is 1 in double precision."""

    def series(v: Column) -> Column:
        first = F.struct(v.alias("term"), v.alias("sum"))
        step = lambda s, n: F.struct((s["term"] * 2 * v * v / (2 * n + 1)).alias("term"), (s["sum"] + s["term"] * 2 * v * v / (2 * n + 1)).alias("sum"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(140)), first, step, lambda s: s["sum"]) * F.exp(-v * v) * (2 / math.sqrt(math.pi))

    a = F.abs(x)
    return F.signum(x) * F.when(a > 6, F.lit(1.0)).otherwise(let(F.least(a, F.lit(6.0)), series))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))

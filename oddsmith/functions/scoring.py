"""Proper scores of forecasts given as arrays of probabilities, outcome as a place from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import let, total

LOG_FLOOR = 1e-15
SUM_TOLERANCE = 1e-9


def valid_forecast(p: Column, outcome: Column) -> Column:
    return F.coalesce((F.abs(total(p) - 1) <= SUM_TOLERANCE) & (outcome >= 0) & (outcome < F.size(p)), F.lit(False))


def ranked_probability_score(p: Column, outcome: Column) -> Column:
    def score(s: Column) -> Column:
        first = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("sum"))
        step = lambda a, i: let(a["gap"] + F.get(s["p"], i) - F.when(i == s["o"], 1.0).otherwise(0.0), lambda g: F.struct(g.alias("gap"), (a["sum"] + g * g).alias("sum")))
        return F.aggregate(F.sequence(F.lit(0), F.size(s["p"]) - 2), first, step, lambda a: a["sum"]) / (F.size(s["p"]) - 1)

    return let(F.struct(p.alias("p"), outcome.cast("int").alias("o")), score)


def rps3(p0: Column, p1: Column, p2: Column, outcome: Column) -> Column:
    """The same for three outcomes that sum to 1, without arrays."""
    hit = lambda k: F.when(outcome == k, 1.0).otherwise(0.0)
    return (F.pow(p0 - hit(0), F.lit(2.0)) + F.pow(p2 - hit(2), F.lit(2.0))) / 2


def rps2(p0: Column, outcome: Column) -> Column:
    return F.pow(p0 - F.when(outcome == 0, 1.0).otherwise(0.0), F.lit(2.0))


def brier_score(p: Column, outcome: Column) -> Column:
    return total(F.transform(p, lambda q, i: F.pow(q - F.when(i == outcome, 1.0).otherwise(0.0), F.lit(2.0))))


def log_loss(p: Column, outcome: Column) -> Column:
    return -F.log(F.greatest(F.get(p, outcome.cast("int")), F.lit(LOG_FLOOR)))

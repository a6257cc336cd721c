"""Checks of input rows, for all operators in one of two modes.

Strict: the job fails at the first bad row, and its error names the check. Lenient: bad rows are left out, and an Observation
counts them by check, in the same pass. Either way no bad row reaches an operator, where it would become a null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import margin, scoring
from ..functions.special import total

POSTCONDITION = 1e-9


def checked(df: DataFrame, checks: dict[str, Column], strict: bool = True, seen: Observation | None = None) -> DataFrame:
    """The rows of df that meet all checks; a check that is null counts as failed.

    seen gets `rows` and, for each check, the number of rows that fail it; a strict job that fails leaves no counts.
    """
    met = {name: F.coalesce(c, F.lit(False)) for name, c in checks.items()}
    if seen is not None:
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(~c).alias(name) for name, c in met.items()])
    if not strict:
        return df.where(reduce(Column.__and__, met.values()))
    ok = F.lit(True)
    for name, c in reversed(met.items()):
        ok = F.when(c, ok).otherwise(F.raise_error(F.lit(f"failed check: {name}")).cast("boolean"))
    return df.where(ok)


def book_checks(implied: str = "implied") -> dict[str, Column]:
    """What a margin can be taken out of."""
    p = F.col(implied)
    return {
        "at least two outcomes": F.size(p) >= 2,
        "implied probabilities above 0": F.forall(p, lambda x: x > 0),
        "implied probabilities below 1": F.forall(p, lambda x: x < 1),
        "book sum of at least 1": total(p) >= 1 - margin.TOLERANCE,
    }


def forecast_checks(probabilities: str = "p", outcome: str = "outcome") -> dict[str, Column]:
    """What can be scored."""
    p, o = F.col(probabilities), F.col(outcome)
    return {
        "probabilities of at least 0": F.forall(p, lambda x: (x >= 0) & ~F.isnan(x)),
        "probabilities that add up": F.abs(total(p) - 1) <= scoring.SUM_TOLERANCE,
        "an outcome of the forecast": (o >= 0) & (o < F.size(p)),
    }


def match_checks(as_of: Column | None = None, weight: str | None = None) -> dict[str, Column]:
    """What strengths can be fitted to; with as_of, nothing at or after it, so that no fit sees what it predicts."""
    named = lambda c: F.trim(F.col(c)) != ""
    goals = lambda c: (F.col(c) >= 0) & (F.col(c) == F.floor(c))
    out = {
        "a kickoff": F.col("kickoff").isNotNull(), "named teams": named("home") & named("away"), "two different teams": F.col("home") != F.col("away"),
        "goals of 0 or more": goals("home_goals") & goals("away_goals"),
    }
    if as_of is not None:
        out["strictly earlier than the fit"] = F.col("kickoff") < as_of
    if weight is not None:
        out["a weight of 0 or more"] = (F.col(weight) >= 0) & (F.col(weight) < float("inf"))
    return out


def price_checks(prices: str, target: Column) -> dict[str, Column]:
    """What putting a margin in must have given: prices above 1 whose implied probabilities add up to the target."""
    p = F.col(prices)
    return {"prices above 1": F.forall(p, lambda d: d > 1), "prices that add up to the target": F.abs(total(F.transform(p, lambda d: 1 / d)) - target) <= POSTCONDITION}


def offered_prices(fair: DataFrame, target: Column, probabilities: str = "p", out: str = "prices", strict: bool = True, seen: Observation | None = None) -> DataFrame:
    """Rows with prices to the target, each checked against it; where no exponent gives them, the row fails."""
    return checked(fair.withColumn(out, margin.apply_overround(F.col(probabilities), target)), price_checks(out, target), strict, seen)

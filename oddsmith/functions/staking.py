"""Stakes, settlement and closing-line value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KELLY_FRACTION = 0.25


def expected_value(p: Column, price: Column) -> Column:
    return price * p - 1


def kelly(p: Column, price: Column, fraction: float = KELLY_FRACTION) -> Column:
    """Fractional Kelly stake, never negative; null where the price isn't above 1 or p no probability."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    edge = ((price - 1) * p - (1 - p)) / (price - 1)
    return F.when((price > 1) & p.between(0, 1), F.greatest(F.lit(0.0), fraction * edge))


def selected(model: Column, benchmark: Column, minimum_edge: float = 0.0) -> Column:
    return model - benchmark > minimum_edge


def stake(model: Column, benchmark: Column, price: Column, staking: str = "flat", fraction: float = KELLY_FRACTION, minimum_edge: float = 0.0) -> Column:
    if staking not in ("flat", "kelly"):
        raise ValueError("staking is flat or kelly")
    size = F.lit(1.0) if staking == "flat" else kelly(model, price, fraction)
    return F.when(selected(model, benchmark, minimum_edge), size).otherwise(0.0)


def profit(stake_: Column, price: Column, won: Column) -> Column:
    return F.when(won, stake_ * (price - 1)).otherwise(-stake_)


def roi(profits: Column, stakes: Column) -> Column:
    """Aggregate: undefined, not zero, without a stake."""
    return F.try_divide(F.sum(profits), F.nullif(F.sum(stakes), F.lit(0.0)))


def closing_line_value(taken: Column, closing: Column, selected_: Column | None = None) -> Column:
    value = F.when((taken > 1) & (closing > 1), F.log(taken / closing))
    return value if selected_ is None else F.when(selected_, value).otherwise(0.0)

"""Time decay of past matches."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_life_to_rate(days: Column) -> Column:
    return F.when(days > 0, math.log(2) / days)


def rate_to_half_life(rate: Column) -> Column:
    return F.when(rate > 0, math.log(2) / rate)


def age_days(kickoff: Column, as_of: Column) -> Column:
    """Days from kickoff to as_of as a fraction; null unless the match is strictly earlier, so that nothing leaks."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days = (micros(as_of) - micros(kickoff)) / F.lit(86_400_000_000.0)
    return F.when(days > 0, days)


def time_weight(kickoff: Column, as_of: Column, rate: Column) -> Column:
    return F.when(rate >= 0, F.exp(-rate * age_days(kickoff, as_of)))

"""Periods, histories, forecasts from given strengths, and the choice of a decay rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing
from ..schema import BURN_IN, CALIBRATION, MAX_RATE, MIN_RATE


def season_start(code: Column) -> Column:
    """First year of a season code such as 9394; codes from 90 on belong to the 1900s."""
    yy = F.substring(code, 1, 2).cast("int")
    return F.when(yy >= 90, 1900 + yy).otherwise(2000 + yy)


def season_code(year: Column) -> Column:
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    return F.concat(two(year), two(year + 1))


def split_periods(matches: DataFrame, burn_in: int = BURN_IN, calibration: int = CALIBRATION) -> DataFrame:
    """(league, season, place, period); leagues whose seasons leave nothing to evaluate are left out."""
    seasons = matches.select("league", "season").distinct()
    w = Window.partitionBy("league")
    ranked = seasons.withColumn("place", F.dense_rank().over(w.orderBy(season_start(F.col("season"))))).withColumn("_n", F.max("place").over(w))
    period = F.when(F.col("place") <= burn_in, "burn_in").when(F.col("place") <= burn_in + calibration, "calibration").otherwise("evaluation")
    return ranked.where(F.col("_n") > burn_in + calibration).select("league", "season", "place", period.alias("period"))


def history_counts(matches: DataFrame) -> DataFrame:
    """(league, day, n_matches, n_history): matches of the day and of all earlier days of the league."""
    days = matches.groupBy("league", F.date_trunc("day", "kickoff").alias("day")).agg(F.count(F.lit(1)).alias("n_matches"))
    w = Window.partitionBy("league").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("n_history", F.coalesce(F.sum("n_matches").over(w), F.lit(0)))


def outcome_of(home_goals: Column, away_goals: Column) -> Column:
    return F.when(home_goals > away_goals, 0).when(home_goals == away_goals, 1).otherwise(2)


def price_fixtures(rated: DataFrame) -> DataFrame:
    """Forecasts of rows with lambda_home, lambda_away, rho. Rates must lie strictly within (0.05, 6); rho may lie at its bounds."""
    lam, mu, rho = F.col("lambda_home"), F.col("lambda_away"), F.col("rho")
    ok = (lam > MIN_RATE) & (lam < MAX_RATE) & (mu > MIN_RATE) & (mu < MAX_RATE) & pricing.rho_admissible(lam, mu, rho)
    out = pricing.with_outcomes(rated.where(ok), "lambda_home", "lambda_away", "rho")
    return out.withColumns({"outcome": outcome_of(F.col("home_goals"), F.col("away_goals")), "p_under25": 1 - F.col("p_over25")})


def paired_calibration(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(half_life_days, n_all, mean_rps_all, n_paired, mean_rps_paired) from (half_life_days, keys, rps).

    The paired mean is over fixtures that every candidate has priced.
    """
    k = scores.select("half_life_days").distinct().agg(F.count(F.lit(1)).alias("_k"))
    common = scores.groupBy(*keys).agg(F.countDistinct("half_life_days").alias("_c")).join(F.broadcast(k)).where("_c = _k").select(*keys, F.lit(True).alias("_paired"))
    rows = scores.join(common, keys, "left")
    return rows.groupBy("half_life_days").agg(
        F.count(F.lit(1)).alias("n_all"), F.avg("rps").alias("mean_rps_all"), F.count_if("_paired").alias("n_paired"), F.avg(F.when(F.col("_paired"), F.col("rps"))).alias("mean_rps_paired")
    )


def select_half_life(calibration: DataFrame, by: str = "mean_rps_paired") -> DataFrame:
    """The candidate with the least mean score; of equal ones the first. by='mean_rps_all' compares unpaired means."""
    return calibration.where(F.col(by).isNotNull()).orderBy(by, "half_life_days").limit(1)

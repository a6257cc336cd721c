"""The fit's objective and gradient for given strengths, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decay import time_weight
from ..functions.pricing import low_score_factor, rho_high, rho_low
from ..functions.special import log_factorial

PENALTY = 1e12


def weighted_matches(matches: DataFrame, as_of: Column, rate: Column) -> DataFrame:
    """Matches strictly before as_of with their weight."""
    return matches.withColumn("w", time_weight(F.col("kickoff"), as_of, rate)).where("w is not null")


def identifiable_teams(weighted: DataFrame, minimum: float = 1.0) -> DataFrame:
    """(league, team, weight) of teams whose matches, home and away, carry at least the minimum weight; one pass."""
    sides = weighted.select("league", F.explode(F.array("home", "away")).alias("team"), "w")
    return sides.groupBy("league", "team").agg(F.sum("w").alias("weight")).where(F.col("weight") >= minimum)


def between_identifiable(weighted: DataFrame, teams: DataFrame) -> DataFrame:
    home = teams.select("league", F.col("team").alias("home"))
    away = teams.select("league", F.col("team").alias("away"))
    return weighted.join(home, ["league", "home"], "left_semi").join(away, ["league", "away"], "left_semi")


def team_index(usable: DataFrame) -> DataFrame:
    """(league, team, idx): place of each team among the league's sorted names, from 0."""
    from pyspark.sql import Window

    teams = usable.select("league", F.explode(F.array("home", "away")).alias("team")).distinct()
    return teams.withColumn("idx", F.row_number().over(Window.partitionBy("league").orderBy("team")) - 1)


def rates(matches: DataFrame, strengths: DataFrame, fits: DataFrame) -> DataFrame:
    """Add lambda_home, lambda_away, rho. strengths: league, team, attack, defence; fits: league, gamma, rho.

    A match with a team that has no strength goes.
    """
    h = strengths.select("league", F.col("team").alias("home"), F.col("attack").alias("_ha"), F.col("defence").alias("_hd"))
    a = strengths.select("league", F.col("team").alias("away"), F.col("attack").alias("_aa"), F.col("defence").alias("_ad"))
    out = matches.join(h, ["league", "home"]).join(a, ["league", "away"]).join(fits.select("league", "gamma", "rho"), "league")
    return out.withColumn("lambda_home", F.col("_ha") * F.col("_ad") * F.col("gamma")).withColumn("lambda_away", F.col("_aa") * F.col("_hd")).drop("_ha", "_hd", "_aa", "_ad", "gamma")


def _tau() -> Column:
    return low_score_factor(F.col("home_goals"), F.col("away_goals"), F.col("lambda_home"), F.col("lambda_away"), F.col("rho"))


def negative_log_likelihood(rated: DataFrame, weight: str = "w") -> DataFrame:
    """(league, n, nll): weighted, without factorials; the penalty where a factor isn't positive."""
    lam, mu, x, y = F.col("lambda_home"), F.col("lambda_away"), F.col("home_goals"), F.col("away_goals")
    tau = _tau()
    term = F.col(weight) * (F.log(F.when(tau > 0, tau)) + x * F.log(lam) - lam + y * F.log(mu) - mu)
    out = rated.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.count_if(tau <= 0).alias("_bad"), F.sum(term).alias("_s"))
    return out.select("league", "n", F.when(F.col("_bad") > 0, PENALTY).otherwise(-F.col("_s")).alias("nll"))


def log_factorial_offset(rated: DataFrame, weight: str = "w") -> DataFrame:
    return rated.groupBy("league").agg(F.sum(F.col(weight) * (log_factorial(F.col("home_goals")) + log_factorial(F.col("away_goals")))).alias("offset"))


def gradient_by_team(rated: DataFrame, weight: str = "w") -> DataFrame:
    """(league, team, d_log_attack, d_log_defence) of the negative log-likelihood, before any constraint is folded in."""
    lam, mu, rho, x, y, w = (F.col(c) for c in ("lambda_home", "lambda_away", "rho", "home_goals", "away_goals", weight))
    tau = _tau()
    d_lam = F.when((x == 0) & (y == 0), -mu * rho).when((x == 0) & (y == 1), rho).otherwise(0.0) / tau
    d_mu = F.when((x == 0) & (y == 0), -lam * rho).when((x == 1) & (y == 0), rho).otherwise(0.0) / tau
    g_home, g_away = w * (x - lam + lam * d_lam), w * (y - mu + mu * d_mu)  # by the log of each rate
    sides = rated.select("league", g_home.alias("gh"), g_away.alias("ga"), "home", "away").select(
        "league", F.explode(F.array(
            F.struct(F.col("home").alias("team"), F.col("gh").alias("attack"), F.col("ga").alias("defence")),
            F.struct(F.col("away").alias("team"), F.col("ga").alias("attack"), F.col("gh").alias("defence")),
        )).alias("s"))
    return sides.groupBy("league", F.col("s.team").alias("team")).agg((-F.sum("s.attack")).alias("d_log_attack"), (-F.sum("s.defence")).alias("d_log_defence"))


def rho_violation(rated: DataFrame) -> DataFrame:
    """(league, violation): how far rho lies outside what the worst match admits, 0 where it doesn't."""
    lam, mu, rho = F.col("lambda_home"), F.col("lambda_away"), F.col("rho")
    worst = F.greatest(F.lit(0.0), F.max(rho_low(lam, mu) - rho), F.max(rho - rho_high(lam, mu)))
    return rated.groupBy("league").agg(worst.alias("violation"))

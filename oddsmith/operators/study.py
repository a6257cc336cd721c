"""The study as a chain: periods, calibration by real fits, the frozen rate, evaluation with intervals, and its files."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..schema import HALF_LIVES, LEAGUES
from ..sources.seasons import pending_leagues, write_by_league
from ..sources.shared import written
from . import books as closing
from .bootstrap import stationary_bootstrap
from .cells import CELL, cell_results, scored, selections
from .fitting import rated_fixtures, walk_forward
from .protocol import paired_calibration, price_fixtures, select_half_life, split_periods

SEED = 20260817
MIN_CELL = 200


def strict(df: DataFrame, valid: Column, message: str) -> DataFrame:
    """df, whose job fails with the message at the first row that isn't valid, instead of going on without it."""
    return df.where(F.when(F.coalesce(valid, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def seasons_in(periods: DataFrame, names: Sequence[str] = ("calibration", "evaluation")) -> DataFrame:
    """(league, season) of these periods; by default all that are scored."""
    return periods.where(F.col("period").isin(*names)).select("league", "season")


def shared_seasons(periods: DataFrame) -> DataFrame:
    """(league, season, n_periods) of seasons that lie in more than one period; empty where the periods are disjoint."""
    return periods.groupBy("league", "season").agg(F.countDistinct("period").alias("n_periods")).where("n_periods > 1")


def check_disjoint(periods: DataFrame) -> None:
    found = shared_seasons(periods).orderBy("league", "season").limit(5).collect()
    if found:
        raise ValueError("seasons in more than one period: " + ", ".join(f"{r['league']} {r['season']}" for r in found))


def rate_of(half_life_days: float) -> float:
    return math.log(2.0) / half_life_days


def candidate_rates(matches: DataFrame, half_lives: Sequence[float] = HALF_LIVES, min_fit_matches: int = 300) -> DataFrame:
    """Every candidate's own walk-forward over the calibration seasons, all fitted in one pass over the history, see fit_inputs."""
    lives = [float(h) for h in half_lives]
    rated = rated_fixtures(matches, seasons_in(split_periods(matches), ("calibration",)), [rate_of(h) for h in lives], min_fit_matches)
    return rated.withColumn("half_life_days", F.element_at(F.array(*[F.lit(h) for h in lives]), F.col("candidate") + 1))


def candidate_table(rated: DataFrame) -> DataFrame:
    """half_life_days, rate, n_all, mean_rps_all, n_paired, mean_rps_paired of every candidate of candidate_rates."""
    score = scoring.rps3(F.col("p_home"), F.col("p_draw"), F.col("p_away"), F.col("outcome"))
    scores = price_fixtures(rated).select("half_life_days", "league", "kickoff", "home", "away", score.alias("rps"))
    return paired_calibration(scores, ["league", "kickoff", "home", "away"]).withColumn("rate", F.lit(math.log(2.0)) / F.col("half_life_days"))


def calibrate(matches: DataFrame, half_lives: Sequence[float] = HALF_LIVES, min_fit_matches: int = 300) -> DataFrame:
    """candidate_table from fits of each candidate's own. The fits are written to the shared folder first, as scores are read twice."""
    return candidate_table(written(candidate_rates(matches, half_lives, min_fit_matches), "candidate-rates"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark writes to."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jpath, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_table(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for the small tables of a report."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_calibration(table: DataFrame, path: str) -> dict:
    """calibration (CSV) and calibration.json (indented) below path; returns what the JSON holds.

    The table has a row per candidate. A choice at an end of the candidates is marked, as the grid is too narrow then.
    """
    spark = table.sparkSession
    rows = [r.asDict() for r in table.orderBy("mean_rps_paired", "half_life_days").collect()]
    means = [r["mean_rps_paired"] for r in rows if r["mean_rps_paired"] is not None]
    best = next((r for r in rows if r["mean_rps_paired"] is not None), None)
    if best is None:
        raise ValueError("no fixture was priced by every candidate")
    lives = [r["half_life_days"] for r in rows]
    found = {
        "xi": best["rate"], "half_life_days": best["half_life_days"], "mean_rps_paired": best["mean_rps_paired"], "n_paired": best["n_paired"],
        "selected_at_grid_boundary": best["half_life_days"] in (min(lives), max(lives)), "paired_rps_spread": max(means) - min(means), "candidates": rows,
    }
    write_table(table.orderBy("mean_rps_paired", "half_life_days"), f"{path}/calibration.csv")
    write_text(spark, f"{path}/calibration.json", json.dumps(found, indent=2) + "\n")
    return found


def frozen_rate(registration: str, calibration: dict, tolerance: float = 1e-9) -> float:
    """The rate that a registration names ("xi = ..."); it must be the calibrated one, else the evaluation may not run."""
    named = re.search(r"xi\s*=\s*([0-9]*\.?[0-9]+(?:e-?[0-9]+)?)", registration)
    if not named:
        raise ValueError("the registration names no rate")
    rate = float(named[1])
    if not abs(rate - float(calibration["xi"])) <= tolerance:
        raise ValueError(f"the registered rate {rate} isn't the calibrated one, {calibration['xi']}")
    return rate


def with_roi_intervals(results: DataFrame, forecasts: DataFrame, complete: DataFrame, order: str = "kickoff", n_resamples: int = 2000, seed: int = SEED) -> DataFrame:
    """Cell results with roi_low and roi_high: the stationary bootstrap of each cell's bets in time order."""
    group = [*CELL, "method"]
    bets = selections(scored(forecasts, complete)).where("stake > 0")
    places = [c for c in dict.fromkeys([order, "home", "away", "place"]) if c in bets.columns]
    ends = stationary_bootstrap(bets.select(*group, *places, "profit"), group, places, "profit", seed, n_resamples)
    return results.join(ends.select(*group, F.col("low").alias("roi_low"), F.col("high").alias("roi_high")), group, "left")


def first_complete_books(complete: DataFrame, order: Sequence[str] = ("kickoff", "home", "away")) -> DataFrame:
    """The first complete closing book in time of each bookmaker and market."""
    place = F.row_number().over(Window.partitionBy("book", "market").orderBy(*order))
    return complete.withColumn("_place", place).where("_place = 1").drop("_place")


def evaluate(matches: DataFrame, odds: DataFrame, rate: float, path: str, min_fit_matches: int = 300, min_cell: int = MIN_CELL, n_resamples: int = 2000) -> DataFrame:
    """Results of all cells, written to path/cells.csv, from forecasts kept in path/forecasts, a partition for each league.

    Leagues that are there already aren't fitted again, so a lost run goes on where it stopped.
    """
    spark = matches.sparkSession
    matches, odds = closing.normalise_keys(matches), closing.normalise_keys(odds)
    periods = split_periods(matches)
    check_disjoint(periods)
    store = f"{path}/forecasts"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    todo = pending_leagues(matches, spark.read.parquet(store)) if there else matches.select("league").distinct()
    names = [r["league"] for r in todo.orderBy("league").collect()]
    if names:
        own = matches.where(F.col("league").isin(*names))
        write_by_league(walk_forward(own, seasons_in(periods, ("evaluation",)), rate, min_fit_matches), store)
    forecasts = closing.normalise_keys(spark.read.parquet(store))
    complete = closing.closing_books(odds)
    results = cell_results(forecasts, complete, min_cell, "home")
    results = with_roi_intervals(results, forecasts, complete, n_resamples=n_resamples)
    write_table(results.orderBy(*CELL, "method"), f"{path}/cells.csv")
    return results


def forecast_counts(forecasts: DataFrame) -> DataFrame:
    """(league, n_forecasts) of forecasts as write_by_league leaves them: no column is read, the files' footers have the counts."""
    return forecasts.groupBy("league").agg(F.count(F.lit(1)).alias("n_forecasts"))


def cached_margins(odds: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """book_margins of the closing books, kept at path and read from there unless a refresh is asked for."""
    spark = odds.sparkSession
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if refresh or not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        closing.book_margins(closing.closing_books(odds)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_coverage(matches: DataFrame, odds: DataFrame, path: str, leagues: Sequence[str] = LEAGUES) -> tuple[DataFrame, DataFrame]:
    """(full, eligible) coverage, both written as CSV below path; eligible has the leagues with enough seasons only."""
    full = closing.coverage_matrix(odds, matches)
    keep = closing.eligible_leagues(full, tuple(leagues)).select("league")
    eligible = closing.eligible_cells(full).join(keep, "league", "left_semi")
    write_table(full, f"{path}/coverage.csv")
    write_table(eligible, f"{path}/coverage_eligible.csv")
    return full, eligible

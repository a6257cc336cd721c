"""Evaluate every cell (league, book, market) of the odds study, and write a report partitioned by league.

From the tables of orders and their lines come matches, prices and the model's forecasts. Each cell is scored under every margin
method; its row holds scores, the test against the model, what flat stakes return, the book's margin, how many seasons the
book closes, and whether the difference is a discovery among all cells of its method, at a given rate of false ones.

A league's rows replace those of an earlier run and nothing else, so the job can be repeated, or run for some leagues alone.
Discoveries are among the cells of the leagues that a run evaluates.

    python -m jobs.league_reports --tables /data/tables --output /data/reports
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, session, settings
from oddsmith.operators import books, cells, inference
from oddsmith.plans import surrogate
from oddsmith.sources.shared import passing, read_or_empty, settled, written

NAME = "league_reports"
REPORT = (
    "book string, market string, method string, n_matches long, n_arbitrage long, n_seasons long, mean_book_sum double, model_rps double, bench_rps double, "
    "rps_diff double, dm_stat double, dm_p double, q_value double, discovery boolean, n_bets long, roi double, league string"
)


def reports(matches: DataFrame, odds: DataFrame, forecasts: DataFrame, least_matches: int = 1, discovery_rate: float = 0.1) -> DataFrame:
    """The rows of REPORT. A cell is left out if fewer than least_matches books of it carry a margin."""
    spark = odds.sparkSession
    closing = written(books.closing_books(odds), "books")
    # ranking reads the results twice, and their rows would else lie there till the job ends
    results = settled(spark, "cell-results", lambda: cells.cell_results(forecasts, closing, minimum_matches=least_matches))
    margins = books.book_margins(closing).select(*books.CELL, "mean_book_sum")
    seasons = books.eligible_cells(books.coverage_matrix(odds, matches)).groupBy(*books.CELL).agg(F.countDistinct("season").alias("n_seasons"))
    tested = inference.adjusted_p_values(results, "dm_p", ["method"])
    out = tested.join(margins, books.CELL, "left").join(seasons, books.CELL, "left")
    out = out.withColumn("discovery", F.col("q_value") <= discovery_rate)
    return out.select(*[c.strip().split()[0] for c in REPORT.split(",")])


def run(spark: SparkSession, tables: str, output: str, config: dict | None = None) -> dict[str, int]:
    """Write the reports; the number of rows and leagues that were written."""
    config = settings(NAME) | (config or {})
    matches, odds, forecasts = (f(spark, tables) for f in (surrogate.matches, surrogate.odds, surrogate.forecasts))
    if config["leagues"] is not None:
        matches, odds, forecasts = (d.where(F.col("league").isin(*config["leagues"])) for d in (matches, odds, forecasts))
    log.info("reading matches, prices and forecasts of %s from %s", config["leagues"] or "all leagues", tables)
    with passing(spark):
        rows = reports(matches, odds, forecasts, config["least_matches"], config["discovery_rate"])
        rows.repartition("league").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("league").parquet(output)
    held = read_back(spark, output)
    own = held if config["leagues"] is None else held.where(F.col("league").isin(*config["leagues"]))
    n, leagues = own.agg(F.count(F.lit(1)), F.countDistinct("league")).first()
    log.info("wrote %d rows of %d leagues to %s", n, leagues, output)
    return {"rows": n, "leagues": leagues}


def read_back(spark: SparkSession, output: str) -> DataFrame:
    return read_or_empty(spark, output, REPORT)


def main() -> None:
    args = argparse.ArgumentParser(prog="python -m jobs.league_reports", description=__doc__.split("\n", 1)[0])
    args.add_argument("--tables", required=True, help="folder with orders.parquet and lineitem.parquet")
    args.add_argument("--output", required=True, help="folder of what is written")
    args.add_argument("--config", help="a JSON file that replaces settings")
    a = args.parse_args()
    with session(NAME) as spark:
        run(spark, a.tables, a.output, settings(NAME, a.config, spark))


if __name__ == "__main__":
    main()

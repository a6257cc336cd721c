"""Coverage, complete closing books and their margins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.margin import with_fair
from ..schema import COMPOSITE_BOOKS, MATCH_KEYS, OUTCOMES

CELL = ["league", "book", "market"]


def _required() -> Column:
    return reduce(lambda w, m: w.when(F.col("market") == m, len(OUTCOMES[m])), OUTCOMES, F.when(F.lit(False), 0))


def normalise_keys(df: DataFrame) -> DataFrame:
    """Match keys in canonical types, so that tables from different files join."""
    cast = {c: F.trim(F.col(c).cast("string")) for c in ("league", "season", "home", "away")}
    return df.withColumns({**cast, "kickoff": F.col("kickoff").cast("timestamp_ntz")})


def coverage_matrix(odds: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per (league, season, book, market): opening, closing, n_matches of the league season, n_with_closing.

    A match counts as closed when all outcomes of its market have a closing price.
    """
    group = ["league", "season", "book", "market"]
    periods = odds.groupBy(*group).agg(F.bool_or(F.col("period") == "open").alias("opening"), F.bool_or(F.col("period") == "close").alias("closing"))
    per_match = odds.where("period = 'close'").groupBy(*group, "kickoff", "home", "away").agg(F.size(F.collect_set("outcome")).alias("k"))
    complete = per_match.where(F.col("k") >= _required()).groupBy(*group).agg(F.count(F.lit(1)).alias("n_with_closing"))
    size = matches.groupBy("league", "season").agg(F.count(F.lit(1)).alias("n_matches"))
    out = periods.join(complete, group, "left").join(size, ["league", "season"], "left")
    return out.select(*group, "opening", "closing", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("n_with_closing", F.lit(0)).alias("n_with_closing"))


def unknown_markets(odds: DataFrame) -> DataFrame:
    """Markets that have no list of outcomes; the coverage of such rows is undefined."""
    return odds.where(~F.col("market").isin(*OUTCOMES)).select("market").distinct()


def eligible_cells(coverage: DataFrame) -> DataFrame:
    return coverage.where("closing and n_with_closing > 0")


def eligible_leagues(coverage: DataFrame, leagues: tuple[str, ...] | None = None, more_than: int = 5) -> DataFrame:
    """Leagues with more than so many seasons in the eligible cells."""
    own = eligible_cells(coverage)
    own = own.where(F.col("league").isin(*leagues)) if leagues else own
    return own.groupBy("league").agg(F.countDistinct("season").alias("n_seasons")).where(F.col("n_seasons") > more_than)


def book_report(coverage: DataFrame) -> DataFrame:
    return eligible_cells(coverage).groupBy("book").agg(F.sum("n_with_closing").alias("n_with_closing"), F.count(F.lit(1)).alias("n_cells"))


def closing_books(odds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Complete closing books of all cells: keys, book, market and prices, an array in the market's order of outcomes.

    Of repeated prices of an outcome the least seq is taken where there is such a column, else the least price. One
    aggregation serves every cell; nothing is looped over.
    """
    keys = keys or (["seq"] if "seq" in odds.columns else []) + MATCH_KEYS
    order = "seq" if "seq" in odds.columns else "decimal"
    close = odds.where("period = 'close' and decimal > 1")
    outcomes = sorted({o for names in OUTCOMES.values() for o in names})
    wide = close.groupBy(*keys, "book", "market").agg(*[F.min_by("decimal", F.when(F.col("outcome") == o, F.col(order))).alias(f"d_{o}") for o in outcomes])
    prices = reduce(lambda w, m: w.when(F.col("market") == m, F.array(*[F.col(f"d_{o}") for o in OUTCOMES[m]])), OUTCOMES, F.when(F.lit(False), F.array().cast("array<double>")))
    wide = wide.withColumn("prices", prices).where("prices is not null and forall(prices, d -> d is not null)")
    implied = F.transform("prices", lambda d: 1 / d)
    return wide.select(*keys, "book", "market", "prices", implied.alias("implied"), F.aggregate(implied, F.lit(0.0), lambda a, x: a + x).alias("book_sum"))


def margined(books: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Books of bookmakers that carry a margin; sums that are 1 but for rounding don't count."""
    return books.where((F.col("book_sum") > 1 + tolerance) & ~F.col("book").isin(*COMPOSITE_BOOKS))


def arbitrage_counts(books: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    return books.groupBy(*CELL).agg(F.count_if(F.col("book_sum") <= 1 + tolerance).alias("n_arbitrage"), F.count(F.lit(1)).alias("n_books"))


def book_margins(books: DataFrame) -> DataFrame:
    return books.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_books"), F.avg("book_sum").alias("mean_book_sum"), F.percentile("book_sum", 0.5).alias("median_book_sum"))


def fair_books(books: DataFrame) -> DataFrame:
    """A row per book and method, with fair probabilities."""
    return with_fair(books, "implied")

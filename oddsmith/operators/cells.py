"""Scores, bets and tests of every (league, book, market) cell under every margin method, in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scoring, staking
from ..functions.margin import METHODS
from ..schema import MATCH_KEYS, OUTCOMES
from ..sources.shared import release, written
from . import guards
from .books import CELL, fair_books, margined
from .inference import diebold_mariano

MODEL = {"1X2": ("p_home", "p_draw", "p_away"), "OU25": ("p_over25", "p_under25")}


def _by_market(values: dict[str, Column]) -> Column:
    first, *rest = values.items()
    return reduce(lambda w, kv: w.when(F.col("market") == kv[0], kv[1]), rest, F.when(F.col("market") == first[0], first[1]))


def priced_books(forecasts: DataFrame, books: DataFrame) -> DataFrame:
    """Margined books joined to their match's forecast: model (array), realised (place from 0), model_rps."""
    keys = [k for k in ["seq", *MATCH_KEYS] if k in forecasts.columns and k in books.columns]
    joined = margined(books).join(forecasts, keys)
    joined = joined.withColumn("model", _by_market({m: F.array(*c) for m, c in MODEL.items()}))
    realised = _by_market({"1X2": F.col("outcome"), "OU25": (F.col("home_goals") + F.col("away_goals") <= 2).cast("int")})
    return joined.withColumn("realised", realised.cast("int")).withColumn("model_rps", _rps("model"))


def _rps(p: str) -> Column:
    three = scoring.rps3(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)), F.col("realised"))
    return _by_market({"1X2": three, "OU25": scoring.rps2(F.get(p, F.lit(0)), F.col("realised"))})


def scored(forecasts: DataFrame, books: DataFrame, strict: bool | None = None, seen: Observation | None = None) -> DataFrame:
    """A row per book and method with bench_rps; the model's own score is made before the methods multiply the rows.

    strict: whether a book without a fair one or a forecast that can't be scored fails the job or is left out and counted in
    seen; by default such rows aren't looked for.
    """
    rows = priced_books(forecasts, books)
    if strict is not None:
        rows = guards.checked(rows, guards.book_checks("implied") | guards.forecast_checks("model", "realised"), strict, seen)
    return fair_books(rows).withColumn("bench_rps", _rps("fair"))


def selections(scored_books: DataFrame, staking_: str = "flat", minimum_edge: float = 0.0, fraction: float = staking.KELLY_FRACTION) -> DataFrame:
    """A row per outcome: place, model_p, fair_p, price, won, stake, profit."""
    out = scored_books.select("*", F.posexplode(F.arrays_zip("model", "fair", "prices")).alias("place", "s"))
    out = out.withColumns({"model_p": F.col("s.model"), "fair_p": F.col("s.fair"), "price": F.col("s.prices"), "won": F.col("place") == F.col("realised")}).drop("s")
    out = out.withColumn("stake", staking.stake(F.col("model_p"), F.col("fair_p"), F.col("price"), staking_, fraction, minimum_edge))
    return out.withColumn("profit", staking.profit(F.col("stake"), F.col("price"), F.col("won")))


def settlements(chosen: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_bets, turnover, total_profit and roi per group."""
    return chosen.groupBy(*(by or [*CELL, "method"])).agg(
        F.count_if(staking.selected(F.col("model_p"), F.col("fair_p"))).alias("n_bets"),
        F.sum("stake").alias("turnover"), F.sum("profit").alias("total_profit"), staking.roi(F.col("profit"), F.col("stake")).alias("roi"),
    )


def flat_bets(scored_books: DataFrame) -> DataFrame:
    """Add n_bets and profit of unit stakes on a book's value selections. The outcomes are spelled out, as a market has few and
    plain arithmetic is compiled."""

    def bet(i: int) -> Column:
        model, fair, price = (F.get(c, F.lit(i)) for c in ("model", "fair", "prices"))
        return F.when(staking.selected(model, fair), staking.profit(F.lit(1.0), price, F.col("realised") == i))

    bets = [bet(i) for i in range(max(map(len, OUTCOMES.values())))]
    n_bets = reduce(lambda x, y: x + y, [b.isNotNull().cast("long") for b in bets])
    return scored_books.withColumns({"n_bets": n_bets, "profit": reduce(lambda x, y: x + y, [F.coalesce(b, F.lit(0.0)) for b in bets])})


def cell_rows(forecasts: DataFrame, books: DataFrame, order: str = "seq", strict: bool | None = None, seen: Observation | None = None) -> DataFrame:
    """A narrow row per book and method: losses of the model (a) and the benchmark (b), n_bets and profit. strict and seen: as for scored."""
    rows = flat_bets(scored(forecasts, books, strict, seen))
    return rows.select(*CELL, "method", "kickoff", order, F.col("model_rps").alias("a"), F.col("bench_rps").alias("b"), "n_bets", "profit")


def cell_means(rows: DataFrame, minimum_matches: int = 1) -> DataFrame:
    """One row per cell and method of cell_rows: n_matches, model_rps, bench_rps, n_bets, roi. What needs no test reads these only,
    as one aggregation makes them."""
    return rows.groupBy(*CELL, "method").agg(
        F.count(F.lit(1)).alias("n_matches"), F.avg("a").alias("model_rps"), F.avg("b").alias("bench_rps"), F.sum("n_bets").alias("n_bets"),
        F.try_divide(F.sum("profit"), F.nullif(F.sum("n_bets"), F.lit(0))).alias("roi"),
    ).where(F.col("n_matches") >= minimum_matches)


def cell_tests(rows: DataFrame, minimum_matches: int = 1, order: str = "seq") -> DataFrame:
    """cell_means with rps_diff, dm_stat and dm_p. The rows are read twice, so they should be a written table."""
    group = [*CELL, "method"]
    dm = diebold_mariano(rows, group, list(dict.fromkeys(["kickoff", order]))).select(*group, F.col("mean_difference").alias("rps_diff"), F.col("statistic").alias("dm_stat"), F.col("p_value").alias("dm_p"))
    return cell_means(rows, minimum_matches).join(dm, group, "left")


def cell_results(forecasts: DataFrame, books: DataFrame, minimum_matches: int = 1, order: str = "seq", strict: bool | None = None, seen: Observation | None = None) -> DataFrame:
    """One row per cell and method: n_matches, model_rps, bench_rps, n_bets, roi, rps_diff, dm_stat, dm_p, n_arbitrage.
    strict and seen: as for scored.

    All cells are evaluated together: one join, one explode by method, then a narrow row per book and method, which is
    written to the shared folder as the means and the test both read it.
    """
    books = written(books, "books")  # for the scores and for those that carry no margin
    rows = written(cell_rows(forecasts, books, order, strict, seen), "cell-rows")
    release(rows.sparkSession)  # the shuffles of the prices, before those of the test
    keys = [k for k in ["seq", *MATCH_KEYS] if k in forecasts.columns and k in books.columns]
    lost = books.where(F.col("book_sum") <= 1 + 1e-9).join(forecasts.select(*keys), keys).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_arbitrage"))
    out = cell_tests(rows, minimum_matches, order).join(lost, CELL, "left")
    return out.withColumn("n_arbitrage", F.coalesce("n_arbitrage", F.lit(0)))


def per_cell(cells: DataFrame) -> DataFrame:
    """One row per cell: spreads over the methods of what is defined, and changes of sign."""
    at = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    out = cells.groupBy(*CELL).agg(
        F.max("n_matches").alias("n_matches"), (F.max("roi") - F.min("roi")).alias("roi_spread"), (F.max("bench_rps") - F.min("bench_rps")).alias("rps_spread"),
        F.min("roi").alias("roi_min"), F.max("roi").alias("roi_max"), at("proportional", "roi").alias("roi_proportional"), at("shin", "roi").alias("roi_shin"),
        (F.max("n_bets") - F.min("n_bets")).alias("n_bets_spread"),
    )
    return out.withColumns({
        "sign_flip": F.coalesce((F.col("roi_min") < 0) & (F.col("roi_max") > 0), F.lit(False)),
        "sign_flip_prop_shin": F.coalesce(F.signum("roi_proportional") != F.signum("roi_shin"), F.lit(False)),
    })


def method_places() -> dict[str, int]:
    return {m: i for i, m in enumerate(METHODS)}

"""Relations behind the study's tables and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .books import CELL
from .cells import method_places
from .inference import adjusted_p_values


def margin_pairs(cell_frame: DataFrame, margins: DataFrame) -> DataFrame:
    """Cells that have both a margin and a spread."""
    return cell_frame.join(margins.select(*CELL, "mean_book_sum"), CELL, "left").where("mean_book_sum is not null and roi_spread is not null")


def margin_spread_by_book(cell_frame: DataFrame, margins: DataFrame) -> DataFrame:
    joined = cell_frame.join(margins.select(*CELL, "mean_book_sum"), CELL, "left")
    out = joined.groupBy("book").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("mean_book_sum").alias("margin"), F.avg("roi_spread").alias("roi_spread"), F.avg("rps_spread").alias("rps_spread"))
    return out.where("margin is not null and roi_spread is not null")


def margin_spread_line(by_book: DataFrame) -> DataFrame:
    """Least-squares line of the spread on the margin."""
    return by_book.agg(F.count(F.lit(1)).alias("n_books"), F.regr_slope("roi_spread", "margin").alias("slope"), F.regr_intercept("roi_spread", "margin").alias("intercept"))


def market_pairs(cell_frame: DataFrame, value: str) -> DataFrame:
    """(league, book) pairs that have the value in both markets."""
    at = lambda m: F.max(F.when(F.col("market") == m, F.col(value)))
    return cell_frame.groupBy("league", "book").agg(at("1X2").alias("one_x_two"), at("OU25").alias("over_under")).where("one_x_two is not null and over_under is not null")


def market_comparison(cell_frame: DataFrame) -> DataFrame:
    parts = []
    for name in ("roi_spread", "rps_spread"):
        p = market_pairs(cell_frame, name)
        parts.append(p.agg(
            F.lit(name).alias("quantity"), F.count(F.lit(1)).alias("n_pairs"), F.avg("one_x_two").alias("one_x_two"), F.avg("over_under").alias("over_under"),
            F.avg(F.col("one_x_two") - F.col("over_under")).alias("difference"), F.avg((F.round(F.col("one_x_two") - F.col("over_under"), 10) > 0).cast("double")).alias("share_larger"),
        ))
    return parts[0].unionByName(parts[1])


def sign_flips(cell_frame: DataFrame, most: int = 20) -> DataFrame:
    """Top cells whose ROI changes sign between the proportional and the Shin benchmark."""
    return cell_frame.where("sign_flip_prop_shin").orderBy(F.desc("roi_spread"), *CELL).limit(most).select(*CELL, "n_matches", "roi_proportional", "roi_shin", "roi_spread")


def sign_flip_shares(cell_frame: DataFrame) -> DataFrame:
    return cell_frame.agg(F.count_if("sign_flip_prop_shin").alias("n_prop_shin"), F.count_if("sign_flip").alias("n_any"), F.avg(F.col("sign_flip_prop_shin").cast("double")).alias("share_prop_shin"), F.count(F.lit(1)).alias("n_cells"))


def method_table(cells: DataFrame, q: float = 0.10) -> DataFrame:
    """Per method: means, share of cells in the model's favour, share with an adjusted p-value below q over all rows."""
    tested = adjusted_p_values(cells, "dm_p")
    place = F.create_map(*[x for m, i in method_places().items() for x in (F.lit(m), F.lit(i))])
    return tested.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("model_rps").alias("model_rps"), F.avg("bench_rps").alias("bench_rps"), F.avg("rps_diff").alias("rps_diff"),
        F.avg((F.col("rps_diff") < 0).cast("double")).alias("favours_model"), F.avg((F.col("q_value") < q).cast("double")).alias("significant"),
    ).withColumn("place", place[F.col("method")])


def coverage_table(cells: DataFrame) -> DataFrame:
    return cells.dropDuplicates(CELL).groupBy("league").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n_matches").alias("n_matches"))


def summary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.countDistinct(*CELL).alias("n_cells"), F.countDistinct("league").alias("n_leagues"), F.countDistinct("book").alias("n_books"))


def roi_histogram(cells: DataFrame, low: float, high: float, bins: int = 16) -> DataFrame:
    """Counts of cells per method and equal bin, the last one closed."""
    place = F.least(F.lit(bins), F.width_bucket("roi", F.lit(low), F.lit(high), F.lit(bins)))
    return cells.where(F.col("roi").between(low, high)).groupBy("method", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def share_above_diagonal(cells: DataFrame, method: str = "proportional") -> DataFrame:
    return cells.where(F.col("method") == method).agg(F.avg((F.col("model_rps") > F.col("bench_rps")).cast("double")).alias("share_above"), F.count(F.lit(1)).alias("n"))


def divergence_target(cell_frame: DataFrame) -> DataFrame:
    """The cell with the widest spread, ties by key."""
    return cell_frame.orderBy(F.desc_nulls_last("roi_spread"), *CELL).limit(1).select(*CELL, "roi_spread")


def longshot_places(books: DataFrame) -> DataFrame:
    """Place of the least implied probability of each book, the first of equal ones."""
    return books.select("*", (F.array_position("implied", F.array_min("implied")) - 1).cast("int").alias("longshot"))


def calibration_summary(candidates: DataFrame) -> DataFrame:
    """Best candidate, range of the mean score, and the ends of the sweep."""
    return candidates.agg(
        F.min_by("half_life_days", "mean_rps_paired").alias("best_half_life"), F.min("mean_rps_paired").alias("best"), (F.max("mean_rps_paired") - F.min("mean_rps_paired")).alias("range"),
        F.max_by("mean_rps_paired", "half_life_days").alias("no_decay"), F.min_by("mean_rps_paired", "half_life_days").alias("fastest"),
    )

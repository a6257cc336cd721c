"""Tidy odds from a stream of season files: new files are parsed as they arrive, repeated prices are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MATCH_KEYS
from ..sources.registry import known_names, registry
from ..sources.seasons import _cell, _fields, parse_kickoff, price_rows, records


def stream_odds(spark: SparkSession, root: str, delay: str | None = None) -> DataFrame:
    """Streaming odds. A file with a name outside the registry is skipped whole; its header is checked in its own row.

    A price that was there before is dropped. With a delay, such as "30 days", prices are remembered for that long by the times
    at which files were written, so that the state stays bounded: a price that comes again later is passed on again, and
    files older than the newest one by more than the delay are too late; the progress of the query counts their rows
    (numRowsDroppedByWatermark). Without one every price is remembered.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFileAge", "36500d").load(f"{root}/*/*.csv").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("written"), F.regexp_replace("value", "^\ufeff+", "").alias("text"))
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)\.csv$", i)
    files = files.withColumns({"season": part(1), "league": part(2)})
    files = files.withWatermark("written", delay) if delay else files
    # the header goes along with each line, so that no stream is joined with itself
    files = files.withColumn("lines", records(F.col("text")))
    known = F.array(*[F.lit(n) for n in sorted(known_names())])
    files = files.withColumn("header", _fields(F.coalesce(F.get("lines", F.lit(0)), F.lit(""))))
    files = files.where(F.size(F.array_except(F.filter("header", lambda h: h != ""), known)) == 0)
    rows = files.select("season", "league", "written", "header", F.explode(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))).alias("raw")).where("trim(raw) <> ''")
    rows = rows.withColumn("fields", _fields(F.col("raw")))
    tidy = rows.select("league", "season", "written", parse_kickoff(_cell("Date"), _cell("Time")).alias("kickoff"), _cell("HomeTeam", "HT").alias("home"), _cell("AwayTeam", "AT").alias("away"), "header", F.explode(F.arrays_zip("header", "fields")).alias("z"))
    cells = tidy.where("kickoff is not null and home <> '' and away <> ''").withColumns({"name": F.col("z.header"), "value": F.col("z.fields")})
    prices, key = price_rows(cells, registry(spark), ("written",)), [*MATCH_KEYS, "book", "market", "period", "outcome"]
    return (prices.dropDuplicatesWithinWatermark(key) if delay else prices.dropDuplicates(key)).drop("written")

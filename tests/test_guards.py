"""Each check fails a strict job with its name, and is counted in a lenient one."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_operators import league

from oddsmith.operators import cells, fitting, guards

BOOKS = {
    "at least two outcomes": [1.2], "implied probabilities above 0": [0.0, 0.6, 0.5], "implied probabilities below 1": [1.0, 0.2],
    "book sum of at least 1": [0.4, 0.5],
}
FORECASTS = {"probabilities of at least 0": ([-0.1, 1.1], 0), "probabilities that add up": ([0.5, 0.4], 0), "an outcome of the forecast": ([0.5, 0.5], 2)}
MATCHES = {
    "a kickoff": (None, "a", "b", 1.0, 0.0, 1.0), "named teams": ("2020-01-01", " ", "b", 1.0, 0.0, 1.0), "two different teams": ("2020-01-01", "a", "a", 1.0, 0.0, 1.0),
    "goals of 0 or more": ("2020-01-01", "a", "b", -1.0, 0.0, 1.0), "strictly earlier than the fit": ("2021-01-01", "a", "b", 1.0, 0.0, 1.0),
    "a weight of 0 or more": ("2020-01-01", "a", "b", 1.0, 0.0, float("nan")),
}


def cases(spark):
    p = spark.createDataFrame([("good", [0.5, 0.6]), ("fair", [0.5, 0.5]), *BOOKS.items(), ("null", None), ("null within", [None, 0.9, 0.9])], "name string, implied array<double>")
    yield p, guards.book_checks(), BOOKS, {"good", "fair"}
    f = spark.createDataFrame([("good", [0.2, 0.3, 0.5], 2), *[(k, *v) for k, v in FORECASTS.items()], ("null", [0.5, 0.5], None)], "name string, p array<double>, outcome int")
    yield f, guards.forecast_checks(), FORECASTS, {"good"}
    schema = "name string, kickoff string, home string, away string, home_goals double, away_goals double, w double"
    m = spark.createDataFrame([("good", "2020-12-31", "a", "b", 0.0, 3.0, 0.0), *[(k, *v) for k, v in MATCHES.items()], ("half a goal", "2020-01-01", "a", "b", 0.5, 0.0, 1.0)], schema)
    m = m.withColumn("kickoff", F.col("kickoff").cast("timestamp_ntz"))
    yield m, guards.match_checks(F.lit("2021-01-01").cast("timestamp_ntz"), "w"), MATCHES, {"good"}


def test_every_check(spark):
    for df, checks, bad, good in cases(spark):
        seen = Observation()
        kept = guards.checked(df, checks, strict=False, seen=seen)
        assert {r.name for r in kept.collect()} == good
        counts = seen.get
        assert counts["rows"] == df.count() and set(counts) == {"rows", *checks} and all(counts[name] >= 1 for name in bad)
        assert guards.checked(df.where(F.col("name").isin(*good)), checks).count() == len(good)
        for name in bad:
            with pytest.raises(Exception, match=f"failed check: {name}"):
                guards.checked(df.where(F.col("name") == name), checks).collect()


def test_prices_meet_their_target(spark):
    fair = spark.createDataFrame([([0.5, 0.3, 0.2], 1.07), ([0.9, 0.1], 1.02)], "p array<double>, target double")
    assert guards.offered_prices(fair, F.col("target")).count() == 2
    seen = Observation()
    beyond = fair.union(spark.createDataFrame([([0.5, 0.5], 2.5)], fair.schema))
    assert guards.offered_prices(beyond, F.col("target"), strict=False, seen=seen).count() == 2 and seen.get["prices that add up to the target"] == 1
    with pytest.raises(Exception, match="failed check: prices"):
        guards.offered_prices(beyond, F.col("target")).collect()


def test_operators_take_the_mode(spark):
    df, _ = league(rounds=2)
    m = spark.createDataFrame(df).withColumn("kickoff", F.col("kickoff").cast("timestamp_ntz"))
    cut = str(df["kickoff"].sort_values().iloc[len(df) // 2])
    seen = Observation()
    assert fitting.fit_strengths(m, cut, 0.001, strict=False, seen=seen).count() > 0
    assert seen.get["strictly earlier than the fit"] == (df["kickoff"] >= cut).sum()
    with pytest.raises(Exception, match="strictly earlier"):
        fitting.fit_strengths(m, cut, 0.001, strict=True).collect()
    books = spark.createDataFrame([(1, "E0", "B", "OU25", [1.8, 1.9], [1 / 1.8, 1 / 1.9], 1 / 1.8 + 1 / 1.9)], "seq long, league string, book string, market string, prices array<double>, implied array<double>, book_sum double")
    forecasts = spark.createDataFrame([(1, 0.4, 0.3, 0.3, 0.7, 0.4, 0, 1, 0)], "seq long, p_home double, p_draw double, p_away double, p_over25 double, p_under25 double, outcome int, home_goals long, away_goals long")
    assert cells.scored(forecasts, books, strict=False).count() == 0 and cells.scored(forecasts, books).count() == 4
    with pytest.raises(Exception, match="probabilities that add up"):
        cells.scored(forecasts, books, strict=True).collect()

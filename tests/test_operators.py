"""Coverage, inference, fitting and ingest on small tables."""

import hashlib
import math
from io import BytesIO
from urllib.error import HTTPError

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsmith.functions import decay
from oddsmith.operators import bootstrap, books, cells, fitting, inference, protocol
from oddsmith.sources import acquire, registry, seasons
from oddsmith.streaming import ingest


def test_murphy(spark):
    p, o = [0.1, 0.2, 0.25, 0.4, 0.55, 0.6, 0.7, 0.8, 0.85, 0.95], [0, 0, 0, 1, 0, 1, 1, 1, 1, 1]
    m = inference.murphy(spark.createDataFrame(list(zip(p, o)), "p double, o int")).first()
    assert m.brier == pytest.approx(0.109) and m.three_term == pytest.approx(0.10875) and m.within_variance == pytest.approx(0.00025) and m.uncertainty == pytest.approx(0.24)
    rng = np.random.default_rng(3)
    q = rng.random(500)
    m = inference.murphy(spark.createDataFrame([(float(x), int(y)) for x, y in zip(q, rng.random(500) < q)], "p double, o int")).first()
    assert m.five_term == pytest.approx(m.brier, abs=1e-12) and abs(m.within_covariance) > 1e-6


def test_newey_west_and_test_statistic(spark):
    rng = np.random.default_rng(5)
    x = np.zeros(600)
    for t in range(1, 600):
        x[t] = 0.85 * x[t - 1] + rng.normal()
    df = spark.createDataFrame([("s", i, float(v), 0.0) for i, v in enumerate(x)] + [("tie", i, 1.0, 1.0) for i in range(5)], "g string, t int, a double, b double")
    got = {r.g: r for r in inference.diebold_mariano(df, ["g"], "t").collect()}
    lag = math.floor(4 * 6 ** (2 / 9))
    c = x - x.mean()
    v = c @ c / 600 + 2 * sum((1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / 600 for k in range(1, lag + 1))
    assert got["s"].lag == lag and got["s"].statistic == pytest.approx(x.mean() / math.sqrt(v / 600)) and (got["tie"].statistic, got["tie"].p_value) == (0, 1)
    zero = {r.g: r for r in inference.newey_west(df, ["g"], "t", "a", lag=0).collect()}
    assert zero["s"].variance == pytest.approx(x.var())


def test_multiplicity(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    assert sorted(r.p for r in inference.rejected(df, "p", 0.05).where("rejected").collect()) == [0.001, 0.008]
    q = {r.p: r.q_value for r in inference.adjusted_p_values(df, "p").collect()}
    assert q[0.001] == pytest.approx(0.01) and q[0.039] == q[0.042] == pytest.approx(0.084) and max(q.values()) <= 1


def test_spearman_and_bootstraps(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, 40)
    y = x + rng.integers(0, 6, 40)
    df = spark.createDataFrame([(1, i, float(a), float(b), f"c{i % 5}") for i, (a, b) in enumerate(zip(x, y))], "g int, i int, x double, y double, c string")
    rho = inference.spearman(df, ["g"], "x", "y").first().rho
    assert rho == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank()))
    for f in (lambda: bootstrap.pair_bootstrap(df, ["g"], ["i"], "x", "y", 7, 200), lambda: bootstrap.cluster_bootstrap(df, ["g"], ["i"], "x", "y", "c", 7, 200)):
        a, b = f().first(), f().first()
        assert a == b and a.point == pytest.approx(rho) and a.low <= a.point <= a.high
    a = bootstrap.stationary_bootstrap(df, ["g"], ["i"], "y", 7, 300).first()
    assert a.low < a.point < a.high and a.point == pytest.approx(y.mean())
    d = bootstrap.mean_difference_bootstrap(df, ["g"], ["i"], "y", "x", 7, 300).first()
    assert d.low <= d.point <= d.high and d.point == pytest.approx((y - x).mean())
    assert bootstrap.pair_bootstrap(df.limit(2), ["g"], ["i"], "x", "y", 7).first().low is None


def odds_rows(spark, rows):
    return spark.createDataFrame([("E0", "2324", k, "A", "B", *r) for k, r in rows], "league string, season string, k string, home string, away string, book string, market string, period string, outcome string, decimal double").withColumn("kickoff", F.col("k").cast("timestamp_ntz")).drop("k")


def test_coverage_and_books(spark):
    full = [("2023-08-01", ("Bet365", "1X2", "close", o, d)) for o, d in (("H", 2.0), ("D", 3.4), ("A", 3.9))]
    part = [("2023-08-02", ("Bet365", "1X2", "close", o, d)) for o, d in (("H", 2.0), ("D", 3.4))] + [("2023-08-03", ("Max", "OU25", "open", "O", 1.9))]
    o = odds_rows(spark, full + part)
    m = o.select("league", "season", "kickoff", "home", "away").distinct()
    got = {(r.book, r.market): r for r in books.coverage_matrix(o, m).collect()}
    assert got["Bet365", "1X2"].n_with_closing == 1 and got["Bet365", "1X2"].n_matches == 3 and not got["Max", "OU25"].closing
    b = books.closing_books(o).collect()
    assert len(b) == 1 and b[0].prices == [2.0, 3.4, 3.9]
    assert books.unknown_markets(o.withColumn("market", F.lit("X"))).count() == 1
    composite = odds_rows(spark, [(k, ("Market maximum", *r[1:])) for k, r in full])
    assert books.margined(books.closing_books(composite)).count() == 0


def test_per_cell_ignores_undefined(spark):
    rows = [("E0", "B", "1X2", m, roi, 0.2, 5, 100) for m, roi in zip(("proportional", "power", "shin", "odds_ratio"), (-0.01, None, 0.02, 0.01))]
    c = cells.per_cell(spark.createDataFrame(rows, "league string, book string, market string, method string, roi double, bench_rps double, n_bets long, n_matches long")).first()
    assert c.roi_spread == pytest.approx(0.03) and c.sign_flip and c.sign_flip_prop_shin


def league(n_teams=8, rounds=3, seed=2):
    rng = np.random.default_rng(seed)
    attack = np.exp(rng.normal(0, 0.25, n_teams))
    attack /= np.exp(np.log(attack).mean())
    rows, day = [], pd.Timestamp("2020-08-01")
    for s in range(rounds):
        for i in range(n_teams):
            for j in range(n_teams):
                if i != j:
                    day += pd.Timedelta(days=1)
                    rows.append(("L", f"{20 + s}{21 + s}", day, f"T{i}", f"T{j}", int(rng.poisson(1.35 * attack[i])), int(rng.poisson(attack[j]))))
    return pd.DataFrame(rows, columns=["league", "season", "kickoff", "home", "away", "home_goals", "away_goals"]), attack


def test_gradient():
    df, _ = league()
    w = fitting.FitWindow(df["home"].to_numpy(str), df["away"].to_numpy(str), df["home_goals"].to_numpy(), df["away_goals"].to_numpy(), np.exp(-0.002 * np.arange(len(df))[::-1]))
    rng = np.random.default_rng(0)
    for _ in range(5):
        theta = w.start() + rng.normal(0, 0.05, 2 * w.n + 1)
        _, g = w.objective(theta)
        for k in range(len(theta)):
            e = np.zeros(len(theta))
            e[k] = 1e-6
            assert g[k] == pytest.approx((w.objective(theta + e)[0] - w.objective(theta - e)[0]) / 2e-6, abs=1e-3)
    theta, _, done = fitting.fit_window(w)
    assert done and np.abs(w.objective(theta)[1]).max() < 1e-4 and w.violation(theta) == 0


def test_recovery_and_row_order(spark):
    df, attack = league(rounds=12)
    one = fitting.fit_strengths(spark.createDataFrame(df)).orderBy("team").toPandas()
    assert np.corrcoef(one["attack"], attack)[0, 1] > 0.85 and one["gamma"].iloc[0] == pytest.approx(1.35, abs=0.15)
    two = fitting.fit_strengths(spark.createDataFrame(df.sample(frac=1, random_state=1))).orderBy("team").toPandas()
    assert np.allclose(one["attack"], two["attack"])


def test_no_look_ahead(spark):
    df, _ = league(rounds=4)
    m = spark.createDataFrame(df).withColumn("kickoff", F.col("kickoff").cast("timestamp_ntz"))
    scored = m.where("season = '2223'").select("league", "season")
    base = fitting.walk_forward(m, scored, 0.0017, min_fit_matches=50, days_per_block=9).orderBy("kickoff").toPandas()
    assert len(base) > 20
    days = df.set_index("kickoff").index
    assert all(r.n_fit_matches == (days < pd.Timestamp(r.kickoff).normalize()).sum() for r in base.itertuples())
    cut = base["kickoff"].iloc[len(base) // 2]
    later = m.withColumn("home_goals", F.when(F.col("kickoff") >= F.lit(str(cut)).cast("timestamp_ntz"), F.lit(7).cast("long")).otherwise(F.col("home_goals")))
    changed = fitting.walk_forward(later, scored, 0.0017, min_fit_matches=50, days_per_block=9).orderBy("kickoff").toPandas()
    n = int((base["kickoff"] < cut).sum())
    assert np.allclose(base["p_home"][:n], changed["p_home"][:n], atol=1e-12)


def test_seasons_and_ages(spark):
    codes = [(c,) for c in ("9394", "9900", "0001", "2324", "9495", "9596")]
    got = [r.s for r in spark.createDataFrame(codes, "c string").select(protocol.season_start(F.col("c")).alias("s")).collect()]
    assert got == [1993, 1999, 2000, 2023, 1994, 1995]
    p = protocol.split_periods(spark.createDataFrame([("L", c) for (c,) in codes], "league string, season string"))
    assert {r.season: r.period for r in p.collect()} == {"9394": "burn_in", "9495": "burn_in", "9596": "burn_in", "9900": "calibration", "0001": "calibration", "2324": "evaluation"}
    assert acquire.season_codes(1999, 2001) == ["9900", "0001", "0102"] and acquire.season_start_year("9394") == 1993
    with pytest.raises(ValueError):
        acquire.season_start_year("9396")
    at = F.lit("2020-01-11 00:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(decay.age_days(F.lit("2020-01-01 12:00:00").cast("timestamp_ntz"), at).alias("a"), decay.age_days(at, at).alias("b"), decay.half_life_to_rate(F.lit(400.0)).alias("x")).first()
    assert row.a == 9.5 and row.b is None and row.x == pytest.approx(math.log(2) / 400)


def test_paired_calibration(spark):
    rows = [(30.0, i, 0.2) for i in range(4)] + [(60.0, i, 0.21) for i in range(2, 6)]
    got = {r.half_life_days: r for r in protocol.paired_calibration(spark.createDataFrame(rows, "half_life_days double, k int, rps double"), ["k"]).collect()}
    assert got[30.0].n_all == 4 and got[30.0].n_paired == 2 and got[60.0].mean_rps_paired == pytest.approx(0.21)


FILES = {
    ("2324", "E0"): "﻿Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,B365H,B365D,B365A,B365CH,B365CD,B365CA,PSH,PSD,PSA,PH,PD,PA,B365>2.5,BbAHh\nE0,12/08/2023,15:00,Ars,Ful,2,1,1.5,4,7,1.55,4.1,6.5,1.51,4,7,1.5,4,7,1.8,-1\nE0,13/8/23,,Che,Liv,1,1,2.5,3.4,1,,,,,,,,,,,\nE0,bad,15:00,X,Y,1,1,,,,,,,,,,,,,,\n",
    ("9394", "E0"): "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG\nE0,14/08/93,Ars,Cov,0,3,,,\nE0,15/08/93,nan,Cov,0,3,,\n",
    ("0405", "D1"): "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,Zork\nD1,14/08/04,A,B,0,3,1\n",
    ("0506", "D1"): "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG\nD1,14/08/05,A,B,0,3,9\n",
    ("0607", "D1"): "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG\nE0,14/08/06,A,B,0,3\n",
    ("0708", "G1"): "Div,Date,HT,AT,HG,AG\nG1,2007-08-14,A,B,0,3\n",
    ("0809", "G1"): "",
}


@pytest.fixture
def archive(tmp_path):
    for (season, name), text in FILES.items():
        path = tmp_path / season / f"{name}.csv"
        path.parent.mkdir(exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_ingest(spark, archive):
    m, o, bad = seasons.load_seasons(spark, archive)
    got = {(r.season, r.home): r for r in m.collect()}
    assert set(got) == {("2324", "Ars"), ("2324", "Che"), ("9394", "Ars"), ("0708", "A")}
    assert str(got["2324", "Ars"].kickoff) == "2023-08-12 15:00:00" and str(got["2324", "Che"].kickoff) == "2023-08-13 00:00:00" and str(got["9394", "Ars"].kickoff) == "1993-08-14 00:00:00"
    prices = {(r.home, r.book, r.market, r.period, r.outcome): r.decimal for r in o.collect()}
    assert prices["Ars", "Pinnacle", "1X2", "open", "H"] == 1.51 and prices["Ars", "Bet365", "1X2", "close", "A"] == 6.5 and prices["Ars", "Bet365", "OU25", "open", "O"] == 1.8
    assert ("Che", "Bet365", "1X2", "open", "A") not in prices and o.count() == len(prices) == 12
    reasons = {"/".join(r.path.split("/")[-2:]): r.reason for r in bad.collect()}
    assert reasons["0405/D1.csv"].endswith("Zork") and "unnamed" in reasons["0506/D1.csv"] and "another" in reasons["0607/D1.csv"] and set(reasons) >= {"0405/D1.csv", "0506/D1.csv", "0607/D1.csv"}
    assert seasons.load_seasons(spark, archive, ["G1"])[0].count() == 1
    sums = {r.path.split("/")[-2]: r.sha256 for r in seasons.file_manifest(spark, archive).collect()}
    assert sums["0405"] == hashlib.sha256(FILES["0405", "D1"].encode()).hexdigest()


def test_stream(spark, archive, tmp_path):
    q = ingest.stream_odds(spark, archive).writeStream.format("memory").queryName("tidy").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tidy").where("book = 'Bet365' and period = 'close'").count() == 3


def test_registry():
    known, priced = registry.known_names(), registry.priced_names()
    assert len(priced) == 27 * 10 + 7 and priced["BFD"][2] == "D" and known["BbAHh"] == "asian" and known["PSCH"] == "odds" and "PCH" not in priced


def test_acquire(tmp_path):
    def opener(url):
        if "D1" in url:
            raise HTTPError(url, 404, "none", None, None)
        if "I1" in url:
            raise HTTPError(url, 500, "down", None, None)
        return BytesIO(b"Div\n" if "E0" in url else b" ")

    got = acquire.acquire(str(tmp_path), ["E0", "D1", "I1", "F1"], ["2324"], 0, opener)
    assert [len(x) for x in (got.downloaded, got.absent, got.failed)] == [1, 2, 1] and "1 downloaded" in got.summary
    assert len(acquire.acquire(str(tmp_path), ["E0"], ["2324"], 0, opener).cached) == 1

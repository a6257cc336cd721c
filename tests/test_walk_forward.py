"""Walk-forward from states: what it ships, and that it doesn't depend on how history is cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import league

from oddsmith.operators import fitting, study

RATES = [0.0231, 0.0017]


@pytest.fixture(scope="module")
def season(spark):
    df, _ = league(rounds=4)
    m = spark.createDataFrame(df).withColumn("kickoff", F.col("kickoff").cast("timestamp_ntz"))
    return m, m.where("season = '2223'").select("league", "season")


def test_rows_are_the_matches_and_bounded_states(season):
    m, scored = season
    last = m.join(scored.distinct(), ["league", "season"]).agg(F.max(F.date_trunc("day", "kickoff"))).first()[0]
    upto = m.where(F.date_trunc("day", "kickoff") <= F.lit(last)).count()
    counts = {}
    for rates in (RATES[:1], RATES * 5):
        rows = fitting.fit_inputs(m, scored, rates, chunks=3)
        states = rows.where("weights is not null")
        assert rows.where("weights is null").count() == upto and states.where(F.size("weights") != len(rates)).isEmpty()
        counts[len(rates)] = states.count()
        # each block's states stand for all matches before it
        ahead = rows.where("weights is null").groupBy("block").count().orderBy("block").collect()
        held = {r.block: r.n for r in states.groupBy("block").agg(F.sum("n").alias("n")).collect()}
        assert [held.get(r.block, 0) for r in ahead] == [sum(x["count"] for x in ahead[:i]) for i in range(len(ahead))]
    assert counts[1] == counts[10] <= 3 * m.select(*fitting.MATCH).distinct().count()
    assert fitting.fit_inputs(m, scored, RATES, chunks=1).where("weights is not null").isEmpty()


def test_states_carry_the_weights(season):
    m, scored = season
    rows = fitting.fit_inputs(m, scored, RATES, chunks=4).toPandas()
    matches = m.toPandas()
    for block in (1, 3):
        own = rows[(rows.block == block) & rows.weights.notna()]
        at = rows[(rows.block == block) & rows.weights.isna()]["kickoff"].dt.normalize().min()
        before = matches[matches.kickoff < at]
        for i, rate in enumerate(RATES):
            want = np.exp(-rate * (at - before.kickoff).dt.total_seconds() / 86400).groupby([before[c] for c in fitting.MATCH]).sum()
            later = np.exp(-rate * (at - own.kickoff).dt.total_seconds() / 86400)
            got = pd.Series(own.weights.str[i].to_numpy(float) * later.to_numpy(), index=pd.MultiIndex.from_frame(own[fitting.MATCH]))
            assert np.allclose(got.sort_index(), want.sort_index(), rtol=1e-9)


def test_cuts_and_candidates_do_not_show(season):
    m, scored = season
    keys = ["candidate", "kickoff", "home"]
    whole = fitting.walk_forward_many(m, scored, RATES, 50, chunks=1).toPandas().sort_values(keys)
    cut = fitting.walk_forward_many(m, scored, RATES, 50, chunks=5).toPandas().sort_values(keys)
    alone = fitting.walk_forward(m, scored, RATES[1], 50, days_per_block=4).toPandas().sort_values(keys[1:])
    assert len(whole) == len(cut) > 20 and set(whole.candidate) == {0, 1}
    assert np.allclose(whole.p_home, cut.p_home, atol=1e-7) and (whole.n_fit_matches.to_numpy() == cut.n_fit_matches.to_numpy()).all()
    assert np.allclose(whole[whole.candidate == 1].p_home, alone.p_home, atol=1e-7)


def test_failed_fits_are_told(season, monkeypatch):
    m, scored = season
    monkeypatch.setattr(fitting, "MAX_REFITS", 0)  # workers read the module anew, so this holds in the driver only
    window = fitting.FitWindow(np.array([0, 1]), np.array([1, 0]), np.array([1, 0]), np.array([0, 1]), np.ones(2))
    assert not fitting.fit_window(window)[2]
    rated = fitting.rated_fixtures(m, scored, RATES, 50).withColumn("lambda_home", F.when(F.col("candidate") == 1, F.col("lambda_home")))
    assert fitting.price_fixtures(rated).select("candidate").distinct().collect() == [(1,)]


def test_no_seasons_scored(season):
    m, scored = season
    assert fitting.walk_forward_many(m, scored.limit(0), RATES, 50).isEmpty()


def test_information_is_the_curvature():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 6, 800)
    a = (h + 1 + rng.integers(0, 5, 800)) % 6
    window = fitting.FitWindow(h, a, rng.poisson(1.4, 800), rng.poisson(1.1, 800), rng.random(800))
    start, step = window.start(), 1e-5
    slopes = [(window.objective(start + step * e)[1] - window.objective(start - step * e)[1]) / (2 * step) for e in np.eye(len(start))]
    got, want = window.information(start), np.array(slopes)
    assert np.abs(got - want)[:-1, :-1].max() < 0.02 * np.abs(want).max() and got[-1, -1] == pytest.approx(want[-1, -1], rel=1e-4)


def test_candidates_share_a_table(season):
    m, _ = season
    assert study.candidate_rates(m.where("season = '2223'"), (100.0, 400.0), 50).columns[-1] == "half_life_days"


def counted_fit(window):
    """fit_window's result and how often it asked for the objective."""
    own, calls = window.objective, []
    window.objective = lambda theta: (calls.append(1), own(theta))[1]
    return fitting.fit_window(window), len(calls)


def test_fits_of_many_matches_settle():
    """The slope to reach is the same however many matches there are; it once lay below what line searches could tell."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 20, 5000)
    rows = h, (h + 1 + rng.integers(0, 19, 5000)) % 20, rng.poisson(1.4, 5000), rng.poisson(1.1, 5000)
    (one, _, _), _ = counted_fit(fitting.FitWindow(*rows, np.ones(5000)))
    for times in (30.0, 3e3, 3e5):
        window = fitting.FitWindow(*rows, np.full(5000, times), n=np.full(5000, times))
        (theta, _, done), calls = counted_fit(window)
        assert done and calls < 40 and np.allclose(theta, one, atol=1e-6)
        assert window.n_matches == 5000 * times and np.abs(window.objective(theta)[1]).max() < fitting.GRADIENT


def test_a_fit_holds_a_row_for_each_pair():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 4, 3000)
    a, x, y, w = (h + 1 + rng.integers(0, 3, 3000)) % 4, rng.poisson(1.4, 3000), rng.poisson(1.1, 3000), rng.random(3000)
    window = fitting.FitWindow(h, a, x, y, w)
    assert len(window.w) == 12 and window.n_matches == 3000
    theta = window.start() + rng.normal(0, 0.05, 9)
    lam, mu = window_rates(theta, h, a)
    tau = np.select([(x == 0) & (y == 0), (x == 0) & (y == 1), (x == 1) & (y == 0), (x == 1) & (y == 1)], [1 - theta[-1] * lam * mu, 1 + theta[-1] * lam, 1 + theta[-1] * mu, 1 - theta[-1]], 1.0)
    assert window.objective(theta)[0] == pytest.approx(-(w * (x * np.log(lam) + y * np.log(mu) + np.log(tau) - lam - mu)).sum(), rel=1e-12)


def window_rates(theta, h, a):
    attack, defence = np.append(theta[:3], -theta[:3].sum()), theta[3:7]
    return np.exp(attack[h] + defence[a] + theta[-2]), np.exp(attack[a] + defence[h])

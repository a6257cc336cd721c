"""Registered bootstraps do the reference's number of resamples, in chunks that don't show."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmith.operators import bootstrap, cells
from oddsmith.plans import catalogue

SF = "/root/testdata/sf0.001"


def resamples(monkeypatch, spark, query, operator):
    """The n_resamples that a registered query runs with."""
    real, seen = getattr(bootstrap, operator), []

    def spy(*args, **options):
        bound = inspect.signature(real).bind(*args, **options)
        bound.apply_defaults()
        seen.append(bound.arguments["n_resamples"])
        return real(*args, **options)

    monkeypatch.setattr(bootstrap, operator, spy)
    catalogue.QUERIES[query](spark, SF)
    return seen


def test_cell_bootstrap_runs_2000(monkeypatch, spark):
    assert resamples(monkeypatch, spark, "stationary_bootstrap", "stationary_bootstrap") == [2000]


def test_stationary_chunks_do_not_show(monkeypatch):
    x = np.random.default_rng(0).normal(size=53)
    whole = bootstrap.stationary_interval(x, 3, 400)
    monkeypatch.setattr(bootstrap, "CHUNK", 500)
    assert bootstrap.stationary_interval(x, 3, 400) == whole
    rng = np.random.default_rng(3)
    starts, jumps = rng.integers(0, 53, size=(400, 53)), rng.random((400, 53)) < 1 / 20
    means = []
    for s, j in zip(starts, jumps):
        at = [s[0]]
        for k in range(1, 53):
            at.append(s[k] if j[k] else (at[-1] + 1) % 53)
        means.append(x[at].mean())
    assert whole[1:] == pytest.approx(np.quantile(means, [0.025, 0.975]))


@pytest.mark.parametrize("query, operator", [("bootstrap_correlation", "pair_bootstrap"), ("cluster_bootstrap_correlation", "cluster_bootstrap"), ("bootstrap_mean_difference", "mean_difference_bootstrap")])
def test_table_bootstraps_run_10_000(monkeypatch, spark, query, operator):
    assert resamples(monkeypatch, spark, query, operator) == [10_000]


def test_drawn_chunks_do_not_show(monkeypatch):
    monkeypatch.setattr(bootstrap, "CHUNK", 100)
    parts = np.concatenate(list(bootstrap._draws(5, 7, 200)))
    assert (parts == np.random.default_rng(5).choice(7, size=(200, 7), replace=True)).all()


def test_shares_of_one_series_do_not_show(monkeypatch, spark):
    """One group's resamples in one task and in many give the same ends, to the last digit of their sums."""
    rng = np.random.default_rng(2)
    rows = [(1, i, f"c{i % 7}", float(rng.normal()), float(rng.normal())) for i in range(90)] + [(None, 0, "c", 1.0, 2.0), (2, 0, "c", 3.0, 1.0), (2, 1, "d", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g int, i int, c string, x double, y double").withColumn("_other", F.lit(1))
    runs = [
        lambda: bootstrap.stationary_bootstrap(df, ["g"], ["i"], "x", 7, 300),
        lambda: bootstrap.pair_bootstrap(df, ["g"], ["i"], "x", "y", 7, 300),
        lambda: bootstrap.cluster_bootstrap(df, ["g"], ["i"], "x", "y", "c", 7, 300),
        lambda: bootstrap.mean_difference_bootstrap(df, ["g"], ["i"], "x", "y", 7, 300),
    ]
    alone = [sorted(map(str, r().collect())) for r in runs]
    assert all(len(a) == 3 for a in alone)
    x = np.array([r[3] for r in rows[:90]])
    first = next(r for r in runs[0]().collect() if r.g == 1)
    assert (first.point, first.low, first.high) == pytest.approx(bootstrap.stationary_interval(x, 7, 300), abs=1e-12)
    monkeypatch.setattr(bootstrap, "DRAWS", 2500)
    monkeypatch.setattr(bootstrap, "RANKING", (1, 0))
    assert [sorted(map(str, r().collect())) for r in runs] == alone
    assert runs[0]().limit(0).count() == 0 and bootstrap.pair_bootstrap(df.limit(0), ["g"], ["i"], "x", "y", 7).count() == 0


def test_rows_shipped_do_not_grow_with_the_square(monkeypatch, spark):
    """However many draws a series takes, its rows go to two tasks' worth of shares at most, and one pass tells where they begin."""
    passed = []
    real = bootstrap.stationary_starts
    monkeypatch.setattr(bootstrap, "stationary_starts", lambda n, firsts, *rest: (passed.append(n), real(n, firsts, *rest))[1])
    starts = bootstrap.stationary_starts(50, [0, 3, 7], 11, 10)
    x = np.random.default_rng(1).normal(size=50)
    whole = bootstrap.stationary_means(x, starts[0], 0, 10, 5.0)
    assert (np.concatenate([bootstrap.stationary_means(x, s, a, b, 5.0) for s, a, b in zip(starts, (0, 3, 7), (3, 7, 10))]) == whole).all() and passed == [50]
    monkeypatch.setattr(bootstrap, "DRAWS", 1)
    df = spark.createDataFrame([(i, float(i)) for i in range(40)], "i int, x double").withColumn("g", F.lit(1))
    shares = bootstrap.stationary_bootstrap(df, ["g"], ["i"], "x", 7, 300)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    plan = spark.read.parquet(next(f.split("/part-")[0] for f in shares.inputFiles() if "/shares-" in f))
    assert plan.first()["_parts"] == 2 * tasks


def test_pieces_of_a_resample_do_not_show(monkeypatch):
    """All places and jumps of a chunk were drawn at once, in arrays beyond the processor's cache; pieces end within resamples."""
    for n in (2, 3, 8, 53, 70_001):
        assert (bootstrap._places(np.random.default_rng(n), n, 999) == np.random.default_rng(n).integers(0, n, size=999)).all()
    x = np.random.default_rng(1).normal(size=53)
    sizes = []
    real = bootstrap._places
    monkeypatch.setattr(bootstrap, "_places", lambda rng, n, size: (sizes.append(size), real(rng, n, size))[1])
    starts = bootstrap.stationary_starts(53, [0, 3], 5, 9)
    whole = bootstrap.stationary_means(x, starts[0], 0, 9, 4.0)
    monkeypatch.setattr(bootstrap, "PIECE", 40)
    del sizes[:]
    assert bootstrap.stationary_starts(53, [0, 3], 5, 9) == starts
    assert (np.concatenate([bootstrap.stationary_means(x, s, a, b, 4.0) for s, a, b in zip(starts, (0, 3), (3, 9))]) == whole).all() and max(sizes) == 40
    rng = np.random.default_rng(5)
    to, jumps = rng.integers(0, 53, size=(9, 53)), rng.random((9, 53)) < 0.25
    for mean, s, j in zip(whole, to, jumps):
        at = [s[0]]
        for k in range(1, 53):
            at.append(s[k] if j[k] else (at[-1] + 1) % 53)
        assert mean == pytest.approx(x[at].mean())


def test_roi_intervals_make_no_test(monkeypatch, spark):
    """The test of every cell was made and dropped."""
    monkeypatch.setattr(cells, "diebold_mariano", None)
    t = catalogue.QUERIES["cell_roi_intervals"](spark, SF)
    assert t.columns == ["league", "book", "market", "method", "n_bets", "roi", "roi_low", "roi_high"]

import pytest

from oddsmith.operators import books, cells
from oddsmith.plans import catalogue, surrogate

SF = "/root/testdata/sf0.001"
NAMES = [
    "roi_histogram", "share_above_diagonal", "p3_sign_flips", "p1_by_book", "divergence_target", "per_cell_spread", "coverage_table",
    "bootstrap_mean_difference", "bootstrap_correlation", "cluster_bootstrap_correlation",
]


@pytest.mark.parametrize("name", NAMES)
def test_what_needs_no_test_makes_none(spark, monkeypatch, name):
    """Each of these made the test of every cell, and dropped it."""

    def fail(*_):
        raise AssertionError("the test was made")

    monkeypatch.setattr(cells, "diebold_mariano", fail)
    assert catalogue.QUERIES[name](spark, SF).columns


def test_means_are_those_of_the_results(spark):
    f, b = surrogate.forecasts(spark, SF), books.closing_books(surrogate.odds(spark, SF))
    means = cells.cell_means(cells.cell_rows(f, b))
    got, want = means.collect(), cells.cell_results(f, b).select(*means.columns).collect()
    key = lambda r: (r.league, r.book, r.market, r.method)
    assert len(got) == len(want)
    for x, y in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(x)[:5] == tuple(y)[:5] and x.n_bets == y.n_bets
        assert tuple(x)[5:7] == pytest.approx(tuple(y)[5:7], abs=1e-12) and x.roi == pytest.approx(y.roi, abs=1e-12)


def test_lines_and_orders_are_dealt_once(spark):
    """Lines were shuffled by line, by order, for the join and for the books."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = books.closing_books(surrogate.odds(spark, SF))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("Exchange ") == 2, plan

"""Pricing, margins, stakes and scores against published values and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from oddsmith.functions import margin, pricing, scoring, special, staking


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("rho", "p00", "p11", "draw"), [(-0.20, 0.09086, 0.14194, 0.29622), (-0.10, 0.07903, 0.13011, 0.27257), (0.0, 0.06721, 0.11828, 0.24891), (0.06, 0.06011, 0.11118, 0.23472)])
def test_scorelines(spark, rho, p00, p11, draw):
    g = pricing.scoreline_grid(F.lit(1.6), F.lit(1.1), F.lit(rho))
    row = one(spark, pricing.correct_score(g, 0, 0).alias("a"), pricing.correct_score(g, 1, 1).alias("b"), pricing.match_odds(g)["draw"].alias("c"), special.total(g).alias("t"))
    assert row.a == pytest.approx(p00, abs=5e-5) and row.b == pytest.approx(p11, abs=5e-5) and row.c == pytest.approx(draw, abs=5e-5) and row.t == pytest.approx(1)


def test_orientation(spark):
    g = pricing.scoreline_grid(F.lit(2.0), F.lit(0.7), F.lit(-0.1))
    row = one(spark, (pricing.correct_score(g, 0, 1) / pricing.correct_score(g, 0, 2)).alias("r"))
    assert row.r == pytest.approx((0.7 / (0.7**2 / 2)) * (1 - 0.1 * 2.0))


def test_difference_law_agrees_with_the_grid_only_without_correction(spark):
    s = pricing.skellam(F.lit(1.6), F.lit(1.1))
    for rho, close in ((0.0, True), (-0.1, False)):
        g = pricing.scoreline_grid(F.lit(1.6), F.lit(1.1), F.lit(rho))
        row = one(spark, pricing.asian_handicap(g, -0.75).alias("a"), pricing.skellam_handicap(s, -0.75).alias("b"))
        assert (abs(row.a.win - row.b.win) < 1e-5) is close


def test_handicap_lines(spark):
    g = pricing.scoreline_grid(F.lit(1.6), F.lit(1.1), F.lit(-0.1))
    row = one(spark, pricing.asian_handicap(g, 0.0).alias("level"), pricing.match_odds(g).alias("m"), pricing.asian_fair_odds(pricing.asian_handicap(g, 20.0)).alias("sure"))
    assert row.level.win == pytest.approx(row.m.home) and row.level.push == pytest.approx(row.m.draw) and row.sure == pytest.approx(1)
    for bad in (0.1, 0.3):
        with pytest.raises(ValueError):
            pricing.asian_handicap(g, bad)
    with pytest.raises(ValueError):
        pricing.over(g, 2.0)


def test_margin_methods(spark):
    random.seed(4)
    rows = []
    for _ in range(300):
        k = random.choice([2, 3, 4])
        q = [random.random() + 0.05 for _ in range(k)]
        m = 1.001 + random.random() * 0.199
        p = [x / sum(q) * m for x in q]
        if max(p) < 1:
            rows.append((p,))
    df = spark.createDataFrame(rows, "p array<double>")
    for r in df.select("p", *[margin.demargin(F.col("p"), m).alias(m) for m in margin.METHODS]).collect():
        order = sorted(range(len(r.p)), key=lambda i: r.p[i])
        for m in margin.METHODS:
            fair = r[m].probabilities
            assert sum(fair) == pytest.approx(1, abs=1e-12)
            assert sorted(range(len(fair)), key=lambda i: fair[i]) == order
            assert all(f <= x + 1e-12 for f, x in zip(fair, r.p))
        assert sum(x ** r.power.parameter for x in r.p) == pytest.approx(1, abs=1e-9)
        c = r.odds_ratio.parameter
        assert sum(x / (c * (1 - x) + x) for x in r.p) == pytest.approx(1, abs=1e-9)
        z, b = r.shin.parameter, sum(r.p)
        assert sum((math.sqrt(z * z + 4 * (1 - z) * x * x / b) - z) / (2 * (1 - z)) for x in r.p) == pytest.approx(1, abs=1e-9)


def test_shin_published_value_and_two_way_form(spark):
    row = one(spark, margin.demargin(F.array(F.lit(0.5), F.lit(0.35), F.lit(0.25)), "shin").alias("s"), margin.shin(F.array(F.lit(0.6), F.lit(0.47))).alias("t"), margin.shin_two_way(F.array(F.lit(0.6), F.lit(0.47))).alias("u"))
    assert row.s.probabilities == pytest.approx([0.46344, 0.31699, 0.21956], abs=5e-5) and row.s.parameter == pytest.approx(0.0502, abs=5e-5)
    assert row.t == pytest.approx(row.u, abs=1e-10)
    with pytest.raises(KeyError):
        margin.demargin(F.array(F.lit(0.5)), "other")


def test_fair_and_bad_books(spark):
    fair = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    row = one(spark, *[margin.demargin(fair, m).alias(m) for m in margin.METHODS])
    assert all(row[m].probabilities == pytest.approx([0.5, 0.3, 0.2]) for m in margin.METHODS)
    books = [([0.4, 0.4],), ([1.0, 0.2],), ([1.1],), ([0.6, None],), ([0.6, 0.5],)]
    assert [r.v for r in spark.createDataFrame(books, "p array<double>").select(margin.valid_book(F.col("p")).alias("v")).collect()] == [False, False, False, False, True]


def test_overround(spark):
    p = F.array(F.lit(0.46), F.lit(0.29), F.lit(0.25))
    row = one(spark, margin.apply_overround(p, F.lit(1.08)).alias("d"), margin.apply_overround(p, F.lit(3.5)).alias("none"), margin.overround_double_chance(F.array(F.lit(0.75), F.lit(0.71), F.lit(0.54)), F.lit(1.05)).alias("c"))
    assert sum(1 / d for d in row.d) == pytest.approx(1.08, abs=1e-9) and row.none is None and sum(1 / d for d in row.c) == pytest.approx(2.10, abs=1e-9)


def test_staking(spark):
    row = one(
        spark, staking.expected_value(F.lit(0.5), F.lit(2.2)).alias("ev"), staking.kelly(F.lit(0.5), F.lit(2.2)).alias("k"), staking.kelly(F.lit(0.3), F.lit(2.0)).alias("none"), staking.kelly(F.lit(0.3), F.lit(1.0)).alias("bad"),
        staking.closing_line_value(F.lit(2.1), F.lit(2.0)).alias("up"), staking.closing_line_value(F.lit(2.0), F.lit(2.1)).alias("down"),
    )
    assert row.ev == pytest.approx(0.1) and row.k == pytest.approx(0.25 * (1.2 * 0.5 - 0.5) / 1.2) and row.none == 0 and row.bad is None and row.up == pytest.approx(-row.down)
    bets = spark.createDataFrame([(0.5, 0.4, 2.2, True), (0.5, 0.4, 2.2, False), (0.3, 0.4, 2.0, True)], "m double, b double, d double, w boolean")
    s = bets.withColumn("s", staking.stake(F.col("m"), F.col("b"), F.col("d"))).withColumn("p", staking.profit(F.col("s"), F.col("d"), F.col("w")))
    assert s.agg(staking.roi(F.col("p"), F.col("s"))).first()[0] == pytest.approx(0.1)
    assert s.where("s = 0").agg(staking.roi(F.col("p"), F.col("s"))).first()[0] is None


def test_scores(spark):
    p = F.array(F.lit(0.7), F.lit(0.15), F.lit(0.15))
    row = one(
        spark, *[scoring.brier_score(p, F.lit(i)).alias(f"b{i}") for i in (1, 2)], *[scoring.ranked_probability_score(p, F.lit(i)).alias(f"r{i}") for i in (1, 2)],
        scoring.rps3(F.lit(0.7), F.lit(0.15), F.lit(0.15), F.lit(2)).alias("fast"), scoring.log_loss(F.array(F.lit(0.0), F.lit(1.0)), F.lit(0)).alias("floor"), scoring.valid_forecast(p, F.lit(3)).alias("bad"),
    )
    assert row.b1 == pytest.approx(row.b2) and row.r1 < row.r2 and row.fast == pytest.approx(row.r2) and row.floor == pytest.approx(-math.log(1e-15)) and row.bad is False


def test_normal_cdf(spark):
    xs = [-9.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 1.96, 4.0, 8.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(special.normal_cdf(F.col("x")).alias("c")).collect()
    assert [r.c for r in got] == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=1e-12)


def test_solvers_of_batches_agree_with_those_of_columns(spark):
    from oddsmith.operators import books

    rows = [(i, [p * t / sum(ps) for p in ps]) for i, (t, ps) in enumerate((t, ps) for t in (1.0, 1.0 + 1e-13, 1.02, 1.3) for ps in ((1, 1, 1), (8, 1, 0.2), (1, 3), (30, 1), (5, 2, 1, 1)))]
    df = spark.createDataFrame([(i, p) for i, p in rows if max(p) < 1] + [(99, None)], "i int, p array<double>")
    both = df.withColumn("d", F.explode(margin.demargin_all(F.col("p")))).select("i", "d.method", F.col("d.fair").alias("want"))
    found = margin.with_fair(df, "p").join(both, ["i", "method"])
    assert found.count() == 4 * df.count()
    off = F.exists(F.arrays_zip("fair", "want"), lambda z: F.abs(z["fair"] - z["want"]) > 1e-12)
    assert found.where("i < 99").where(off | (F.size("fair") != F.size("want"))).count() == 0
    # solvers no longer run inside the plan, row by row
    plan = margin.with_fair(df, "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_outcomes_without_a_grid(spark):
    df = spark.createDataFrame([(0.06, 5.9, 0.0), (1.4, 1.1, -0.1), (5.9, 5.9, 0.02), (2.0, 0.3, 0.2)], "l double, m double, r double")
    found = pricing.with_outcomes(df, "l", "m", "r").withColumn("g", pricing.scoreline_grid(F.col("l"), F.col("m"), F.col("r"))).withColumn("o", pricing.match_odds(F.col("g")))
    for r in found.select("p_home", "p_draw", "p_away", "p_over25", "o", pricing.over(F.col("g"), 2.5).alias("over")).collect():
        assert (r.p_home, r.p_draw, r.p_away, r.p_over25) == pytest.approx((r.o.home, r.o.draw, r.o.away, r.over), abs=1e-13)
    plan = pricing.with_outcomes(df, "l", "m", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_matches_of_one_file_go_to_all_tasks(spark):
    from oddsmith.plans import surrogate

    assert surrogate.matches(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

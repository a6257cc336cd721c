import math

import pytest
from pyspark.sql import functions as F

from oddsmith.functions import pricing

RATES = (0.05, 0.3, 1.4, 6.0, 40.0)


def test_against_the_sum_of_products(spark):
    """From rates of 0.05 to 40, every difference within the reach to 1e-12, and no distribution for a rate of 0."""
    pairs = [(a, b) for a in RATES for b in RATES]
    for r in spark.createDataFrame(pairs, "a double, b double").select("a", "b", pricing.skellam(F.col("a"), F.col("b")).alias("s")).collect():
        law = [[math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(400)] for x in (r.a, r.b)]
        for k in range(-60, 61):
            assert r.s[k + 60] == pytest.approx(math.fsum(law[0][j + k] * law[1][j] for j in range(max(0, -k), min(400, 400 - k))), abs=1e-12)
    assert spark.range(1).select(pricing.skellam(F.lit(0.0), F.lit(1.0)).alias("s")).first().s is None


def test_laws_are_made_of_distinct_pairs(spark):
    """No filter that the optimiser infers makes them of each match, below the distinct pairs."""
    from oddsmith.plans import catalogue

    plan = catalogue.skellam_pmf(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate ["):].split("+- ", 1)[1]
    assert "aggregate(" in plan and "aggregate(" not in below and "array_prepend" not in below

"""Scans over ordered groups: right for ties, nulls and one large group, which many tasks share."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsmith.operators import inference, ranged


def brute_variance(x, lag):
    c = np.array(x) - np.mean(x)
    n = len(c)
    return max(0.0, (c @ c + 2 * sum((1 - k / (lag + 1)) * (c[k:] @ c[:-k]) for k in range(1, lag + 1))) / n)


def default_lag(n):
    return max(0, min(n - 1, math.floor(4 * (n / 100) ** (2 / 9))))


@pytest.mark.parametrize("lag", [None, 0, 9, 10_000])
def test_long_run_variance_over_blocks(spark, monkeypatch, lag):
    """Blocks shorter and longer than the lag, series that end within one, ordered by two columns, with nulls between."""
    monkeypatch.setattr(inference, "BLOCK", 8)
    rng = random.Random(5)
    sizes = {"a": 400, "b": 8, "c": 17, None: 30, "two": 2, "one": 1}
    rows, want = [], {}
    for g, n in sizes.items():
        x = [rng.gauss(3, 1) for _ in range(n)]
        rows += [(g, i // 10, i % 10, v) for i, v in enumerate(x)] + [(g, 3, 20, None)]
        if n >= 2:
            own = default_lag(n) if lag is None else min(lag, n - 1)
            want[g] = (n, own, np.mean(x), brute_variance(x, own))
    rng.shuffle(rows)
    got = inference.newey_west(spark.createDataFrame(rows, "g string, s int, t int, v double"), ["g"], ["s", "t"], "v", lag).collect()
    assert {r.g for r in got} == set(want)
    for r in got:
        assert (r.n, r.lag) == want[r.g][:2] and (r["mean"], r.variance) == pytest.approx(want[r.g][2:], rel=1e-9)


def test_one_group_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("all").alias("g"), F.rand(3).alias("p"), (F.col("id") % 7).alias("x"), F.lit(0.5).alias("same"))
    for order in (["p"], ["same", F.xxhash64("p")]):
        parts = ranged.dealt(df, ["g"], order)
        counts = [r["count"] for r in parts.groupBy(ranged.PART).count().collect()]
        assert len(counts) == 4 and max(counts) < 10_000
        numbers = ranged.numbered(parts, ["g"], "i").orderBy("i").toPandas()
        assert numbers.i.tolist() == list(range(1, 20_001))
        assert order != ["p"] or numbers.p.is_monotonic_increasing
    assert inference.newey_west(df, ["g"], "p", "p").first().n == 20_000
    plan = inference.adjusted_p_values(df, "p", ["g"])._jdf.queryExecution().toString()
    assert f"{ranged.PART}" in plan


def test_step_up_against_brute_force(spark):
    rng = random.Random(8)
    data = {g: [round(rng.random() ** 3, 2) for _ in range(n)] for g, n in (("a", 300), ("b", 1), (None, 40))}
    rows = [(g, p, i) for g, ps in data.items() for i, p in enumerate(ps)] + [("a", None, 900), ("none", None, 901)]
    df = spark.createDataFrame(rows, "g string, p double, id int").repartition(3)
    q = {(r.g, r.id): r.q_value for r in inference.adjusted_p_values(df, "p", ["g"]).collect()}
    mask = {(r.g, r.id): r.rejected for r in inference.rejected(df, "p", 0.1, ["g"]).collect()}
    assert len(q) == len(mask) == len(rows) and q["a", 900] is None and mask["none", 901] is False
    for g, ps in data.items():
        order = np.argsort(ps, kind="stable")
        n, s = len(ps), np.sort(ps)
        want = np.minimum(1, np.minimum.accumulate((s * n / np.arange(1, n + 1))[::-1])[::-1])
        passing = np.flatnonzero(s <= 0.1 * np.arange(1, n + 1) / n)
        for k, i in enumerate(order):
            assert q[g, i] == pytest.approx(want[k]) and mask[g, i] == bool(len(passing) and s[k] <= s[passing[-1]])
    whole = inference.adjusted_p_values(df.drop("g"), "p").where("p is not null").toPandas()
    assert whole.columns.tolist() == ["p", "id", "q_value"] and len(whole) == 341


def test_rank_correlation_with_large_ties(spark):
    rng = random.Random(2)
    rows = [("a", rng.choice([1.0, 1.0, 1.0, rng.random()]), float(rng.randint(0, 5))) for _ in range(500)]
    rows += [("b", float(i), float(i * i)) for i in range(20)] + [("c", 1.0, float(i)) for i in range(5)] + [(None, float(i), -float(i)) for i in range(9)]
    df = spark.createDataFrame(rows + [("a", None, 1.0), ("b", 2.0, None)], "g string, x double, y double")
    got = {r.g: (r.n, r.rho) for r in inference.spearman(df, ["g"], "x", "y").collect()}
    table = pd.DataFrame(rows, columns=["g", "x", "y"])
    own = table[table.g == "a"]
    assert got["a"][0] == 500 and got["a"][1] == pytest.approx(own.x.rank().corr(own.y.rank()), abs=1e-12)
    assert got["b"] == (20, pytest.approx(1.0)) and got["c"] == (5, None) and got[None] == (9, pytest.approx(-1.0))
    assert inference.spearman(df.drop("g"), [], "x", "y").first().n == 534


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, p double, x double")
    assert inference.newey_west(none, ["g"], "p", "x").isEmpty() and inference.spearman(none, ["g"], "p", "x").isEmpty()
    assert inference.adjusted_p_values(none, "p", ["g"]).isEmpty() and inference.rejected(none, "p", 0.1).isEmpty()

"""Goal model: low-score-corrected Poisson scorelines and the markets that follow from them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .special import let, log_factorial, total

GOALS = 11  # fixed: 0 to 10 a side
DEFAULT_RHO = -0.10


def poisson_pmf(k: Column, rate: Column) -> Column:
    """P(k) in log space; null where the rate isn't positive or k is negative."""
    return F.when((rate > 0) & (k >= 0), F.exp(k * F.log(rate) - rate - log_factorial(k)))


def rho_low(home: Column, away: Column) -> Column:
    return F.greatest(-1 / home, -1 / away)


def rho_high(home: Column, away: Column) -> Column:
    return F.least(1 / (home * away), F.lit(1.0))


def rho_admissible(home: Column, away: Column, rho: Column) -> Column:
    """Both ends belong to the interval."""
    return (rho >= rho_low(home, away)) & (rho <= rho_high(home, away))


def low_score_factor(x: Column, y: Column, home: Column, away: Column, rho: Column) -> Column:
    """The correction of the four lowest scorelines. One goal for the away side goes with the home rate."""
    return (
        F.when((x == 0) & (y == 0), 1 - home * away * rho)
        .when((x == 0) & (y == 1), 1 + home * rho)
        .when((x == 1) & (y == 0), 1 + away * rho)
        .when((x == 1) & (y == 1), 1 - rho)
        .otherwise(F.lit(1.0))
    )


def scoreline_grid(home: Column, away: Column, rho: Column) -> Column:
    """121 probabilities, home goals by row, summing to 1."""
    side = lambda rate: F.transform(F.sequence(F.lit(0), F.lit(GOALS - 1)), lambda k: F.exp(k * F.log(rate) - rate - F.log(F.factorial(k).cast("double"))))

    def cells(s: Column) -> Column:
        def cell(i: Column) -> Column:
            x, y = F.floor(i / GOALS).cast("int"), i % GOALS
            return F.get(s["h"], x) * F.get(s["a"], y) * low_score_factor(x, y, s["home"], s["away"], s["rho"])

        return F.transform(F.sequence(F.lit(0), F.lit(GOALS * GOALS - 1)), cell)

    raw = let(F.struct(side(home).alias("h"), side(away).alias("a"), home.alias("home"), away.alias("away"), rho.alias("rho")), cells)
    return let(raw, lambda g: let(F.struct(g.alias("g"), total(g).alias("t")), lambda s: F.transform(s["g"], lambda p: p / s["t"])))


def grid_sum(grid: Column, condition) -> Column:
    """Probability of the scorelines for which condition(home goals, away goals) holds."""
    return total(F.transform(grid, lambda p, i: F.when(condition(F.floor(i / GOALS).cast("int"), i % GOALS), p).otherwise(0.0)))


def match_odds(grid: Column) -> Column:
    """struct(home, draw, away)."""
    return F.struct(
        grid_sum(grid, lambda x, y: x > y).alias("home"), grid_sum(grid, lambda x, y: x == y).alias("draw"), grid_sum(grid, lambda x, y: x < y).alias("away")
    )


def with_outcomes(df: DataFrame, home: str, away: str, rho: str) -> DataFrame:
    """Add p_home, p_draw, p_away and p_over25, what match_odds and over give of the grid of these columns of rates.

    The cells are products of two sides' laws but for the four lowest, so sums by side give them without a grid; plain
    arithmetic, which is compiled, where a function over each cell of an array is interpreted.
    """
    lam, mu, r = F.col(home), F.col(away), F.col(rho)
    side = lambda rate: F.array(*[F.exp(k * F.log(rate) - rate - math.log(math.factorial(k))) for k in range(GOALS)])
    out = df.withColumns({"_h": side(lam), "_a": side(mu)})
    h, a = ([F.get(c, F.lit(k)) for k in range(GOALS)] for c in ("_h", "_a"))
    added = lambda terms: reduce(lambda x, y: x + y, terms)
    low = {(x, y): low_score_factor(F.lit(x), F.lit(y), lam, mu, r) * h[x] * a[y] for x in (0, 1) for y in (0, 1)}
    cell = lambda x, y: low.get((x, y), h[x] * a[y])
    # the away side's law summed below each score, and the home side's
    out = out.withColumn("_s", F.struct(
        added([cell(1, 0), *[h[x] * added(a[:x]) for x in range(2, GOALS)]]).alias("home"), added([cell(k, k) for k in range(GOALS)]).alias("draw"),
        added([cell(0, 1), *[a[y] * added(h[:y]) for y in range(2, GOALS)]]).alias("away"), added([cell(x, y) for x in range(3) for y in range(3 - x)]).alias("under")))
    t = F.col("_s.home") + F.col("_s.draw") + F.col("_s.away")
    out = out.withColumns({"p_home": F.col("_s.home") / t, "p_draw": F.col("_s.draw") / t, "p_away": F.col("_s.away") / t, "p_over25": (t - F.col("_s.under")) / t})
    return out.drop("_h", "_a", "_s")


def over(grid: Column, line: float) -> Column:
    """Probability of more goals than a half line; the under side is what is left to 1."""
    if line != line // 1 + 0.5:
        raise ValueError("a half line is needed, such as 2.5")
    return grid_sum(grid, lambda x, y: (x + y) > line)


def both_score(grid: Column) -> Column:
    return grid_sum(grid, lambda x, y: (x > 0) & (y > 0))


def correct_score(grid: Column, x: int, y: int) -> Column:
    if not (0 <= x < GOALS and 0 <= y < GOALS):
        raise ValueError("score outside the grid")
    return F.get(grid, F.lit(x * GOALS + y))


def double_chance(grid: Column) -> Column:
    """struct(home_or_draw, home_or_away, draw_or_away), which sum to 2."""
    return let(match_odds(grid), lambda m: F.struct((m["home"] + m["draw"]).alias("home_or_draw"), (m["home"] + m["away"]).alias("home_or_away"), (m["draw"] + m["away"]).alias("draw_or_away")))


def _lines(handicap: float) -> list[float]:
    if (4 * handicap) % 1:
        raise ValueError("a handicap is a multiple of 0.25")
    return [handicap] if (2 * handicap) % 1 == 0 else [handicap - 0.25, handicap + 0.25]


def _settled(measure, handicap: float) -> Column:
    """struct(win, push, lose) of the home side; quarter lines are the mean of their neighbours."""
    lines = _lines(handicap)
    mean = lambda f: sum((f(h) for h in lines[1:]), f(lines[0])) / len(lines)
    return F.struct(
        mean(lambda h: measure(lambda d: d + h > 0)).alias("win"), mean(lambda h: measure(lambda d: d + h == 0)).alias("push"), mean(lambda h: measure(lambda d: d + h < 0)).alias("lose")
    )


def asian_handicap(grid: Column, handicap: float) -> Column:
    """struct(win, push, lose) of a bet on the home side; the away side's is its mirror."""
    return _settled(lambda condition: grid_sum(grid, lambda x, y: condition(x - y)), handicap)


def asian_fair_odds(outcome: Column) -> Column:
    """Null where the bet can't win."""
    return F.when(outcome["win"] > 0, 1 + outcome["lose"] / outcome["win"])


def skellam(home: Column, away: Column, reach: int = 60) -> Column:
    """Distribution of the goal difference on -reach to reach, by scaled Bessel functions of 2 * sqrt(home * away).

    Ratios of neighbouring functions come from the backward recurrence, 60 places beyond the reach, where what it starts from no
    longer shows; their running products are the functions but for a factor, as all of them, both ways, add up to 1.
    """

    def laws(s: Column) -> Column:
        ratio = lambda a, k: F.array_prepend(a, 1 / (2 * k / s["x"] + F.coalesce(F.get(a, F.lit(0)), F.lit(0.0))))
        ratios = F.aggregate(F.sequence(F.lit(reach + 60), F.lit(1), F.lit(-1)), F.array().cast("array<double>"), ratio)
        products = F.aggregate(ratios, F.array(F.lit(1.0)), lambda a, r: F.array_append(a, F.element_at(a, -1) * r))
        return let(F.struct(products.alias("t"), s["tilt"].alias("tilt"), s["scale"].alias("scale")), lambda q: let(
            F.struct(q["t"].alias("t"), q["tilt"].alias("tilt"), (q["scale"] / (2 * total(q["t"]) - 1)).alias("first")), differences))

    def differences(q: Column) -> Column:
        return F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: q["first"] * F.pow(q["tilt"], k) * F.get(q["t"], F.abs(k)))

    roots = F.sqrt(home), F.sqrt(away)
    own = F.struct((2 * roots[0] * roots[1]).alias("x"), (roots[0] / roots[1]).alias("tilt"), F.exp(-F.pow(roots[0] - roots[1], 2)).alias("scale"))
    return F.when((home > 0) & (away > 0), let(own, laws))


def skellam_handicap(difference: Column, handicap: float, reach: int = 60) -> Column:
    """struct(win, push, lose) of the home side from a goal-difference distribution."""
    measure = lambda condition: total(F.transform(difference, lambda p, i: F.when(condition(i - reach), p).otherwise(0.0)))
    return _settled(measure, handicap)

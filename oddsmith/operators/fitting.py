"""Fitting team strengths and the walk-forward protocol. The optimiser is NumPy inside a grouped pandas function."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import guards
from .protocol import price_fixtures

RHO_BOX = (-0.20, 0.20)
MAX_REFITS = 4
MIN_TEAM_WEIGHT = 1.0
PENALTY = 1e12
ROUNDING = 64 * np.finfo(float).eps  # of a likelihood, by its size
GRADIENT = 1e-5  # the largest slope at which a fit has settled; curvatures are in the tens


SUMS = 7  # of a pair's matches: weights, weighted goals of either side, and the weights of 0:0, 0:1, 1:0 and 1:1


def pair_sums(pairs: np.ndarray, n_pairs: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """SUMS rows of n_pairs sums, all that the likelihood needs of any number of matches; pairs: each match's place."""
    features = [w, w * x, w * y, *[w * ((x == i) & (y == j)) for i in (0, 1) for j in (0, 1)]]
    return np.stack([np.bincount(pairs, f, n_pairs) for f in features])


class FitWindow:
    """What one fit needs of its matches: a row for each pair of teams, see pair_sums, and indices into the sorted team names.

    A pair's matches share their rates, so a fit takes as long for many of them as for one.
    """

    def __init__(self, home, away, hg, ag, w, minimum: float = MIN_TEAM_WEIGHT, n=None):
        """n: how many matches each row stands for, by default one; w is then the sum of their weights."""
        names, places = np.unique(np.concatenate([home, away]), return_inverse=True)
        found, pairs = np.unique(places[: len(home)] * len(names) + places[len(home) :], return_inverse=True)
        x, y, n = hg.astype(float), ag.astype(float), np.ones(len(w)) if n is None else n
        self._keep(names[found // max(1, len(names))], names[found % max(1, len(names))], pair_sums(pairs, len(found), x, y, w), pair_sums(pairs, len(found), x, y, n), minimum)

    @classmethod
    def of_pairs(cls, home: np.ndarray, away: np.ndarray, sums: np.ndarray, counts: np.ndarray, minimum: float = MIN_TEAM_WEIGHT) -> FitWindow:
        """From distinct pairs with their sums; counts are the same sums with weights of 1."""
        out = cls.__new__(cls)
        out._keep(home, away, sums, counts, minimum)
        return out

    def _keep(self, home, away, sums, counts, minimum: float) -> None:
        there = counts[0] > 0
        home, away, sums, counts = home[there], away[there], sums[:, there], counts[:, there]
        names, places = np.unique(np.concatenate([home, away]), return_inverse=True)
        h, a = places[: len(home)], places[len(home) :]
        carried = np.bincount(np.concatenate([h, a]), np.concatenate([sums[0], sums[0]]), len(names))
        strong = carried >= minimum
        use = strong[h] & strong[a]
        if not use.any():
            raise ValueError("no matches between teams of enough weight")
        self.teams, places = np.unique(np.concatenate([home[use], away[use]]), return_inverse=True)
        self.h, self.a = places[: use.sum()], places[use.sum() :]
        (self.w, self.x, self.y), self.low = sums[:3, use], sums[3:, use]
        self.n_matches, self.seen = int(round(counts[0, use].sum())), counts[3:, use] > 0
        self.n = len(self.teams)
        # the strengths that each rate is made of: attacks first, then defences
        self.strengths = np.concatenate([self.h, self.n + self.a, self.a, self.n + self.h])

    def start(self) -> np.ndarray:
        theta = np.zeros(2 * self.n + 1)
        theta[-2:] = np.log(1.35), -0.10
        return theta

    def rates(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        attack = np.append(theta[: self.n - 1], -theta[: self.n - 1].sum())
        defence = theta[self.n - 1 : 2 * self.n - 1]
        return np.exp(attack[self.h] + defence[self.a] + theta[-2]), np.exp(attack[self.a] + defence[self.h])

    def _terms(self, lam: np.ndarray, mu: np.ndarray) -> np.ndarray:
        """A low score's correction is 1 + rho * term; where a pair has no such score its term is 0."""
        return np.where(self.seen, np.stack([-lam * mu, lam, mu, -np.ones_like(lam)]), 0.0)

    def objective(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative weighted log-likelihood without factorials, and its gradient; outside the domain the penalty and zeros.

        All derivatives are by the logarithms of the rates, in which strengths are sums.
        """
        with np.errstate(over="ignore", invalid="ignore"):
            lam, mu = self.rates(theta)
            term = self._terms(lam, mu)
            factor = 1 + theta[-1] * term
        if not (np.isfinite(lam + mu).all() and (factor > 0).all()):
            return PENALTY, np.zeros_like(theta)
        share = self.low * term / factor
        gain = self.x @ np.log(lam) + self.y @ np.log(mu) - self.w @ (lam + mu) + (self.low * np.log(factor)).sum()
        by_home = self.x - self.w * lam + theta[-1] * (share[0] + share[1])
        by_away = self.y - self.w * mu + theta[-1] * (share[0] + share[2])
        total = np.bincount(self.strengths, np.concatenate([by_home, by_home, by_away, by_away]), 2 * self.n)
        last = self.n - 1  # the last attack is minus the sum of the others
        slope = np.concatenate([total[:last] - total[last], total[self.n :], [by_home.sum(), share.sum()]])
        return -float(gain), -slope

    def information(self, theta: np.ndarray) -> np.ndarray:
        """The curvature that is expected at theta, with the correction of low scores in that of rho alone."""
        n, (lam, mu) = self.n, self.rates(theta)
        scored = np.bincount(np.concatenate([self.h * n + self.a, self.a * n + self.h]), np.concatenate([self.w * lam, self.w * mu]), n * n).reshape(n, n)
        at_home = np.bincount(self.h * n + self.a, self.w * lam, n * n).reshape(n, n)
        whole = np.zeros((2 * n + 2, 2 * n + 2))  # attacks, defences, home factor, rho
        whole[:n, :n], whole[n : 2 * n, n : 2 * n] = np.diag(scored.sum(1)), np.diag(scored.sum(0))
        whole[:n, n : 2 * n], whole[:n, -2], whole[n : 2 * n, -2] = scored, at_home.sum(1), at_home.sum(0)
        whole = np.maximum(whole, whole.T)
        term = self._terms(lam, mu)
        whole[-2, -2], whole[-1, -1] = at_home.sum(), (self.low * (term / (1 + theta[-1] * term)) ** 2).sum()
        kept = np.delete(whole, n - 1, axis=1)  # the last attack is minus the sum of the others
        kept[:, : n - 1] -= whole[:, [n - 1]]
        out = np.delete(kept, n - 1, axis=0)
        out[: n - 1] -= kept[n - 1]
        return out

    def violation(self, theta: np.ndarray) -> float:
        lam, mu = self.rates(theta)
        rho = theta[-1]
        return float(max(0.0, (np.maximum(-1 / lam, -1 / mu) - rho).max(), (rho - np.minimum(1 / (lam * mu), 1.0)).max()))


def minimise(objective, start: np.ndarray, low: float, high: float, rounds: int = 500, curvature: np.ndarray | None = None) -> tuple[np.ndarray, float, bool]:
    """Quasi-Newton descent with the last parameter held to [low, high]; (point, value, converged). curvature: a first guess of it."""
    x = start.copy()
    x[-1] = min(max(x[-1], low), high)
    f, g = objective(x)
    fresh = curvature is None
    inverse = np.eye(len(x)) if fresh else np.linalg.inv(curvature + 1e-6 * np.trace(curvature) / len(x) * np.eye(len(x)))
    for _ in range(rounds):
        free = np.ones(len(x), bool)
        free[-1] = not ((x[-1] <= low and g[-1] > 0) or (x[-1] >= high and g[-1] < 0))
        size = np.abs(g[free]).max(initial=0.0)
        if size < GRADIENT:
            return x, f, True
        step = -(inverse[np.ix_(free, free)] @ g[free])
        if step @ g[free] >= 0:
            inverse, step, fresh = np.eye(len(x)), -g[free], True
        if fresh:
            step /= max(1.0, np.abs(step).max() / 0.1)
        slope, t = float(step @ g[free]), 1.0
        for _ in range(40):
            y = x.copy()
            y[free] += t * step
            y[-1] = min(max(y[-1], low), high)
            f2, g2 = objective(y)
            # near the minimum of many matches a gain is less than the rounding of f; there the slope along the step decides
            if f2 <= f + 1e-4 * t * slope or (f2 <= f + ROUNDING * abs(f) and abs(g2[free] @ step) <= 0.9 * abs(slope)):
                break
            t *= 0.5
        else:
            if fresh:
                return x, f, size < 100 * GRADIENT
            inverse, fresh = np.eye(len(x)), True
            continue
        s, d = y - x, g2 - g
        sd = float(s @ d)
        if sd > 1e-12:
            if fresh:
                inverse *= sd / float(d @ d)
            hd = inverse @ d
            inverse += np.outer(s, s) * ((sd + d @ hd) / sd**2) - (np.outer(hd, s) + np.outer(s, hd)) / sd
            fresh = False
        x, f, g = y, f2, g2
    return x, f, False


def fit_window(window: FitWindow, box: tuple[float, float] = RHO_BOX) -> tuple[np.ndarray, float, bool]:
    """Fit from the fixed start; where rho leaves what some match admits, the box is halved and the fit starts anew."""
    low, high = box
    theta, value, done = window.start(), PENALTY, False
    for _ in range(MAX_REFITS):
        theta, value, done = minimise(window.objective, window.start(), low, high, curvature=window.information(window.start()))
        if window.violation(theta) <= 0:
            return theta, value, done
        low, high = low / 2, high / 2
    return theta, value, False


def _strengths(window: FitWindow, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = window.n
    return np.exp(np.append(theta[: n - 1], -theta[: n - 1].sum())), np.exp(theta[n - 1 : 2 * n - 1])


MATCH = ["league", "home", "away", "home_goals", "away_goals"]


def _age(later: Column, earlier: Column) -> Column:
    """Days between two times."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86_400e6)


def _weight(rate: float, age: Column) -> Column:
    """The sum of weights of that age, in decimals: its order doesn't show."""
    return F.sum(F.exp(-rate * age).cast("decimal(34,24)")).cast("double")


_FIT = "league string, team string, attack double, defence double, gamma double, rho double, log_likelihood double, n_matches long, converged boolean"


def fit_strengths(matches: DataFrame, as_of: str | None = None, rate: float = 0.0, minimum: float = MIN_TEAM_WEIGHT, strict: bool | None = None, seen: Observation | None = None) -> DataFrame:
    """One fit for each league, a row per team. With a rate, matches from as_of on are left out and older ones weigh less.

    strict: whether a match that can't be fitted, one from as_of on among them, fails the job or is left out and counted in seen;
    by default only the latter are left out.
    """
    if rate > 0 and as_of is None:
        raise ValueError("as_of is needed with a decay rate")
    end = pd.Timestamp(as_of) if as_of else None
    if strict is not None:
        matches = guards.checked(matches, guards.match_checks(F.to_timestamp_ntz(F.lit(str(end))) if as_of else None), strict, seen)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(MATCH, kind="stable")
        columns = [c.split()[0] for c in _FIT.split(", ")]
        try:
            window = FitWindow(df["home"].to_numpy(str), df["away"].to_numpy(str), df["home_goals"].to_numpy(), df["away_goals"].to_numpy(), df["w"].to_numpy(float), minimum, df["n"].to_numpy(float))
        except ValueError:
            return pd.DataFrame(columns=columns)
        theta, value, done = fit_window(window)
        attack, defence = _strengths(window, theta)
        return pd.DataFrame({"league": df["league"].iloc[0], "team": window.teams, "attack": attack, "defence": defence, "gamma": np.exp(theta[-2]), "rho": theta[-1], "log_likelihood": -value, "n_matches": window.n_matches, "converged": done})[columns]

    own = matches.where(F.col("kickoff") < F.to_timestamp_ntz(F.lit(str(end)))) if end is not None else matches
    weight = _weight(rate, _age(F.to_timestamp_ntz(F.lit(str(end))), F.col("kickoff"))) if rate > 0 else F.count(F.lit(1)).cast("double")
    return own.groupBy(*MATCH).agg(F.count(F.lit(1)).alias("n"), weight.alias("w")).groupBy("league").applyInPandas(run, _FIT)




def fit_inputs(matches: DataFrame, scored: DataFrame, rates: Sequence[float], chunks: int = 16, days_per_block: int | None = None) -> DataFrame:
    """The rows that walk-forward fits need, by (league, block): every match once, and what went before the block as states.

    A league's match days are cut into `chunks` blocks of as many scored days (or of days_per_block). A block has its own
    matches, in which n is 1 and weights are null, and for each pair of teams and score of earlier blocks one state: their
    number n and, for each rate, their weights' sum at the time `at`. A weight falls by the same factor for all matches
    from then on, so a state stands for any number of them. Rows are thus the matches and at most `chunks` times the
    different results, whatever the number of rates and days. Sums are in decimals: their order doesn't show.
    """
    day, w = F.date_trunc("day", "kickoff"), Window.partitionBy("league").orderBy("day")
    own = matches.join(scored.select("league", "season").distinct().withColumn("target", F.lit(True)), ["league", "season"], "left")
    own = own.withColumns({"day": day, "target": F.coalesce("target", F.lit(False))})
    days = own.groupBy("league", "day").agg(F.max("target").alias("scored"))
    before = F.coalesce(F.count_if("scored").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("league", "day", before.alias("before"), F.count_if("scored").over(Window.partitionBy("league")).alias("n"))
    size = F.lit(days_per_block) if days_per_block else F.greatest(F.lit(1), F.ceil(F.col("n") / chunks))
    days = days.where("before < n").select("league", "day", F.floor(F.col("before") / size).cast("int").alias("block"))
    blocks = days.groupBy("league", "block").agg(F.min("day").alias("first"))
    blocks = blocks.withColumn("at", F.lead("first").over(Window.partitionBy("league").orderBy("block"))).withColumn("last", F.max("block").over(Window.partitionBy("league")))
    rows = own.join(days, ["league", "day"])

    ended = rows.join(blocks.where("at is not null"), ["league", "block"]).withColumn("age", _age(F.col("at"), F.col("kickoff")))
    sums = [_weight(rate, F.col("age")).alias(f"w{i}") for i, rate in enumerate(rates)]
    cells = ended.groupBy(*MATCH, "block", "at", "last").agg(F.count(F.lit(1)).alias("n"), *sums)
    since = _age(F.col("at"), F.to_timestamp_ntz(F.lit("1970-01-01")))
    cells = cells.select(*MATCH, "block", "at", "last", F.struct(since.alias("t"), "n", F.array(*[f"w{i}" for i in range(len(rates))]).alias("w")).alias("own"))
    same = Window.partitionBy(*MATCH).orderBy("block")
    states = cells.withColumn("all", F.collect_list("own").over(same.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("block").over(same))

    def carried(i: int, rate: float) -> Column:
        return F.aggregate("all", F.lit(0.0), lambda s, x: s + x["w"][i] * F.exp(-rate * (F.col("own.t") - x["t"])))

    until = F.coalesce("next", "last")
    states = states.select(*MATCH, "at", F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n"), F.array(*[carried(i, rate) for i, rate in enumerate(rates)]).alias("weights"), F.explode(F.sequence(F.col("block") + 1, until)).alias("block"))
    extra = ["seq"] if "seq" in matches.columns else []
    none = {"season": F.lit(None).cast("string"), "target": F.lit(False), **{c: F.lit(None).cast("long") for c in extra}}
    names = [*MATCH, "block", "season", "kickoff", "n", "weights", "target", *extra]
    raw = rows.withColumns({"n": F.lit(1).cast("long"), "weights": F.lit(None).cast("array<double>")}).select(*names)
    return raw.unionByName(states.withColumnRenamed("at", "kickoff").withColumns(none).select(*names))


def rated_fixtures(matches: DataFrame, scored: DataFrame, rates: Sequence[float], min_fit_matches: int = 300, chunks: int = 16, days_per_block: int | None = None) -> DataFrame:
    """Scoring rates of the matches of scored (league, season) for each decay rate (candidate: its place), each from a fit on
    strictly earlier days of its league.

    A unit of work is a block of a league's match days, see fit_inputs; it fits all rates in one pass over its days. Every fit
    starts from the same point, so blocks don't change results. A team without a strength leaves the match out; a failed
    fit gives it null rates. n_fit_matches counts the history before weak teams go.
    """
    extra = [c for c in ("seq",) if c in matches.columns]
    names = ["league", "season", "kickoff", "home", "away", "home_goals", "away_goals", *extra]
    schema = "league string, season string, kickoff timestamp_ntz, home string, away string, home_goals long, away_goals long, " + "".join(f"{c} long, " for c in extra)
    schema += "candidate int, lambda_home double, lambda_away double, rho double, n_fit_matches long"
    rates = [float(r) for r in rates]

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.assign(raw=df["weights"].isna()).sort_values(["raw", "kickoff", "home", "away", "home_goals", "away_goals"], kind="stable").reset_index(drop=True)
        kick, n_states = df["kickoff"].to_numpy("datetime64[us]"), int((~df["raw"]).sum())
        carried = np.ones((len(df), len(rates)))
        if n_states:
            carried[:n_states] = np.stack(df["weights"].iloc[:n_states].to_list())
        teams, codes = np.unique(np.concatenate([df["home"].to_numpy(str), df["away"].to_numpy(str)]), return_inverse=True)
        home, away = codes[: len(df)], codes[len(df) :]
        found, pairs = np.unique(home * len(teams) + away, return_inverse=True)
        x, y, n_each = df["home_goals"].to_numpy(float), df["away_goals"].to_numpy(float), df["n"].to_numpy(float)
        held = np.cumsum(df["n"].to_numpy())
        # each pair's sums up to the last fitted day, for each rate; a match is added once and then falls with the others
        sums, counts, upto, at = np.zeros((len(rates), SUMS, len(found))), np.zeros((SUMS, len(found))), 0, None
        out = []
        targets = np.flatnonzero(df["target"].to_numpy(bool))
        days = kick[targets].astype("datetime64[D]")
        for start in np.unique(days):
            start, rows = start.astype("datetime64[us]"), targets[days == start]
            k = n_states + int(np.searchsorted(kick[n_states:], start, "left"))
            n = int(held[k - 1]) if k else 0
            if n < min_fit_matches:
                continue
            new = slice(upto, k)
            age = (start - kick[new]).astype(np.int64) / 86_400e6
            passed = 0.0 if at is None else (start - at).astype(np.int64) / 86_400e6
            counts += pair_sums(pairs[new], len(found), x[new], y[new], n_each[new])
            upto, at = k, start
            for c, rate in enumerate(rates):
                sums[c] *= np.exp(-rate * passed)
                sums[c] += pair_sums(pairs[new], len(found), x[new], y[new], carried[new, c] * np.exp(-rate * age))
                try:
                    window = FitWindow.of_pairs(found // len(teams), found % len(teams), sums[c], counts)
                except ValueError:
                    continue
                theta, _, done = fit_window(window)
                attack, defence = _strengths(window, theta if done else np.full_like(theta, np.nan))
                factor, rho = (np.exp(theta[-2]), theta[-1]) if done else (np.nan, np.nan)
                own = np.full(len(teams), -1)
                own[window.teams] = np.arange(window.n)
                h, a = own[home[rows]], own[away[rows]]
                ok = (h >= 0) & (a >= 0)
                h, a = h[ok], a[ok]
                out.append((rows[ok], np.full(len(h), c), attack[h] * defence[a] * factor, attack[a] * defence[h], np.full(len(h), rho), np.full(len(h), n)))
        columns = ["candidate", "lambda_home", "lambda_away", "rho", "n_fit_matches"]
        if not out:
            return pd.DataFrame(columns=[*names, *columns])
        rows, *values = (np.concatenate(v) for v in zip(*out))
        return df[names].take(rows).reset_index(drop=True).assign(**dict(zip(columns, values)))

    # few bytes but long fits: partitions of a stated number aren't put together
    spark = matches.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return fit_inputs(matches, scored, rates, chunks, days_per_block).repartition(tasks, "league", "block").groupBy("league", "block").applyInPandas(run, schema)


def walk_forward_many(matches: DataFrame, scored: DataFrame, rates: Sequence[float], min_fit_matches: int = 300, chunks: int = 16, days_per_block: int | None = None) -> DataFrame:
    """Forecasts of rated_fixtures; a failed fit or a rate outside the bounds leaves the match out."""
    return price_fixtures(rated_fixtures(matches, scored, rates, min_fit_matches, chunks, days_per_block))


def walk_forward(matches: DataFrame, scored: DataFrame, rate: float, min_fit_matches: int = 300, days_per_block: int | None = None, chunks: int = 16) -> DataFrame:
    """walk_forward_many of one rate."""
    return walk_forward_many(matches, scored, [rate], min_fit_matches, chunks, days_per_block).drop("candidate")

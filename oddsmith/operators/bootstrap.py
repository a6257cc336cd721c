"""Resampling intervals. Each group is one series. Its resamples are dealt to tasks, more of them the longer the series is; a
task holds one series, and draws what a single seeded generator would have drawn for its share, so the shares don't show."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

SHARE = "point double, found array<double>, n long"
CHUNK = 1 << 20  # values drawn at a time, which bounds memory
PIECE = 1 << 16  # values of them that are drawn and thinned at a time, few enough for the processor's cache
DRAWS = 1 << 27  # draws of a task; a series that needs more is shared
RANKING = 20, 40_000  # what a row, and a resample beside its rows, take where values are ranked, counted in draws


def _quantile(values: Column, q: float) -> Column:
    """Quantile of a sorted array, between the two values next to its place; null if there is none."""
    place = (F.size(values) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    return F.get(values, low) + (F.coalesce(F.get(values, low + 1), F.get(values, low)) - F.get(values, low)) * (place - low)


#: What a share gives: the point (null if undefined) and the finite statistics of resamples first to last - 1. Its last
#: argument is what the group's pass found for it, null where there is none.
Share = Callable[[pd.DataFrame, int, int, str | None], tuple[float | None, np.ndarray]]
#: One pass over the numbers of a series of n rows: for each share's first resample, where its numbers begin.
Pass = Callable[[int, list[int]], list[str]]


def _firsts(parts: int, n_resamples: int) -> list[int]:
    return [part * n_resamples // parts for part in range(parts)]


def _intervals(df: DataFrame, by: list[str], order: list[str], share: Share, n_resamples: int, level: float, cost: tuple[int, int] = (1, 0), passes: Pass | None = None) -> DataFrame:
    """by, point, low, high, n: the resamples of each group in shares of at most DRAWS draws, and their percentiles.

    A share ships its series, so there are no more of them than two a task, dealt by size: rows shipped don't grow with the
    square of a series.
    """
    rows = written(df, "series")
    spark = df.sparkSession
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    draws = (F.col("_n") * cost[0] + cost[1]) * F.lit(float(n_resamples))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_draws", draws)
    sizes = sizes.crossJoin(sizes.agg(F.sum("_draws").alias("_all")))
    parts = F.least(F.lit(n_resamples), F.ceil(F.col("_draws") / DRAWS), F.ceil(2 * n_tasks * F.col("_draws") / F.col("_all"))).cast("int")
    sizes = written(sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_n", parts.alias("_parts")), "shares")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    dealt = rows.join(sizes, same).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.select(*by, "_parts", "_part", *[c for c in rows.columns if c not in by], F.lit(None).cast("string").alias("_start"))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    if passes is not None:

        def begin(sized: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in sized:
                for *group, n, parts in pdf.itertuples(index=False, name=None):
                    yield pd.DataFrame([(*group, parts, i, start) for i, start in enumerate(passes(int(n), _firsts(int(parts), n_resamples)))], columns=[*by, "_parts", "_part", "_start"])

        begun = sizes.repartition(4 * n_tasks).mapInPandas(begin, ", ".join([f"{c} {types[c]}" for c in by] + ["_parts int, _part int, _start string"]))
        dealt = dealt.unionByName(begun, allowMissingColumns=True)
    # few bytes are much work here, so the number of partitions is stated, lest small ones be merged
    dealt = dealt.repartition(4 * n_tasks, *by, "_part")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        group, (parts, part) = key[:-2], map(int, key[-2:])
        firsts = [*_firsts(parts, n_resamples), n_resamples]
        begins = pdf["_start"].notna()
        start = pdf.loc[begins, "_start"].iloc[0] if begins.any() else None
        pdf = pdf[~begins]
        point, found = share(pdf.sort_values(order, kind="stable"), firsts[part], firsts[part + 1], start)
        return pd.DataFrame([(*group, point, found, len(pdf))], columns=[*by, "point", "found", "n"])

    shares = dealt.groupBy(*by, "_parts", "_part").applyInPandas(run, ", ".join([f"{c} {types[c]}" for c in by] + [SHARE]))
    whole = shares.groupBy(*by).agg(F.first("point", ignorenulls=True).alias("point"), F.array_sort(F.flatten(F.collect_list("found"))).alias("found"), F.max("n").alias("n"))
    tail = (1 - level) / 2
    return whole.select(*by, "point", _quantile(F.col("found"), tail).alias("low"), _quantile(F.col("found"), 1 - tail).alias("high"), "n")


def _ends(values: np.ndarray, level: float) -> tuple[float, float]:
    tail = (1 - level) / 2
    low, high = np.quantile(values, [tail, 1 - tail])
    return float(low), float(high)


def _chunks(n: int, first: int, last: int) -> list[int]:
    rows = max(1, CHUNK // n)
    return [min(rows, last - i) for i in range(first, last, rows)]


def _pieces(n: int) -> list[tuple[int, int]]:
    """(first, size) of the pieces of n values."""
    return [(i, min(PIECE, n - i)) for i in range(0, n, PIECE)]


def _places(rng: np.random.Generator, n: int, size: int) -> np.ndarray:
    """Places from 0 to n - 1. The generator draws the same for both types, as it takes 32 bits for either."""
    return rng.integers(0, n, size=size, dtype=np.uint32 if n <= 1 << 31 else np.int64)


def stationary_starts(n: int, firsts: list[int], seed: int, n_resamples: int) -> list[str]:
    """Where the places of each share and the jumps begin. Draws come in one order, all places before all jumps, so results
    don't depend on the shares; a place may take more than one number, so one pass over the places tells."""
    rng, found = np.random.default_rng(seed), []
    for first, last in zip(firsts, [*firsts[1:], n_resamples]):
        found.append(rng.bit_generator.state)
        for _, size in _pieces((last - first) * n):
            _places(rng, n, size)
    return [json.dumps([places, rng.bit_generator.state]) for places in found]


def stationary_means(values: np.ndarray, start: str, first: int, last: int, block_length: float) -> np.ndarray:
    """Means of resamples first to last - 1; blocks have geometric lengths and run over the end to the start. start: of stationary_starts."""
    n, mean = len(values), values.mean()
    rng, later = np.random.default_rng(), np.random.default_rng()
    rng.bit_generator.state, later.bit_generator.state = json.loads(start)
    if first:
        later.bit_generator.advance(first * n)  # a jump takes one number
    # a block is a slice of the series and its copy, so its sum is a difference of two running sums
    sums = np.concatenate([[0.0], np.cumsum(np.tile(values - mean, 2))])
    means, share, drawn = [], min(1.0, 1.0 / block_length), np.empty(PIECE)
    for m in _chunks(n, first, last):
        ats, jumped = [], []
        for low, size in _pieces(m * n):
            jump_to = _places(rng, n, size)
            jumps = later.random(out=drawn[:size]) < share
            jumps[-low % n :: n] = True  # a resample begins with a block
            here = np.flatnonzero(jumps)
            ats.append(here + low)
            jumped.append(jump_to[here])
        at, places = np.concatenate(ats), np.concatenate(jumped)
        blocks = sums[places + np.diff(at, append=m * n)] - sums[places]
        means.append(np.add.reduceat(blocks, np.searchsorted(at, np.arange(m) * n)) / n + mean)
    return np.concatenate(means)


def stationary_interval(values: np.ndarray, seed: int, n_resamples: int = 10_000, block_length: float = 20.0, level: float = 0.95) -> tuple[float, float, float]:
    """Mean and its percentile interval."""
    if len(values) < 2:
        raise ValueError("two values at least")
    start = stationary_starts(len(values), [0], seed, n_resamples)[0]
    return float(values.mean()), *_ends(stationary_means(values, start, 0, n_resamples, block_length), level)


def stationary_bootstrap(df: DataFrame, by: list[str], order: list[str], value: str, seed: int, n_resamples: int = 2000, block_length: float = 20.0, level: float = 0.95) -> DataFrame:
    """by, point, low, high, n. A series of fewer than two values gives zeros."""

    def share(pdf: pd.DataFrame, first: int, last: int, start: str | None) -> tuple[float | None, np.ndarray]:
        x = pdf[value].to_numpy(float)
        if len(x) < 2:
            return 0.0, np.zeros(last - first)
        return float(x.mean()), stationary_means(x, start, first, last, block_length)

    starts = lambda n, firsts: stationary_starts(n, firsts, seed, n_resamples)
    return _intervals(df.select(*dict.fromkeys([*by, *order, value])), by, order, share, n_resamples, level, passes=starts)


def _draws(seed: int, n: int, last: int, first: int = 0) -> Iterator[np.ndarray]:
    """Places of resamples first to last - 1 of n rows, a chunk of them at a time; the same as drawn at once."""
    rng = np.random.default_rng(seed)
    for m in _chunks(n, 0, first):
        rng.choice(n, size=(m, n), replace=True)
    for m in _chunks(n, first, last):
        yield rng.choice(n, size=(m, n), replace=True)


def mean_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2.0)[inverse]


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float:
    a, b = mean_ranks(x), mean_ranks(y)
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / scale) if scale > 0 else float("nan")


def pair_bootstrap(df: DataFrame, by: list[str], order: list[str], x: str, y: str, seed: int, n_resamples: int = 10_000, level: float = 0.95) -> DataFrame:
    """Rank correlation with the interval of resampled pairs; null ends for two rows or fewer."""

    def share(pdf: pd.DataFrame, first: int, last: int, start: str | None) -> tuple[float | None, np.ndarray]:
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        if len(a) <= 2:
            return None, np.zeros(0)
        rhos = np.array([rank_correlation(a[i], b[i]) for draws in _draws(seed, len(a), last, first) for i in draws])
        return rank_correlation(a, b), rhos[np.isfinite(rhos)]

    return _intervals(df.select(*dict.fromkeys([*by, *order, x, y])), by, order, share, n_resamples, level, RANKING)


def cluster_bootstrap(df: DataFrame, by: list[str], order: list[str], x: str, y: str, cluster: str, seed: int, n_resamples: int = 10_000, level: float = 0.95) -> DataFrame:
    """The same with whole clusters resampled; null ends for fewer than two clusters."""

    def share(pdf: pd.DataFrame, first: int, last: int, start: str | None) -> tuple[float | None, np.ndarray]:
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        places = list(pdf.reset_index(drop=True).groupby(cluster, sort=True).indices.values())
        k = len(places)
        if k < 2:
            return None, np.zeros(0)
        rng = np.random.default_rng(seed)
        for _ in range(first):
            rng.integers(0, k, size=k)
        drawn = (np.concatenate([places[c] for c in rng.integers(0, k, size=k)]) for _ in range(first, last))
        rhos = np.array([rank_correlation(a[i], b[i]) for i in drawn])
        return rank_correlation(a, b), rhos[np.isfinite(rhos)]

    return _intervals(df.select(*dict.fromkeys([*by, *order, x, y, cluster])), by, order, share, n_resamples, level, RANKING)


def mean_difference_bootstrap(df: DataFrame, by: list[str], order: list[str], a: str, b: str, seed: int, n_resamples: int = 10_000, level: float = 0.95) -> DataFrame:
    """Mean of a - b with the interval of resampled pairs; null ends for fewer than two rows."""

    def share(pdf: pd.DataFrame, first: int, last: int, start: str | None) -> tuple[float | None, np.ndarray]:
        d = (pdf[a] - pdf[b]).to_numpy(float)
        if len(d) < 2:
            return None, np.zeros(0)
        return float(d.mean()), np.concatenate([d[i].mean(axis=1) for i in _draws(seed, len(d), last, first)])

    return _intervals(df.select(*dict.fromkeys([*by, *order, a, b])), by, order, share, n_resamples, level)

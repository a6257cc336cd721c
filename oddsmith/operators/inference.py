"""Tests, decompositions and multiplicity control, for all groups in one plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import normal_cdf
from ..sources.shared import written
from . import ranged


def default_lag(n: Column) -> Column:
    """Truncation lag floor(4 (n / 100)^(2/9)), from 0 to n - 1."""
    return F.greatest(F.lit(0), F.least(n - 1, F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))))).cast("int")


BLOCK = 4096  # places of a series that one row of newey_west holds


@F.arrow_udf(T.DoubleType())
def _block_sum(values: pa.Array, lags: pa.Array, owns: pa.Array) -> pa.Array:
    """A block's part of the weighted autocovariances: its own values' products with themselves and the next ones up to the lag."""
    flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum(values.value_lengths().to_numpy())
    out = []
    for end, size, lag, own in zip(ends, values.value_lengths().to_numpy(), lags.to_numpy(), owns.to_numpy()):
        c = flat[end - size : end]
        found = c[:own] @ c[:own]
        for k in range(1, lag + 1):
            later = c[k : own + k]
            found += 2 * (1 - k / (lag + 1.0)) * (c[: len(later)] @ later)
        out.append(found)
    return pa.array(out, pa.float64())


def newey_west(series: DataFrame, by: list[str], order: str | list[str], value: str, lag: int | None = None) -> DataFrame:
    """by, n, lag, mean, variance: long-run variance with falling weights; autocovariances are divided by n, not below 0.

    A series is numbered over key ranges and cut into blocks of BLOCK places, or of its lag where that is more. A block also
    gets the next block's first `lag` values, so its products need no other row; the series' sum is one of blocks. Rows whose
    value is null don't count. Groups with fewer than two rows are left out.
    """
    order = [order] if isinstance(order, str) else list(order)
    parts = ranged.dealt(series.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("_v")), by, order)
    size = parts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean")).where("n >= 2")
    size = size.withColumn("lag", F.least(F.lit(lag), F.col("n").cast("int") - 1) if lag is not None else default_lag(F.col("n")))
    size = written(size, "sizes")
    rows = ranged.join_same(ranged.numbered(parts, by, "_t").select(*by, "_t", "_v"), size, by)
    rows = rows.withColumns({"_t": F.col("_t") - 1, "_c": F.col("_v") - F.col("mean"), "_b": F.greatest(F.lit(BLOCK), F.col("lag"))})
    own = F.expr("_t div _b")
    blocks = F.when((F.col("_t") % F.col("_b") < F.col("lag")) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = rows.select(*by, "lag", "_b", F.explode(blocks).alias("_block"), F.struct("_t", "_c").alias("_x"))
    held = rows.groupBy(*by, "_block").agg(F.first("lag").alias("lag"), F.first("_b").alias("_b"), F.array_sort(F.collect_list("_x")).alias("_x"))
    values = F.transform("_x", lambda x: x["_c"])
    held = held.select(*by, "lag", values.alias("_c"), F.size(F.filter("_x", lambda x: x["_t"] < (F.col("_block") + 1) * F.col("_b"))).alias("_own"))
    total = held.groupBy(*by).agg(F.sum(_block_sum("_c", "lag", "_own")).alias("_s"))
    return ranged.join_same(size, total, by).select(*by, "n", "lag", "mean", F.greatest(F.lit(0.0), F.col("_s") / F.col("n")).alias("variance"))


def diebold_mariano(series: DataFrame, by: list[str], order: str | list[str], a: str = "a", b: str = "b", lag: int | None = None) -> DataFrame:
    """by, n, lag, mean_difference, statistic, p_value. Without variance: 0 and 1 for equal losses, else infinite and 0."""
    nw = newey_west(series.withColumn("_d", F.col(a) - F.col(b)), by, order, "_d", lag)
    same = F.abs("mean") < 1e-15
    statistic = F.when(F.col("variance") > 0, F.col("mean") / F.sqrt(F.nullif(F.col("variance"), F.lit(0.0)) / F.col("n"))).otherwise(F.when(same, 0.0).otherwise(float("inf")))
    out = nw.withColumn("statistic", statistic)
    p = F.when(F.col("variance") > 0, 2 * (1 - normal_cdf(F.abs("statistic")))).otherwise(F.when(same, 1.0).otherwise(0.0))
    return out.select(*by, "n", "lag", F.col("mean").alias("mean_difference"), "statistic", p.alias("p_value"))


def _ranked(df: DataFrame, p: str, by: list[str] | None) -> tuple[DataFrame, list[str]]:
    """df's rows with a p-value with their rank _r and their group's size _n, over key ranges; the columns of a group."""
    own = df.where(F.col(p).isNotNull()).withColumn("_g", F.lit(0))
    group = [*(by or []), "_g"]
    others = F.xxhash64(*df.columns)  # many equal p-values needn't lie in one range
    ranks = ranged.numbered(ranged.dealt(own, group, [F.col(p), others]), group, "_r")
    return ranged.join_same(ranks, ranks.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), group), group


def _untested(df: DataFrame, p: str, out: str, kind: str) -> DataFrame:
    return df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast(kind))


def adjusted_p_values(df: DataFrame, p: str, by: list[str] | None = None, out: str = "q_value") -> DataFrame:
    """Step-up adjusted p-values within by. Rows without a p-value don't count and get none."""
    ranks, group = _ranked(df, p, by)
    least = ranged.least_from_here(ranks.withColumn("_s", F.col(p) * F.col("_n") / F.col("_r")), group, "_r", "_s", out)
    return least.select(*df.columns, F.least(F.lit(1.0), out).alias(out)).unionByName(_untested(df, p, out, "double"))


def rejected(df: DataFrame, p: str, q: float = 0.10, by: list[str] | None = None, out: str = "rejected") -> DataFrame:
    """Step-up mask: all up to the largest rank that passes. Rows without a p-value don't count and aren't rejected."""
    if not 0 < q < 1:
        raise ValueError("q must lie in (0, 1)")
    ranks, group = _ranked(df, p, by)
    cut = ranks.groupBy(*group).agg(F.max(F.when(F.col(p) <= q * F.col("_r") / F.col("_n"), F.col("_r"))).alias("_cut"))
    mask = ranged.join_same(ranks, cut, group).select(*df.columns, (F.col("_r") <= F.coalesce("_cut", F.lit(0))).alias(out))
    return mask.unionByName(_untested(df, p, out, "boolean").withColumn(out, F.lit(False)))


def spearman(df: DataFrame, by: list[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Rank correlation with mean ranks of ties, per group. Ranks come from the distinct values, so ties of any size are one row."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("_g", F.lit(0))
    group = [*by, "_g"]
    pairs = written(rows.groupBy(*group, "_x", "_y").agg(F.count(F.lit(1)).alias("_k")), "pairs")
    for value, rank in (("_x", "_rx"), ("_y", "_ry")):
        pairs = ranged.join_same(pairs, ranged.mean_ranks(rows, group, value, rank), [*group, value])
    k = F.col("_k")
    mean = lambda c: F.sum(k * F.col(c)) / F.sum(k)
    size = written(pairs.groupBy(*group).agg(F.sum("_k").alias("n"), mean("_rx").alias("_mx"), mean("_ry").alias("_my")), "rank-means")
    apart = ranged.join_same(pairs, size, group).withColumns({"_dx": F.col("_rx") - F.col("_mx"), "_dy": F.col("_ry") - F.col("_my")})
    sums = apart.groupBy(*group).agg(F.max("n").alias("n"), *[F.sum(k * F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in (("_dx", "_dy"), ("_dx", "_dx"), ("_dy", "_dy"))])
    rho = F.try_divide(F.col("_dx_dy"), F.nullif(F.sqrt(F.col("_dx_dx") * F.col("_dy_dy")), F.lit(0.0)))
    return sums.select(*by, "n", rho.alias(out))


def murphy(df: DataFrame, p: str = "p", o: str = "o", bins: int = 10) -> DataFrame:
    """One row: brier, reliability, resolution, uncertainty, within_variance, within_covariance and their sums.

    Bins have equal width and the last one is closed; empty bins don't count. The five-term sum is the score itself.
    """
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.col(p) * bins).cast("int")))
    rows = df.select(F.col(p).cast("double").alias("p"), F.col(o).cast("double").alias("o"), bin_.alias("bin"))
    d2 = lambda c: F.pow(c, F.lit(2.0))
    per = rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg("o").alias("mo"), F.var_pop("p").alias("vp"), F.covar_pop("p", "o").alias("c"), F.sum(d2(F.col("p") - F.col("o"))).alias("sq"), F.sum("o").alias("so")
    )
    whole = per.agg(F.sum("n").alias("total"), F.sum("so").alias("hits"))
    per = per.join(F.broadcast(whole)).withColumn("base", F.col("hits") / F.col("total"))
    mean = lambda c: F.sum(F.col("n") * c) / F.max("total")
    out = per.agg(
        F.max("total").alias("n"), (F.sum("sq") / F.max("total")).alias("brier"), mean(d2(F.col("mp") - F.col("mo"))).alias("reliability"), mean(d2(F.col("mo") - F.col("base"))).alias("resolution"),
        F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"), mean(F.col("vp")).alias("within_variance"), mean(F.col("c")).alias("within_covariance"),
    )
    three = F.col("reliability") - F.col("resolution") + F.col("uncertainty")
    four = three + F.col("within_variance")
    five = four - 2 * F.col("within_covariance")
    return out.withColumns({"three_term": three, "four_term": four, "five_term": five, "residual": F.col("brier") - five})


def spread_share(spread: Column, gap: Column) -> Column:
    return F.when(gap != 0, spread / gap)


def equivalent_sample_size(deviation: Column, spread: Column) -> Column:
    """Observations at which the sampling error equals the spread."""
    return F.when(spread != 0, F.pow(deviation / spread, F.lit(2.0)))

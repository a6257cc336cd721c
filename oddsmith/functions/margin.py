"""Taking a book's margin out in four ways, and putting one in.

Solvers are Newton steps from the side where they approach the root without passing it, a fixed number folded over the
book's array, or the same steps for whole batches of books.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .special import let, total

METHODS = ("proportional", "power", "shin", "odds_ratio")
TOLERANCE = 1e-12  # fixed
STEPS = 24


def valid_book(p: Column) -> Column:
    """Two outcomes at least, each strictly between 0 and 1, and a sum of 1 or more within the tolerance."""
    inside = F.forall(p, lambda x: x.isNotNull() & (x > 0) & (x < 1))
    return F.coalesce((F.size(p) >= 2) & inside & (total(p) >= 1 - TOLERANCE), F.lit(False))


def _fair(p: Column, normal: Column) -> Column:
    return F.abs(total(p) - 1) <= TOLERANCE


def _normalised(p: Column) -> Column:
    return let(p, lambda q: let(F.struct(q.alias("q"), total(q).alias("t")), lambda s: F.transform(s["q"], lambda x: x / s["t"])))


def _newton(book: Column, start: float, value, slope, clip=None) -> Column:
    def root(b: Column) -> Column:
        def step(x: Column, _: Column) -> Column:
            f = total(F.transform(b, lambda p: value(p, x, b))) - 1
            d = total(F.transform(b, lambda p: slope(p, x, b)))
            nxt = x - F.coalesce(F.try_divide(f, d), F.lit(0.0))
            return F.least(F.greatest(nxt, F.lit(start)), F.lit(clip)) if clip is not None else F.greatest(nxt, F.lit(start))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(start), step)

    return let(book, root)


def proportional(p: Column) -> Column:
    return _normalised(p)


def power_exponent(p: Column) -> Column:
    return F.when(F.abs(total(p) - 1) <= TOLERANCE, F.lit(1.0)).otherwise(
        _newton(p, 1.0, lambda q, k, b: F.pow(q, k), lambda q, k, b: F.pow(q, k) * F.log(q))
    )


def power(p: Column) -> Column:
    return let(F.struct(p.alias("p"), power_exponent(p).alias("k")), lambda s: _normalised(F.transform(s["p"], lambda q: F.pow(q, s["k"]))))


def shin_z(p: Column) -> Column:
    """The insider share, 0 for a fair book."""
    scaled = let(F.struct(p.alias("p"), total(p).alias("b")), lambda s: F.transform(s["p"], lambda q: F.struct(q.alias("q"), (q * q / s["b"]).alias("u"))))

    def value(x: Column, z: Column, _: Column) -> Column:
        return (F.sqrt(z * z + 4 * (1 - z) * x["u"]) - z) / (2 * (1 - z))

    def slope(x: Column, z: Column, _: Column) -> Column:
        r = F.sqrt(z * z + 4 * (1 - z) * x["u"])
        return ((z - 2 * x["u"]) / r - 1) / (2 * (1 - z)) + (r - z) / (2 * (1 - z) * (1 - z))

    return F.when(F.abs(total(p) - 1) <= TOLERANCE, F.lit(0.0)).otherwise(_newton(scaled, 0.0, value, slope, 1 - 1e-12))


def shin(p: Column) -> Column:
    def at(s: Column) -> Column:
        share = lambda q: F.when(s["z"] <= 0, q / F.sqrt(s["b"])).otherwise((F.sqrt(s["z"] * s["z"] + 4 * (1 - s["z"]) * q * q / s["b"]) - s["z"]) / (2 * (1 - s["z"])))
        return _normalised(F.transform(s["p"], share))

    return let(F.struct(p.alias("p"), shin_z(p).alias("z"), total(p).alias("b")), at)


def shin_two_way(p: Column) -> Column:
    """Closed form for two outcomes, where the insider model takes the same amount off both implied probabilities."""
    d = F.get(p, F.lit(0)) - F.get(p, F.lit(1))
    return F.array((1 + d) / 2, (1 - d) / 2)


def odds_ratio_c(p: Column) -> Column:
    return F.when(F.abs(total(p) - 1) <= TOLERANCE, F.lit(1.0)).otherwise(
        _newton(p, 1.0, lambda q, c, b: q / (c * (1 - q) + q), lambda q, c, b: -q * (1 - q) / F.pow(c * (1 - q) + q, F.lit(2.0)))
    )


def odds_ratio(p: Column) -> Column:
    return let(F.struct(p.alias("p"), odds_ratio_c(p).alias("c")), lambda s: _normalised(F.transform(s["p"], lambda q: q / (s["c"] * (1 - q) + q))))


def demargin(p: Column, method: str) -> Column:
    """struct(probabilities, parameter, method, book_sum) of a valid book of implied probabilities."""
    solve = {
        "proportional": (proportional, total),
        "power": (power, power_exponent),
        "shin": (shin, shin_z),
        "odds_ratio": (odds_ratio, odds_ratio_c),
    }
    if method not in solve:
        raise KeyError(method)
    probabilities, parameter = solve[method]
    return F.struct(probabilities(p).alias("probabilities"), parameter(p).alias("parameter"), F.lit(method).alias("method"), total(p).alias("book_sum"))


def demargin_all(p: Column) -> Column:
    """Array of the fair probabilities of all methods, in their order; explode it for one row a method."""
    return F.array(*[F.struct(F.lit(m).alias("method"), f(p).alias("fair")) for m, f in zip(METHODS, (proportional, power, shin, odds_ratio))])


def fair_by_method(p: np.ndarray) -> np.ndarray:
    """Fair probabilities (book, method, outcome) of valid books (book, outcome): the functions above for many books at a time."""
    t = p.sum(axis=1, keepdims=True)
    fair, log_p, u = np.abs(t - 1) <= TOLERANCE, np.log(p), p * p / t

    def newton(start: float, terms, clip: float = np.inf) -> np.ndarray:
        x = np.full_like(t, start)
        for _ in range(STEPS):
            value, slope = (v.sum(axis=1, keepdims=True) for v in terms(x))
            step = np.divide(value - 1, slope, out=np.zeros_like(x), where=slope != 0)
            last, x = x, np.minimum(np.maximum(x - step, start), clip)
            if np.array_equal(last, x):  # further steps would change nothing
                break
        return np.where(fair, start, x)

    def power_terms(k):
        v = np.exp(k * log_p)
        return v, v * log_p

    def shin_terms(z):
        r = np.sqrt(z * z + 4 * (1 - z) * u)
        return (r - z) / (2 * (1 - z)), ((z - 2 * u) / r - 1) / (2 * (1 - z)) + (r - z) / (2 * (1 - z) * (1 - z))

    def ratio_terms(c):
        d = c * (1 - p) + p
        return p / d, -p * (1 - p) / (d * d)

    z, c = newton(0.0, shin_terms, 1 - 1e-12), newton(1.0, ratio_terms)
    found = [p, p ** newton(1.0, power_terms), np.where(z <= 0, p / np.sqrt(t), (np.sqrt(z * z + 4 * (1 - z) * u) - z) / (2 * (1 - z))), p / (c * (1 - p) + p)]
    return np.stack([f / f.sum(axis=1, keepdims=True) for f in found], axis=1)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _fair_flat(books: pa.Array) -> pa.Array:
    """The fair probabilities of all methods, one after the other, of each book; books of one size are solved together."""
    sizes = books.value_lengths().fill_null(0).to_numpy()
    prices, starts = books.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    out = np.empty(len(METHODS) * len(prices))
    for k in np.unique(sizes[sizes > 0]):
        own = starts[sizes == k][:, None]
        with np.errstate(all="ignore"):  # a book that isn't valid gives what it gives
            found = fair_by_method(prices[own + np.arange(k)])
        out[len(METHODS) * own + np.arange(len(METHODS) * k)] = found.reshape(len(own), -1)
    offsets = pa.array(np.append(0, np.cumsum(len(METHODS) * sizes)).astype(np.int32), mask=np.append(books.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(out))


def with_fair(books: DataFrame, p: str) -> DataFrame:
    """A row per book and method: books with method and fair, from the implied probabilities in column p.

    The solvers run on Arrow batches, a book's steps beside others', as array functions are interpreted row by row.
    """
    solved = books.withColumn("_fair", _fair_flat(F.col(p)))
    part = lambda i: F.slice("_fair", 1 + i * F.size(p), F.size(p))
    rows = solved.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), part(i).alias("fair")) for i, m in enumerate(METHODS)])))
    return rows.select(*books.columns, F.col("_m.method").alias("method"), F.col("_m.fair").alias("fair"))


def overround_exponent(p: Column, target: Column) -> Column:
    """k in (0, 1] with sum(p**k) = target, for 1 <= target < outcomes; null outside that."""

    def root(s: Column) -> Column:
        def step(k: Column, _: Column) -> Column:
            f = total(F.transform(s["p"], lambda q: F.pow(q, k))) - s["t"]
            d = total(F.transform(s["p"], lambda q: F.pow(q, k) * F.log(q)))
            return F.least(F.greatest(k - f / d, F.lit(0.0)), F.lit(1.0))

        # the sum is convex and falls with k: from 0 the steps rise to the root
        return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0.0), step)

    ok = F.forall(p, lambda q: (q > 0) & (q < 1)) & (target >= 1) & (target < F.size(p)) & (total(p) <= target + TOLERANCE)
    return F.when(ok, let(F.struct(p.alias("p"), target.alias("t")), root))


def apply_overround(p: Column, target: Column) -> Column:
    """Decimal prices whose implied probabilities sum to target."""
    return let(F.struct(p.alias("p"), overround_exponent(p, target).alias("k")), lambda s: F.when(s["k"].isNotNull(), F.transform(s["p"], lambda q: F.pow(q, -s["k"]))))


def overround_double_chance(legs: Column, target: Column) -> Column:
    """Prices of the three double-chance legs, which sum to 2: their book sums to twice the target."""
    return apply_overround(legs, 2 * target)

"""The registered queries of the odds study, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decay, margin, pricing, scoring, special, staking
from ..operators import bootstrap, books, cells, fitting, inference, likelihood, protocol, report, study
from ..schema import HALF_LIVES, MATCH_KEYS
from ..sources import registry as names
from ..sources import seasons
from ..sources.shared import new_folder, written
from . import surrogate
from .oracle import M, build

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CELL = books.CELL


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = build(sql)
        return f

    return register


def r(c: Column | str, name: str | None = None) -> Column:
    """Rounded, so that the order of additions doesn't show; no negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, M) + 0.0).alias(name or c)


def d(name: str) -> str:
    return f"round({name}, {M}) + 0.0 as {name}"


# books and coverage ---------------------------------------------------------------------------------------------------


def _books(spark: SparkSession, sf: str) -> DataFrame:
    return books.closing_books(surrogate.odds(spark, sf))


def _margined(spark: SparkSession, sf: str) -> DataFrame:
    return books.margined(_books(spark, sf))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return cells.cell_results(surrogate.forecasts(spark, sf), _books(spark, sf))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return cells.cell_rows(surrogate.forecasts(spark, sf), _books(spark, sf))


def _means(spark: SparkSession, sf: str) -> DataFrame:
    """The cells' results without tests and counts of arbitrage, where these aren't wanted."""
    return cells.cell_means(_rows(spark, sf))


def _spreads_and_margins(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """per_cell and book_margins from books that are made once."""
    b = written(_books(spark, sf), "books")
    return cells.per_cell(cells.cell_means(cells.cell_rows(surrogate.forecasts(spark, sf), b))), books.book_margins(b)


@query(f"select seq, book, market, period, outcome, {d('decimal')} from odds")
def ingest_unpivot_odds(spark, sf):
    """Wide price columns unpivoted through the registry: the header names decide book, market, outcome and period."""
    o = surrogate.odds(spark, sf)
    stems = {f"B{i}": s for i, s in enumerate(("B365", "BW", "GB", "IW", "LB", "WH", "VC"))}
    label = F.create_map(*[F.lit(x) for k, s in stems.items() for x in (k, s)])[F.col("book")]
    sign = F.when(F.col("market") == "1X2", F.col("outcome")).otherwise(F.concat(F.when(F.col("outcome") == "O", ">").otherwise("<"), F.lit("2.5")))
    wide = o.select("seq", *MATCH_KEYS, F.array(F.lit("Div")).alias("header"), F.concat(label, F.when(F.col("period") == "close", "C").otherwise(""), sign).alias("name"), F.col("decimal").cast("string").alias("value"))
    tidy = seasons.price_rows(wide.withColumn("league", F.col("seq").cast("string")), names.registry(spark))
    back = F.create_map(*[F.lit(x) for k, s in stems.items() for x in (names.BOOKMAKERS[s], k)])[F.col("book")]
    return tidy.select(F.col("league").cast("long").alias("seq"), back.alias("book"), "market", "period", "outcome", r("decimal"))


@query("select distinct 'X' || l_shipmode_like as name from (select l_linestatus || l_returnflag as l_shipmode_like from lineitem) union all select distinct 'Zed' || p_size::varchar from part where p_size % 7 = 0")
def header_unknown_anti(spark, sf):
    """Header names outside the registry, by anti join."""
    li = surrogate.table(spark, sf, "lineitem").select(F.concat(F.lit("X"), "l_linestatus", "l_returnflag").alias("name"))
    part = surrogate.table(spark, sf, "part").where("p_size % 7 = 0").select(F.concat(F.lit("Zed"), F.col("p_size").cast("string")).alias("name"))
    known = names.registry(spark)
    headers = li.union(part).union(known.select("name")).distinct()
    return headers.join(F.broadcast(known), "name", "left_anti").select("name")


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 3 else 6 end - case when o_orderkey % 4 > 0 and o_orderkey % 3 > 0 then 3 else 0 end + case when o_orderkey % 4 > 0 and o_orderkey % 3 > 0 then 0 else 0 end as n_kept from orders")
def alias_suppression(spark, sf):
    """Short names give way only where all full names are in the header."""
    o = surrogate.table(spark, sf, "orders").select("o_orderkey")
    full = F.when(F.col("o_orderkey") % 4 == 0, F.array()).when(F.col("o_orderkey") % 3 == 0, F.array(*map(F.lit, ("PSH", "PSD", "WHH")))).otherwise(F.array(*map(F.lit, ("PSH", "PSD", "PSA"))))
    header = F.concat(full.cast("array<string>"), F.array(*map(F.lit, ("PH", "PD", "PA"))))
    kept = o.withColumn("header", header).withColumn("name", F.explode("header")).where(~seasons.suppressed(F.col("header"), F.col("name")))
    return kept.groupBy("o_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n_kept"))


@query("select * from coverage")
def coverage_matrix(spark, sf):
    return books.coverage_matrix(surrogate.odds(spark, sf), surrogate.matches(spark, sf))


@query("select * from coverage where closing and n_with_closing > 0")
def eligible_cells(spark, sf):
    return books.eligible_cells(coverage_matrix(spark, sf))


@query("select league, count(distinct season) as n_seasons from coverage where closing and n_with_closing > 0 group by league having count(distinct season) > 5")
def eligible_leagues(spark, sf):
    return books.eligible_leagues(coverage_matrix(spark, sf))


@query("select book, sum(n_with_closing)::bigint as n_with_closing, count(*) as n_cells from coverage where closing and n_with_closing > 0 group by book")
def book_report(spark, sf):
    return books.book_report(coverage_matrix(spark, sf))


@query(f"select seq, book, market, round(prices[1], {M}) as d1, round(prices[2], {M}) as d2, round(prices[3], {M}) as d3, {d('book_sum')} from books")
def closing_book_pivot(spark, sf):
    b = _books(spark, sf)
    return b.select("seq", "book", "market", *[F.round(F.get("prices", F.lit(i)), M).alias(f"d{i + 1}") for i in range(3)], r("book_sum"))


@query(f"select league, book, market, n_books, round(mean_book_sum, 10) as mean_book_sum, round(median_book_sum, 10) as median_book_sum from margins")
def book_margin_stats(spark, sf):
    return books.book_margins(_books(spark, sf)).select(*CELL, "n_books", *[F.round(c, 10).alias(c) for c in ("mean_book_sum", "median_book_sum")])


@query("select league, book, market, count(*) filter (book_sum <= 1 + 1e-9) as n_arbitrage, count(*) as n_books from books group by all")
def arbitrage_count(spark, sf):
    return books.arbitrage_counts(_books(spark, sf))


# margins --------------------------------------------------------------------------------------------------------------


def _method(name: str, sql_table: str, parameter: str) -> None:
    def f(spark, sf):
        m = _margined(spark, sf).withColumn("x", margin.demargin(F.col("implied"), name))
        return m.select("seq", "book", "market", *[F.round(F.get("x.probabilities", F.lit(i)), M).alias(f"p{i + 1}") for i in range(3)], F.round("x.parameter", 6).alias("parameter"))

    f.__name__ = f"demargin_{name}"
    query(f"select f.seq, f.book, f.market, round(fair[1], {M}) as p1, round(fair[2], {M}) as p2, round(fair[3], {M}) as p3, round({parameter}, 6) as parameter from fair f join {sql_table} k on k.seq = f.seq and k.book = f.book and k.market = f.market where method = '{name}'")(f)


_method("proportional", "margined", "k.book_sum")
_method("power", "power_k", "k.s.lo")
_method("shin", "shin_z", "k.s.lo")
_method("odds_ratio", "ratio_c", "k.s.lo")


@query(f"select seq, book, market, method, round(fair[1], {M}) as p1, round(fair[len(fair)], {M}) as p_last from fair")
def demargin_all_long(spark, sf):
    f = books.fair_books(_margined(spark, sf))
    return f.select("seq", "book", "market", "method", F.round(F.get("fair", F.lit(0)), M).alias("p1"), F.round(F.element_at("fair", -1), M).alias("p_last"))


@query(f"select seq, book, round((1 + implied[1] - implied[2]) / 2, {M}) as p1, round((1 - implied[1] + implied[2]) / 2, {M}) as p2 from margined where market = 'OU25'")
def shin_two_way_closed_form(spark, sf):
    """The solver, held against the closed form in SQL."""
    b = _margined(spark, sf).where("market = 'OU25'").withColumn("f", margin.shin(F.col("implied")))
    return b.select("seq", "book", F.round(F.get("f", F.lit(0)), M).alias("p1"), F.round(F.get("f", F.lit(1)), M).alias("p2"))


_GROW = """list_reduce(list_prepend({'lo': 0.0::double, 'hi': 1.0::double}, list_transform(range(70), lambda i: {'lo': 0.0::double, 'hi': 0.0::double})),
  lambda s, i: case when list_sum(list_transform(ps, lambda p: pow(p, (s.lo + s.hi) / 2))) > target then {'lo': (s.lo + s.hi) / 2, 'hi': s.hi} else {'lo': s.lo, 'hi': (s.lo + s.hi) / 2} end)"""


@query(f"select seq, round(pow(ps[1], -k.lo), 6) as d1, round(pow(ps[2], -k.lo), 6) as d2, round(pow(ps[3], -k.lo), 6) as d3 from (select *, {_GROW} as k from (select seq, [p_home, p_draw, p_away] as ps, 1.08::double as target from forecasts))")
def overround_power(spark, sf):
    f = surrogate.forecasts(spark, sf).withColumn("d", margin.apply_overround(F.array("p_home", "p_draw", "p_away"), F.lit(1.08)))
    return f.select("seq", *[F.round(F.get("d", F.lit(i)), 6).alias(f"d{i + 1}") for i in range(3)])


@query(f"select seq, round(pow(ps[1], -k.lo), 6) as d1, round(pow(ps[2], -k.lo), 6) as d2, round(pow(ps[3], -k.lo), 6) as d3 from (select *, {_GROW} as k from (select seq, [p_home + p_draw, p_home + p_away, p_draw + p_away] as ps, 2 * 1.05::double as target from forecasts))")
def overround_double_chance(spark, sf):
    legs = F.array(F.col("p_home") + F.col("p_draw"), F.col("p_home") + F.col("p_away"), F.col("p_draw") + F.col("p_away"))
    f = surrogate.forecasts(spark, sf).withColumn("d", margin.overround_double_chance(legs, F.lit(1.05)))
    return f.select("seq", *[F.round(F.get("d", F.lit(i)), 6).alias(f"d{i + 1}") for i in range(3)])


@query(f"select seq, book, market, method, place, round(price * model_p - 1, {M}) as ev, round(greatest(0, 0.25 * ((price - 1) * model_p - (1 - model_p)) / (price - 1)), {M}) as kelly from chosen")
def kelly_ev(spark, sf):
    c = _selections(spark, sf)
    return c.select("seq", "book", "market", "method", F.col("place").cast("long").alias("place"), F.round(staking.expected_value(F.col("model_p"), F.col("price")), M).alias("ev"), F.round(staking.kelly(F.col("model_p"), F.col("price")), M).alias("kelly"))


def _selections(spark: SparkSession, sf: str, kind: str = "flat", edge: float = 0.0) -> DataFrame:
    return cells.selections(cells.scored(surrogate.forecasts(spark, sf), _books(spark, sf)), kind, edge)


_SETTLED = "select league, book, market, method, count(*) filter ({c}) as n_bets, round(sum({s}), 6) as turnover, round(sum({p}), 6) as total_profit, round(sum({p}) / nullif(sum({s}), 0), 6) as roi from ({t}) group by all"


def _totals(df: DataFrame) -> DataFrame:
    return df.select(*CELL, "method", "n_bets", *[F.round(c, 6).alias(c) for c in ("turnover", "total_profit", "roi")])


@query(_SETTLED.format(c="chosen", s="stake", p="profit", t="select * from chosen"))
def settle_flat(spark, sf):
    return _totals(cells.settlements(_selections(spark, sf)))


@query(_SETTLED.format(c="chosen", s="k", p="case when won then k * (price - 1) else -k end", t="select *, case when chosen then greatest(0, 0.25 * ((price - 1) * model_p - (1 - model_p)) / (price - 1)) else 0.0 end as k from chosen"))
def settle_kelly(spark, sf):
    return _totals(cells.settlements(_selections(spark, sf, "kelly")))


@query(f"""
select c.league, c.book, c.market, c.method, count(*) as n, round(avg(ln(o.decimal / k.decimal)), {M}) + 0.0 as mean_clv
from (select *, substr(case market when '1X2' then 'HDA' else 'OU' end, place::int + 1, 1) as outcome from chosen where chosen) c
join (select * from odds where period = 'open' and decimal > 1) o using (seq, book, market, outcome)
join (select * from odds where period = 'close' and decimal > 1) k using (seq, book, market, outcome) group by all""")
def clv(spark, sf):
    """What bets on the model's selections would have gained by the opening price, by cell and method."""
    key = ["seq", "book", "market", "outcome"]
    outcome = F.substring(F.when(F.col("market") == "1X2", "HDA").otherwise("OU"), F.col("place") + 1, F.lit(1))
    bets = _selections(spark, sf).where("stake > 0").select("league", "seq", "book", "market", "method", outcome.alias("outcome"))
    o = surrogate.odds(spark, sf)
    both = o.where("period = 'open'").select(*key, "decimal").join(o.where("period = 'close'").select(*key, F.col("decimal").alias("closing")), key)
    both = bets.join(both, key).withColumn("v", staking.closing_line_value(F.col("decimal"), F.col("closing"), F.lit(True))).where("v is not null")
    return both.groupBy(*CELL, "method").agg(F.count(F.lit(1)).alias("n"), r(F.avg("v"), "mean_clv"))


# pricing --------------------------------------------------------------------------------------------------------------


def _grids(spark: SparkSession, sf: str) -> DataFrame:
    return surrogate.with_rates(surrogate.matches(spark, sf)).withColumn("g", pricing.scoreline_grid(F.col("lambda_home"), F.col("lambda_away"), F.col("rho")))


@query(f"select seq, round(exp(home_goals * ln(lambda_home) - lambda_home - lgamma(home_goals + 1)), {M}) as p, round(exp((home_goals + 30) * ln(40.0::double) - 40 - lgamma(home_goals + 31)), {M}) as p_large from rated")
def poisson_pmf(spark, sf):
    m = surrogate.with_rates(surrogate.matches(spark, sf))
    return m.select("seq", r(pricing.poisson_pmf(F.col("home_goals"), F.col("lambda_home")), "p"), r(pricing.poisson_pmf(F.col("home_goals") + 30, F.lit(40.0)), "p_large"))


@query(f"select seq, round(greatest(-1 / lambda_home, -1 / lambda_away), {M}) as low, round(least(1 / (lambda_home * lambda_away), 1), {M}) as high from rated")
def rho_bounds(spark, sf):
    m = surrogate.with_rates(surrogate.matches(spark, sf))
    return m.select("seq", r(pricing.rho_low(F.col("lambda_home"), F.col("lambda_away")), "low"), r(pricing.rho_high(F.col("lambda_home"), F.col("lambda_away")), "high"))


@query(f"select home, away, x::int as x, y::int as y, round(avg(p), {M}) as p from cells121 join matches using (seq) group by all")
def scoreline_matrix(spark, sf):
    """The whole grid of every pairing."""
    g = _grids(spark, sf).select("home", "away", F.posexplode_outer("g").alias("i", "p")).where("i is not null")  # see skellam_pmf
    return g.groupBy("home", "away", F.floor(F.col("i") / 11).cast("int").alias("x"), (F.col("i") % 11).cast("int").alias("y")).agg(r(F.avg("p"), "p"))


@query(f"select seq, {d('p_home')}, {d('p_draw')}, {d('p_away')} from forecasts")
def match_odds(spark, sf):
    return surrogate.forecasts(spark, sf).select("seq", r("p_home"), r("p_draw"), r("p_away"))


@query(f"select seq, round(sum(p) filter (x + y > 1.5), {M}) as over15, round(1 - sum(p) filter (x + y > 1.5), {M}) as under15, round(sum(p) filter (x + y > 3.5), {M}) as over35 from cells121 group by seq")
def totals(spark, sf):
    g = _grids(spark, sf)
    return g.select("seq", r(pricing.over(F.col("g"), 1.5), "over15"), r(1 - pricing.over(F.col("g"), 1.5), "under15"), r(pricing.over(F.col("g"), 3.5), "over35"))


@query(f"select seq, round(sum(p) filter (x > 0 and y > 0), {M}) as yes, round(1 - sum(p) filter (x > 0 and y > 0), {M}) as no from cells121 group by seq")
def btts(spark, sf):
    g = _grids(spark, sf).withColumn("yes", pricing.both_score(F.col("g")))
    return g.select("seq", r("yes"), r(1 - F.col("yes"), "no"))


@query(f"select seq, round(sum(p) filter (x = 2 and y = 1), {M}) as p21, round(sum(p) filter (x = 0 and y = 0), {M}) as p00 from cells121 group by seq")
def correct_score(spark, sf):
    g = _grids(spark, sf)
    return g.select("seq", r(pricing.correct_score(F.col("g"), 2, 1), "p21"), r(pricing.correct_score(F.col("g"), 0, 0), "p00"))


@query(f"select seq, round(p_home + p_draw, {M}) as home_or_draw, round(p_home + p_away, {M}) as home_or_away, round(p_draw + p_away, {M}) as draw_or_away from forecasts")
def double_chance(spark, sf):
    g = _grids(spark, sf).withColumn("c", pricing.double_chance(F.col("g")))
    return g.select("seq", *[r(F.col(f"c.{n}"), n) for n in ("home_or_draw", "home_or_away", "draw_or_away")])


_ASIAN = "coalesce(sum(p) filter (x - y + {h} {op} 0), 0)"


def _asian(op: str, quarter: bool = True) -> str:
    return f"({_ASIAN.format(h=-1.0, op=op)} + {_ASIAN.format(h=-0.5, op=op)}) / 2" if quarter else _ASIAN.format(h=-1.0, op=op)


@query("select seq, " + ", ".join(f"round({_asian(o, q)}, {M}) as {n}{'_quarter' if q else ''}" for q in (False, True) for o, n in ((">", "win"), ("=", "push"), ("<", "lose"))) + " from cells121 group by seq")
def asian_handicap(spark, sf):
    g = _grids(spark, sf).withColumn("w", pricing.asian_handicap(F.col("g"), -1.0)).withColumn("q", pricing.asian_handicap(F.col("g"), -0.75))
    return g.select("seq", *[r(F.col(f"{c}.{n}"), n + s) for c, s in (("w", ""), ("q", "_quarter")) for n in ("win", "push", "lose")])


@query(f"select seq, round(1 + ({_asian('<')}) / ({_asian('>')}), 6) as fair from cells121 group by seq")
def asian_fair_odds(spark, sf):
    g = _grids(spark, sf).withColumn("q", pricing.asian_handicap(F.col("g"), -0.75))
    return g.select("seq", F.round(pricing.asian_fair_odds(F.col("q")), 6).alias("fair"))


_PAIRS = "select distinct home, away, lambda_home, lambda_away from rated"
_SKELLAM = f"""select home, away, k, sum(exp((k + j) * ln(lambda_home) - lambda_home - lgamma(k + j + 1)) * exp(j * ln(lambda_away) - lambda_away - lgamma(j + 1))) as p
from ({_PAIRS}), (select unnest(range(-60, 61)) as k), (select unnest(range(0, 61)) as j) where k + j between 0 and 60 group by all"""


def _skellams(spark: SparkSession, sf: str) -> DataFrame:
    pairs = surrogate.with_rates(surrogate.matches(spark, sf)).select("home", "away", "lambda_home", "lambda_away").distinct()
    return pairs.withColumn("s", pricing.skellam(F.col("lambda_home"), F.col("lambda_away")))


@query(f"select home, away, k::int as k, {d('p')} from ({_SKELLAM})")
def skellam_pmf(spark, sf):
    # from an inner generator the optimiser infers that s isn't empty, and tests that on each match, below the distinct pairs
    return _skellams(spark, sf).select("home", "away", F.posexplode_outer("s").alias("i", "p")).where("i is not null").select("home", "away", (F.col("i") - 60).cast("int").alias("k"), r("p"))


@query("select home, away, " + ", ".join(f"round((sum(p) filter (k - 0.5 {o} 0) + coalesce(sum(p) filter (k {o} 0), 0)) / 2, {M}) as {n}" if o != "=" else f"round(coalesce(sum(p) filter (k = 0), 0) / 2, {M}) as {n}" for o, n in ((">", "win"), ("=", "push"), ("<", "lose"))) + f" from ({_SKELLAM}) group by all")
def skellam_supremacy(spark, sf):
    s = _skellams(spark, sf).withColumn("q", pricing.skellam_handicap(F.col("s"), -0.25))
    return s.select("home", "away", *[r(F.col(f"q.{n}"), n) for n in ("win", "push", "lose")])


# scores and tests -----------------------------------------------------------------------------------------------------


def _forecast_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return surrogate.forecasts(spark, sf).withColumn("p", F.array("p_home", "p_draw", "p_away"))


@query(f"select seq, round((pow(p_home - (outcome = 0)::int, 2) + pow(p_home + p_draw - (outcome <= 1)::int, 2)) / 2, {M}) as rps from forecasts")
def rps(spark, sf):
    return _forecast_arrays(spark, sf).select("seq", r(scoring.ranked_probability_score(F.col("p"), F.col("outcome")), "rps"))


@query(f"select seq, round(pow(p_home - (outcome = 0)::int, 2) + pow(p_draw - (outcome = 1)::int, 2) + pow(p_away - (outcome = 2)::int, 2), {M}) as brier from forecasts")
def brier(spark, sf):
    return _forecast_arrays(spark, sf).select("seq", r(scoring.brier_score(F.col("p"), F.col("outcome")), "brier"))


@query(f"select seq, round(-ln(greatest(case outcome when 0 then p_home when 1 then p_draw else p_away end, 1e-15)), {M}) as log_loss from forecasts")
def log_loss(spark, sf):
    return _forecast_arrays(spark, sf).select("seq", r(scoring.log_loss(F.col("p"), F.col("outcome")), "log_loss"))


@query(f"""select n, {d('brier')}, {d('reliability')}, {d('resolution')}, {d('uncertainty')}, {d('within_variance')}, {d('within_covariance')},
  round(reliability - resolution + uncertainty, {M}) as three_term, round(reliability - resolution + uncertainty + within_variance, {M}) as four_term,
  round(reliability - resolution + uncertainty + within_variance - 2 * within_covariance, {M}) as five_term,
  round(brier - (reliability - resolution + uncertainty + within_variance - 2 * within_covariance), {M}) + 0.0 as residual from (
  select sum(n)::bigint as n, sum(sq) / sum(n) as brier, sum(n * pow(mp - mo, 2)) / sum(n) as reliability, sum(n * pow(mo - base, 2)) / sum(n) as resolution, max(base * (1 - base)) as uncertainty,
    sum(n * vp) / sum(n) as within_variance, sum(n * c) / sum(n) as within_covariance from (
    select bin, count(*) as n, avg(p) as mp, avg(o) as mo, var_pop(p) as vp, covar_pop(p, o) as c, sum(pow(p - o, 2)) as sq from (select *, least(9, trunc(p * 10))::int as bin from binaries) group by bin), (select avg(o) as base from binaries))""")
def murphy(spark, sf):
    m = inference.murphy(surrogate.binary_forecasts(spark, sf))
    return m.select("n", *[r(c) for c in ("brier", "reliability", "resolution", "uncertainty", "within_variance", "within_covariance", "three_term", "four_term", "five_term", "residual")])


def two_sided(z: str) -> str:
    """1 - erf(|z| / sqrt 2) as a series of positive terms; beyond 8 it is 0 to all digits shown."""
    terms = f"list_transform(range(140), lambda i: exp(i * ln(2::double) + (2 * i + 1) * ln(abs({z}) / sqrt(2::double)) - (i + 1) * ln(2::double) - lgamma(i + 1.5) + ln(sqrt(pi()))))"
    return f"case when {z} = 0 then 1.0::double when abs({z}) > 8 then 0.0::double else greatest(0.0::double, 1 - 2 / sqrt(pi()) * exp(-({z}) * ({z}) / 2) * list_sum({terms})) end"


_SERIES = """select series, n, lag, mean, greatest(0, (g0 + 2 * gk) / n) as variance from (
  select a.series, any_value(a.n) as n, any_value(a.lag) as lag, any_value(a.mean) as mean, any_value(a.g0) as g0, sum(a.c * b.c * (1 - (b.seq - a.seq) / (a.lag + 1.0::double))) as gk
  from (select *, sum(c * c) over (partition by series) as g0 from ({c})) a join ({c}) b on a.series = b.series and b.seq > a.seq and b.seq <= a.seq + a.lag group by a.series)"""
_CENTRED = """select l.series, l.seq, n, mean, greatest(0, least(n - 1, floor(4 * pow(n / 100.0::double, 2.0::double / 9)))) as lag, {v} - mean as c
  from losses l join (select series, count(*) as n, avg({v}) as mean from losses group by series) using (series)"""


@query(f"select series, n, lag::int as lag, {d('mean')}, round(variance, 7) as variance from ({_SERIES.format(c=_CENTRED.format(v='a'))})")
def newey_west(spark, sf):
    return inference.newey_west(surrogate.losses(spark, sf), ["series"], "seq", "a").select("series", "n", "lag", r("mean"), F.round("variance", 7).alias("variance"))


@query(f"select series, n, lag::int as lag, round(mean, {M}) + 0.0 as mean_difference, round(mean / sqrt(variance / n), 5) + 0.0 as statistic, round({two_sided('mean / sqrt(variance / n)')}, 6) + 0.0 as p_value from ({_SERIES.format(c=_CENTRED.format(v='(a - b)'))})")
def diebold_mariano_stat(spark, sf):
    dm = inference.diebold_mariano(surrogate.losses(spark, sf), ["series"], "seq")
    return dm.select("series", "n", "lag", r("mean_difference"), (F.round("statistic", 5) + 0.0).alias("statistic"), (F.round("p_value", 6) + 0.0).alias("p_value"))


@query(f"select k, round(0.5 + sign(z) * 0.5 * 2 / sqrt(pi()) * exp(-z * z / 2) * coalesce(list_sum(list_transform(range(140), lambda n: exp(n * ln(2::double) + (2 * n + 1) * ln(abs(z) / sqrt(2::double)) - (n + 1) * ln(2::double) - lgamma(n + 1.5) + ln(sqrt(pi()))))), 0), {M}) as cdf from (select k, k / 100.0::double as z from (select distinct event_id % 1200 - 600 as k from events) where k <> 0)")
def normal_cdf(spark, sf):
    e = surrogate.table(spark, sf, "events").select((F.col("event_id") % 1200 - 600).alias("k")).distinct().where("k <> 0")
    return e.select("k", r(special.normal_cdf(F.col("k") / 100.0), "cdf"))


def _p_values(spark: SparkSession, sf: str) -> DataFrame:
    return surrogate.table(spark, sf, "events").select(F.col("event_id").alias("seq"), ((F.col("event_id") * 7919 % 9973 + 1) / 10000.0).alias("p"), "event_type")


@query("select seq, p <= coalesce(max(case when p <= 0.1 * rk / n then p end) over (partition by event_type), -1) as rejected from (select *, row_number() over (partition by event_type order by p) as rk, count(*) over (partition by event_type) as n from pvals)")
def bh_mask(spark, sf):
    return inference.rejected(_p_values(spark, sf), "p", 0.10, ["event_type"]).select("seq", "rejected")


@query("select seq, least(1.0::double, min(p * n / rk) over (partition by event_type order by rk desc rows unbounded preceding)) as q_value from (select *, row_number() over (partition by event_type order by p) as rk, count(*) over (partition by event_type) as n from pvals)")
def bh_qvalues(spark, sf):
    return inference.adjusted_p_values(_p_values(spark, sf), "p", ["event_type"]).select("seq", "q_value")


@query(f"select event_type, count(*) as n, round(corr(rx, ry), {M}) as rho from (select event_type, rank() over (partition by event_type order by x) + (count(*) over (partition by event_type, x) - 1) / 2.0::double as rx, rank() over (partition by event_type order by y) + (count(*) over (partition by event_type, y) - 1) / 2.0::double as ry from (select event_type, user_id % 17 as x, floor(value) as y from events where value is not null)) group by event_type")
def spearman(spark, sf):
    e = surrogate.table(spark, sf, "events").select("event_type", (F.col("user_id") % 17).alias("x"), F.floor("value").alias("y"))
    return inference.spearman(e, ["event_type"], "x", "y").select("event_type", "n", r("rho"))


@query(f"select league, book, market, round(rps_spread / nullif(gap, 0), 4) as share from percell join (select league, book, market, max(model_rps) - avg(bench_rps) as gap from results group by all) using (league, book, market)")
def spread_share(spark, sf):
    res = written(_means(spark, sf), "means")  # it is read twice
    gap = res.groupBy(*CELL).agg((F.max("model_rps") - F.avg("bench_rps")).alias("gap"))
    return cells.per_cell(res).join(gap, CELL).select(*CELL, F.round(inference.spread_share(F.col("rps_spread"), F.col("gap")), 4).alias("share"))


@query("select p.league, p.book, p.market, round(pow(sd / nullif(rps_spread, 0), 2), 1) as n_equivalent from percell p join (select league, book, market, stddev_samp(model_rps) as sd from scored where method = 'shin' group by all) s using (league, book, market)")
def equivalent_n(spark, sf):
    rows = cells.scored(surrogate.forecasts(spark, sf), _books(spark, sf)).where("method = 'shin'")
    sd = rows.groupBy(*CELL).agg(F.stddev_samp("model_rps").alias("sd"))
    return cells.per_cell(_means(spark, sf)).join(sd, CELL).select(*CELL, F.round(inference.equivalent_sample_size(F.col("sd"), F.col("rps_spread")), 1).alias("n_equivalent"))


# time and likelihood --------------------------------------------------------------------------------------------------

_AS_OF = "2001-08-02"  # the day after the last match of the tables
_RATE = 400.0


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    as_of, rate = F.to_timestamp_ntz(F.lit(_AS_OF)), decay.half_life_to_rate(F.lit(_RATE))
    return likelihood.weighted_matches(surrogate.with_rates(surrogate.matches(spark, sf)), as_of, rate)


@query("select p_size, round(ln(2::double) / p_size, 8) as rate, round(ln(2::double) / (ln(2::double) / p_size), 8) as back from (select distinct p_size from part where p_size > 0)")
def half_life(spark, sf):
    p = surrogate.table(spark, sf, "part").where("p_size > 0").select("p_size").distinct().withColumn("x", decay.half_life_to_rate(F.col("p_size").cast("double")))
    return p.select("p_size", r("x", "rate"), r(decay.rate_to_half_life(F.col("x")), "back"))


@query("select seq, round(age, 9) as age from weighted")
def match_age(spark, sf):
    m = surrogate.matches(spark, sf).withColumn("age", decay.age_days(F.col("kickoff"), F.to_timestamp_ntz(F.lit(_AS_OF)))).where("age is not null")
    return m.select("seq", F.round("age", 9).alias("age"))


@query(f"select seq, {d('w')} from weighted")
def time_weights(spark, sf):
    return _weighted(spark, sf).select("seq", r("w"))


_SIDES = "(select league, home as team, w from weighted union all select league, away, w from weighted)"


@query(f"select league, team, round(sum(w), 6) as weight from {_SIDES} group by all having sum(w) >= 20")
def team_weight_filter(spark, sf):
    return likelihood.identifiable_teams(_weighted(spark, sf), 20.0).select("league", "team", F.round("weight", 6).alias("weight"))


@query(f"select league, team, row_number() over (partition by league order by team) - 1 as idx from (select distinct league, team from (select league, home as team from usable union all select league, away from usable))".replace("from usable", f"from (select * from weighted x where exists (select 1 from (select league, team from {_SIDES} group by all having sum(w) >= 20) t where t.league = x.league and t.team = x.home) and exists (select 1 from (select league, team from {_SIDES} group by all having sum(w) >= 20) t where t.league = x.league and t.team = x.away))"))
def team_encode(spark, sf):
    w = _weighted(spark, sf)
    return likelihood.team_index(likelihood.between_identifiable(w, likelihood.identifiable_teams(w, 20.0))).select("league", "team", F.col("idx").cast("long").alias("idx"))


@query(f"select seq, {d('lambda_home')}, {d('lambda_away')} from (select seq, (1 + substr(home, 2)::int % 5 / 10.0::double) * (0.8 + substr(away, 2)::int % 4 / 10.0::double) * 1.3::double as lambda_home, (1 + substr(away, 2)::int % 5 / 10.0::double) * (0.8 + substr(home, 2)::int % 4 / 10.0::double) as lambda_away from matches where home <> 'T19' and away <> 'T19')")
def rates(spark, sf):
    m = surrogate.matches(spark, sf)
    number = F.substring("team", 2, 3).cast("int")
    teams = m.select("league", F.col("home").alias("team")).distinct().where("team <> 'T19'")
    strengths = teams.withColumn("attack", 1 + number % 5 / 10.0).withColumn("defence", 0.8 + number % 4 / 10.0)
    fits = m.select("league").distinct().withColumns({"gamma": F.lit(1.3), "rho": F.lit(-0.1)})
    return likelihood.rates(m, strengths, fits).select("seq", r("lambda_home"), r("lambda_away"))


_TAU = "case when home_goals = 0 and away_goals = 0 then 1 - lambda_home * lambda_away * rho when home_goals = 0 and away_goals = 1 then 1 + lambda_home * rho when home_goals = 1 and away_goals = 0 then 1 + lambda_away * rho when home_goals = 1 and away_goals = 1 then 1 - rho else 1 end"


@query(f"select league, count(*) as n, round(-sum(w * (ln({_TAU}) + home_goals * ln(lambda_home) - lambda_home + away_goals * ln(lambda_away) - lambda_away)), 5) as nll from weighted group by league")
def neg_loglik_at_params(spark, sf):
    return likelihood.negative_log_likelihood(_weighted(spark, sf)).select("league", "n", F.round("nll", 5).alias("nll"))


@query(f"""select league, team, round(-sum(a), 5) + 0.0 as d_log_attack, round(-sum(f), 5) + 0.0 as d_log_defence from (
  select league, home as team, gh as a, ga as f from g union all select league, away, ga, gh from g) group by all""".replace("from g", f"""from (select *, w * (home_goals - lambda_home + lambda_home * dl / tau) as gh, w * (away_goals - lambda_away + lambda_away * dm / tau) as ga from (
  select *, {_TAU} as tau, case when home_goals = 0 and away_goals = 0 then -lambda_away * rho when home_goals = 0 and away_goals = 1 then rho else 0 end as dl, case when home_goals = 0 and away_goals = 0 then -lambda_home * rho when home_goals = 1 and away_goals = 0 then rho else 0 end as dm from weighted))"""))
def gradient_by_team(spark, sf):
    g = likelihood.gradient_by_team(_weighted(spark, sf))
    return g.select("league", "team", *[(F.round(c, 5) + 0.0).alias(c) for c in ("d_log_attack", "d_log_defence")])


@query(f"select league, round(greatest(0, max(greatest(-1 / lambda_home, -1 / lambda_away) + 0.6), max(-0.6 - least(1 / (lambda_home * lambda_away), 1))), {M}) as violation from rated group by league")
def rho_violation(spark, sf):
    m = surrogate.with_rates(surrogate.matches(spark, sf)).withColumn("rho", F.lit(-0.6))
    return likelihood.rho_violation(m).select("league", r("violation"))


@query('select league, round(sum(w * (lgamma(home_goals + 1) + lgamma(away_goals + 1))), 5) as "offset" from weighted group by league')
def log_factorial_offset(spark, sf):
    return likelihood.log_factorial_offset(_weighted(spark, sf)).select("league", F.round("offset", 5).alias("offset"))


# protocol -------------------------------------------------------------------------------------------------------------


@query("select league, season, place, case when place <= 3 then 'burn_in' when place <= 5 then 'calibration' else 'evaluation' end as period from (select league, season, dense_rank() over (partition by league order by case when season[1:2] >= '90' then 1900 else 2000 end + season[1:2]::int) as place, count(*) over (partition by league) as n from (select distinct league, season from matches)) where n > 5")
def period_split(spark, sf):
    return protocol.split_periods(surrogate.matches(spark, sf)).withColumn("place", F.col("place").cast("long"))


@query("select league, season from (" + ORACLES["period_split"] + ") where period in ('calibration', 'evaluation')")
def scored_seasons(spark, sf):
    return study.seasons_in(protocol.split_periods(surrogate.matches(spark, sf)))


@query("select league, season, count(distinct period) as n_periods from (" + ORACLES["period_split"] + ") group by all having count(distinct period) > 1")
def period_overlap(spark, sf):
    """Seasons in two periods: none, whatever the input."""
    return study.shared_seasons(protocol.split_periods(surrogate.matches(spark, sf)))


@query(f"select book, market, seq, {d('book_sum')} from (select *, row_number() over (partition by book, market order by kickoff, seq) as place from books) where place = 1")
def first_complete_books(spark, sf):
    return study.first_complete_books(_books(spark, sf), ("kickoff", "seq")).select("book", "market", "seq", r("book_sum"))


@query("select league, strftime(day, '%Y-%m-%d') as day, n_matches, coalesce(sum(n_matches) over (partition by league order by day rows between unbounded preceding and 1 preceding), 0)::bigint as n_history from (select league, date_trunc('day', kickoff) as day, count(*) as n_matches from matches group by all)")
def history_counts(spark, sf):
    return protocol.history_counts(surrogate.matches(spark, sf)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"select seq, outcome, {d('p_home')}, {d('p_over25')}, {d('p_under25')}, {d('lambda_home')}, {d('lambda_away')} from forecasts where lambda_home > 0.05 and lambda_home < 6 and lambda_away < 6 and rho between greatest(-1 / lambda_home, -1 / lambda_away) and least(1 / (lambda_home * lambda_away), 1)")
def forecast_rows(spark, sf):
    f = protocol.price_fixtures(surrogate.with_rates(surrogate.matches(spark, sf)))
    return f.select("seq", "outcome", *[r(c) for c in ("p_home", "p_over25", "p_under25", "lambda_home", "lambda_away")])


_CANDIDATES = "select h::double as half_life_days, seq, (pow(p_home + (h % 7) / 1000.0::double - (outcome = 0)::int, 2) + pow(p_away - (outcome = 2)::int, 2)) / 2 as rps from forecasts, (select unnest([30, 60, 90, 150, 250, 400, 700, 1200, 2000, 40000]) as h) where (seq + h) % 11 > 0"
_PAIRED = f"select half_life_days, count(*) as n_all, avg(rps) as mean_rps_all, count(*) filter (paired) as n_paired, avg(rps) filter (paired) as mean_rps_paired from (select c.*, k = 10 as paired from ({_CANDIDATES}) c join (select seq, count(distinct half_life_days) as k from ({_CANDIDATES}) group by seq) using (seq)) group by half_life_days"


def _calibrated(spark: SparkSession, sf: str) -> DataFrame:
    f = surrogate.forecasts(spark, sf).withColumn("half_life_days", F.explode(F.array(*[F.lit(h) for h in HALF_LIVES]))).where("(seq + cast(half_life_days as bigint)) % 11 > 0")
    score = scoring.rps3(F.col("p_home") + (F.col("half_life_days").cast("long") % 7) / 1000.0, F.col("p_draw"), F.col("p_away"), F.col("outcome"))
    return protocol.paired_calibration(f.select("half_life_days", "seq", score.alias("rps")), ["seq"])


@query(f"select half_life_days, n_all, round(mean_rps_all, {M}) as mean_rps_all, n_paired, round(mean_rps_paired, {M}) as mean_rps_paired from ({_PAIRED})")
def paired_calibration(spark, sf):
    return _calibrated(spark, sf).select("half_life_days", "n_all", r("mean_rps_all"), "n_paired", r("mean_rps_paired"))


@query(f"select half_life_days, round(mean_rps_paired, {M}) as mean_rps_paired from ({_PAIRED}) order by mean_rps_paired, half_life_days limit 1")
def select_min_candidate(spark, sf):
    return protocol.select_half_life(_calibrated(spark, sf)).select("half_life_days", r("mean_rps_paired"))


@query(f"select half_life_days, round(mean_rps_all, {M}) as mean_rps_all from ({_PAIRED}) order by mean_rps_all, half_life_days limit 1")
def select_unpaired_candidate(spark, sf):
    return protocol.select_half_life(_calibrated(spark, sf), "mean_rps_all").select("half_life_days", r("mean_rps_all"))


# cells and reports ----------------------------------------------------------------------------------------------------


@query("select r.league, r.book, r.market, r.method, n_matches, round(model_rps, 7) as model_rps, round(bench_rps, 7) as bench_rps, round(rps_diff, 7) + 0.0 as rps_diff, round(dm_stat, 4) + 0.0 as dm_stat, round(" + two_sided("dm_stat") + ", 6) + 0.0 as dm_p, n_bets, round(roi, 6) + 0.0 as roi, coalesce(n_arbitrage, 0) as n_arbitrage from results r left join (select league, book, market, count(*) as n_arbitrage from books where book_sum <= 1 + 1e-9 group by all) a using (league, book, market)")
def cell_results(spark, sf):
    c = _results(spark, sf)
    return c.select(*CELL, "method", "n_matches", *[(F.round(x, 7) + 0.0).alias(x) for x in ("model_rps", "bench_rps", "rps_diff")], (F.round("dm_stat", 4) + 0.0).alias("dm_stat"), (F.round("dm_p", 6) + 0.0).alias("dm_p"), "n_bets", (F.round("roi", 6) + 0.0).alias("roi"), "n_arbitrage")


_SHOWN = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in ("roi_spread", "rps_spread", "roi_min", "roi_max", "roi_proportional", "roi_shin"))


@query(f"select league, book, market, n_matches, {_SHOWN}, n_bets_spread, sign_flip, sign_flip_prop_shin from percell")
def per_cell_spread(spark, sf):
    c = cells.per_cell(_means(spark, sf))
    return c.select(*CELL, "n_matches", *[(F.round(x, 6) + 0.0).alias(x) for x in ("roi_spread", "rps_spread", "roi_min", "roi_max", "roi_proportional", "roi_shin")], "n_bets_spread", "sign_flip", "sign_flip_prop_shin")


_BYBOOK = "select book, count(*) as n_cells, avg(mean_book_sum) as margin, avg(roi_spread) as roi_spread, avg(rps_spread) as rps_spread from percell left join margins using (league, book, market) group by book"


def _by_book(spark: SparkSession, sf: str) -> DataFrame:
    return report.margin_spread_by_book(*_spreads_and_margins(spark, sf))


@query(f"select book, n_cells, round(margin, 7) as margin, round(roi_spread, 6) as roi_spread, round(rps_spread, 7) as rps_spread from ({_BYBOOK})")
def p1_by_book(spark, sf):
    return _by_book(spark, sf).select("book", "n_cells", F.round("margin", 7).alias("margin"), F.round("roi_spread", 6).alias("roi_spread"), F.round("rps_spread", 7).alias("rps_spread"))


@query(f"select count(*) as n_books, round(regr_slope(roi_spread, margin), 4) as slope, round(regr_intercept(roi_spread, margin), 4) as intercept from ({_BYBOOK})")
def margin_spread_line(spark, sf):
    return report.margin_spread_line(_by_book(spark, sf)).select("n_books", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


_P2 = "select '{v}' as quantity, count(*) as n_pairs, round(avg(a), 6) as one_x_two, round(avg(b), 6) as over_under, round(avg(a - b), 6) + 0.0 as difference, round(avg((round(a - b, 10) > 0)::int), 6) as share_larger from (select league, book, max({v}) filter (market = '1X2') as a, max({v}) filter (market = 'OU25') as b from percell group by all) where a is not null and b is not null"


@query(_P2.format(v="roi_spread") + " union all " + _P2.format(v="rps_spread"))
def p2_pairs(spark, sf):
    t = report.market_comparison(cells.per_cell(written(_means(spark, sf), "means")))  # it is read twice
    return t.select("quantity", "n_pairs", *[(F.round(c, 6) + 0.0).alias(c) for c in ("one_x_two", "over_under", "difference", "share_larger")])


@query("select league, book, market, n_matches, round(roi_proportional, 6) + 0.0 as roi_proportional, round(roi_shin, 6) + 0.0 as roi_shin, round(roi_spread, 6) as roi_spread from percell where sign_flip_prop_shin order by percell.roi_spread desc, league, book, market limit 20")
def p3_sign_flips(spark, sf):
    t = report.sign_flips(cells.per_cell(_means(spark, sf)))
    return t.select(*CELL, "n_matches", *[(F.round(c, 6) + 0.0).alias(c) for c in ("roi_proportional", "roi_shin")], F.round("roi_spread", 6).alias("roi_spread"))


@query("select count(*) filter (sign_flip_prop_shin) as n_prop_shin, count(*) filter (sign_flip) as n_any, round(avg(sign_flip_prop_shin::int), 6) as share_prop_shin, count(*) as n_cells from percell")
def p3_shares(spark, sf):
    return report.sign_flip_shares(cells.per_cell(_means(spark, sf))).withColumn("share_prop_shin", F.round("share_prop_shin", 6))


@query("select method, count(*) as n_cells, round(avg(model_rps), 6) as model_rps, round(avg(bench_rps), 6) as bench_rps, round(avg(rps_diff), 6) + 0.0 as rps_diff, round(avg((rps_diff < 0)::int), 6) as favours_model, "
       "round(avg((q < 0.10)::int), 6) as significant, (list_position(['proportional', 'power', 'shin', 'odds_ratio'], method) - 1)::int as place from ("
       "select *, least(1.0::double, min(p * n / rk) over (order by rk desc rows unbounded preceding)) as q from ("
       "select *, row_number() over (order by p) as rk, count(p) over () as n from (select *, " + two_sided("dm_stat") + " as p from results))) group by method")
def dm_table(spark, sf):
    t = report.method_table(cells.cell_tests(written(_rows(spark, sf), "cell-rows")))
    return t.select("method", "n_cells", *[(F.round(c, 6) + 0.0).alias(c) for c in ("model_rps", "bench_rps", "rps_diff", "favours_model", "significant")], "place")


@query("select league, count(*) as n_cells, sum(n_matches)::bigint as n_matches from (select distinct league, book, market, n_matches from results) group by league")
def coverage_table(spark, sf):
    return report.coverage_table(_means(spark, sf))


@query("select count(distinct (league, book, market)) as n_cells, count(distinct league) as n_leagues, count(distinct book) as n_books from results")
def summary_counts(spark, sf):
    return report.summary(_means(spark, sf))


@query(f"select arg_min(half_life_days, mean_rps_paired) as best_half_life, round(min(mean_rps_paired), {M}) as best, round(max(mean_rps_paired) - min(mean_rps_paired), {M}) as \"range\", round(arg_max(mean_rps_paired, half_life_days), {M}) as no_decay, round(arg_min(mean_rps_paired, half_life_days), {M}) as fastest from ({_PAIRED})")
def calibration_curve(spark, sf):
    return report.calibration_summary(_calibrated(spark, sf)).select("best_half_life", *[r(c) for c in ("best", "range", "no_decay", "fastest")])


@query("select league, book, market, round(roi_spread, 6) as roi_spread from percell order by percell.roi_spread desc nulls last, league, book, market limit 1")
def divergence_target(spark, sf):
    return report.divergence_target(cells.per_cell(_means(spark, sf))).withColumn("roi_spread", F.round("roi_spread", 6))


@query("select seq, book, market, (list_position(implied, list_min(implied)) - 1)::int as longshot from books")
def longshot_index(spark, sf):
    return report.longshot_places(_books(spark, sf)).select("seq", "book", "market", "longshot")


@query("select method, least(16, 1 + floor((roi + 0.5) * 16))::int as bin, count(*) as n from results where roi between -0.5 and 0.5 group by all")
def roi_histogram(spark, sf):
    return report.roi_histogram(_means(spark, sf), -0.5, 0.5)


@query("select round(avg((model_rps > bench_rps)::int), 6) as share_above, count(*) as n from results where method = 'proportional'")
def share_above_diagonal(spark, sf):
    return report.share_above_diagonal(_means(spark, sf)).withColumn("share_above", F.round("share_above", 6))


@query(f"select league, book, market, method, round(avg(bench_rps), 7) as bench_rps, round(avg(model_rps), 7) as model_rps, count(*) as n_matches from scored where method in ('proportional', 'shin') group by all")
def benchmark_scores(spark, sf):
    """Odds to complete closing books, margin filter, two methods, benchmark and model score of every cell."""
    rows = cells.scored(surrogate.forecasts(spark, sf), _books(spark, sf)).where("method in ('proportional', 'shin')")
    return rows.groupBy(*CELL, "method").agg(F.round(F.avg("bench_rps"), 7).alias("bench_rps"), F.round(F.avg("model_rps"), 7).alias("model_rps"), F.count(F.lit(1)).alias("n_matches"))


# season files ---------------------------------------------------------------------------------------------------------


@query("select league, season, strftime(told, '%Y-%m-%d %H:%M:%S') as kickoff, home, away, home_goals, away_goals from filed where usable")
def load_seasons_matches(spark, sf):
    """Tables to ragged season files, and back to tidy matches."""
    m = seasons.load_seasons(spark, surrogate.season_archive(spark, sf), partitioned=True)[0]
    return m.withColumn("kickoff", F.date_format("kickoff", "yyyy-MM-dd HH:mm:ss"))


_FILED_PRICE = "select league, season, strftime(told, '%Y-%m-%d %H:%M:%S') as kickoff, home, away, 'Bet365' as book, '1X2' as market, 'close' as period, '{o}' as outcome, round(1.5::double + (seq % {k}) / 100.0::double, 2) as decimal from filed where usable{also}"


@query(" union all ".join(_FILED_PRICE.format(o=o, k=k, also=also) for o, k, also in (("H", 97, ""), ("D", 211, " and seq % 13 <> 0 and seq % 17 <> 0"), ("A", 307, ""))))
def load_seasons_odds(spark, sf):
    """Tables to ragged season files, and back to tidy prices."""
    o = seasons.load_seasons(spark, surrogate.season_archive(spark, sf), partitioned=True)[1]
    return o.withColumn("kickoff", F.date_format("kickoff", "yyyy-MM-dd HH:mm:ss"))


@query("select distinct season, league, case when league like '4%' then 'unknown columns: Mystery' else 'another league''s rows' end as reason from filed where season like '97%' and (league like '4%' or league like '5%')")
def header_problems(spark, sf):
    """The season files that can't be used, and why."""
    folder = surrogate.season_archive(spark, sf)
    files = seasons.season_files(spark, folder, partitioned=True)
    problems = seasons.load_seasons(spark, folder, partitioned=True)[2]
    return files.select("path", "season", "league").join(problems, "path").select("season", "league", "reason")


@query("select league, count(*) as n_forecasts from forecasts group by league")
def forecast_counts(spark, sf):
    """Forecasts written by league, and counted from their files."""
    folder = new_folder(spark, "forecasts")
    seasons.write_by_league(surrogate.forecasts(spark, sf), folder)
    return study.forecast_counts(spark.read.parquet(folder))


# fits and resampling: rows only ---------------------------------------------------------------------------------------


@query()
def mle_fit(spark, sf):
    f = fitting.fit_strengths(surrogate.matches(spark, sf), _AS_OF, 0.6931471805599453 / 400)
    return f.select("league", "team", *[F.round(c, 4).alias(c) for c in ("attack", "defence", "gamma", "rho")], "n_matches", "converged")


@query()
def walk_forward(spark, sf):
    m = surrogate.matches(spark, sf)
    scored = protocol.split_periods(m).where("period = 'evaluation'")
    f = fitting.walk_forward(m, scored, 0.6931471805599453 / 400, min_fit_matches=300)
    return f.select("seq", "league", "season", "outcome", *[F.round(c, 4).alias(c) for c in ("p_home", "p_draw", "p_away", "p_over25")], "n_fit_matches")


def _priced(period: str, rates: str) -> str:
    """SQL of the fixtures that walk-forward prices, by candidate: teams carry their matches' weights up to the day; those of
    less than 1 go with all their matches, and both sides of a fixture must then have a match left."""
    return f"""
with periods as ({ORACLES["period_split"]}),
targets as (select m.*, date_trunc('day', kickoff) as day from matches m join periods using (league, season) where period = '{period}'),
days as (select distinct league, day from targets),
rates as (select i, r from (select unnest(range(len(x))) as i, unnest(x) as r from (select {rates} as x))),
history as (
  select d.league, day, home, away, count(*) as n, list(epoch_us(day::timestamp - kickoff) / 86400000000.0::double) as ages
  from days d join matches m on m.league = d.league and m.kickoff < d.day group by all),
pairs as (select h.*, i, list_sum(list_transform(ages, lambda a: exp(-r * a))) as w from history h, rates),
carried as (
  select league, day, i, team from (
    select league, day, i, home as team, w from pairs union all select league, day, i, away, w from pairs)
  group by all having sum(w) >= 1),
usable as (
  select league, day, i, home, away from pairs p
  semi join carried c on c.league = p.league and c.day = p.day and c.i = p.i and c.team = p.home
  semi join carried c on c.league = p.league and c.day = p.day and c.i = p.i and c.team = p.away),
rated as (select league, day, i, home as team from usable union select league, day, i, away from usable),
sizes as (select league, day, sum(n)::bigint as n_fit_matches from history group by all having sum(n) >= 300),
priced as (
  select t.*, s.n_fit_matches, a.i from targets t join sizes s using (league, day)
  join rated a on a.league = t.league and a.day = t.day and a.team = t.home
  join rated b on b.league = t.league and b.day = t.day and b.team = t.away and b.i = a.i)
"""


@query("select * from (" + _priced("evaluation", "[ln(2::double) / 400]")
       + "select seq, league, season, n_fit_matches, case when home_goals > away_goals then 0 when home_goals = away_goals then 1 else 2 end as outcome, true as adds_up from priced)")
def walk_forward_rows(spark, sf):
    """The fixtures that real fits price, with the history of each and whether its probabilities add up."""
    m = surrogate.matches(spark, sf)
    f = fitting.walk_forward(m, protocol.split_periods(m).where("period = 'evaluation'"), study.rate_of(400.0))
    sums = (F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - 1) < 1e-9) & (F.abs(F.col("p_over25") + F.col("p_under25") - 1) < 1e-9)
    return f.select("seq", "league", "season", "n_fit_matches", "outcome", sums.alias("adds_up"))


@query("select * from (" + _priced("calibration", "[" + ", ".join(f"ln(2::double) / {h}" for h in HALF_LIVES) + "]")
       + f", lives as (select i, h::double as h from (select unnest(range(len(x))) as i, unnest(x) as h from (select {list(HALF_LIVES)} as x)))"
       + " select h as half_life_days, count(*) as n_rated, sum(n_fit_matches)::bigint as n_history, true as holds from priced join lives using (i) group by h)")
def calibrate_fits(spark, sf):
    """All candidates by real fits over the calibration seasons: the fixtures that each rates, their history, and whether what
    depends on the fits themselves lies where it must: priced fixtures, the paired ones and mean scores."""
    rated = written(study.candidate_rates(surrogate.matches(spark, sf)), "candidate-rates")
    counts = rated.groupBy("half_life_days").agg(F.count(F.lit(1)).alias("n_rated"), F.sum("n_fit_matches").alias("n_history"))
    holds = (F.col("n_all") <= F.col("n_rated")) & (F.col("n_all") > 0.95 * F.col("n_rated")) & (F.col("n_paired") <= F.col("n_all")) & (F.col("n_paired") > 0.9 * F.col("n_rated"))
    t = counts.join(study.candidate_table(rated), "half_life_days")
    return t.select("half_life_days", "n_rated", "n_history", (holds & F.col("mean_rps_all").between(0.15, 0.3) & F.col("mean_rps_paired").between(0.15, 0.3)).alias("holds"))


@query()
def cell_roi_intervals(spark, sf):
    """ROI of every cell and method with its bootstrap interval."""
    f, b = surrogate.forecasts(spark, sf), written(_books(spark, sf), "books")
    t = study.with_roi_intervals(cells.cell_means(cells.cell_rows(f, b)), f, b)
    return t.select(*CELL, "method", "n_bets", *[(F.round(c, 6) + 0.0).alias(c) for c in ("roi", "roi_low", "roi_high")])


def _interval(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, *[F.round(c, 6).alias(c) for c in ("point", "low", "high")], "n")


@query()
def stationary_bootstrap(spark, sf):
    bets = _selections(spark, sf).where("stake > 0")
    return _interval(bootstrap.stationary_bootstrap(bets.select(*CELL, "method", "kickoff", "seq", "place", "profit"), [*CELL, "method"], ["kickoff", "seq", "place"], "profit", 20260817), [*CELL, "method"])


def _margin_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return report.margin_pairs(*_spreads_and_margins(spark, sf)).withColumn("one", F.lit(1))


@query()
def bootstrap_correlation(spark, sf):
    return _interval(bootstrap.pair_bootstrap(_margin_pairs(spark, sf).select("one", *CELL, "mean_book_sum", "roi_spread"), ["one"], CELL, "mean_book_sum", "roi_spread", 1), ["one"])


@query()
def cluster_bootstrap_correlation(spark, sf):
    return _interval(bootstrap.cluster_bootstrap(_margin_pairs(spark, sf).select("one", *CELL, "mean_book_sum", "roi_spread"), ["one"], CELL, "mean_book_sum", "roi_spread", "book", 2), ["one"])


@query()
def bootstrap_mean_difference(spark, sf):
    pairs = report.market_pairs(cells.per_cell(_means(spark, sf)), "roi_spread").withColumn("one", F.lit(1))
    return _interval(bootstrap.mean_difference_bootstrap(pairs, ["one"], ["league", "book"], "one_x_two", "over_under", 3), ["one"])


@query()
def manifest_sha256(spark, sf):
    """Name and digest of each table's files, read by Spark."""
    return seasons.table_manifest(spark, sf)

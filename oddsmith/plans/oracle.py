"""SQL twins of the registered queries: common tables, each query's SQL, and how they are put together."""

from __future__ import annotations

import re

M = 8  # decimals of compared doubles

TABLES = {
    "matches": """
select o_orderkey as seq, o_orderpriority as league,
  lpad((year(o_orderdate) % 100)::varchar, 2, '0') || lpad(((year(o_orderdate) + 1) % 100)::varchar, 2, '0') as season,
  date_trunc('day', o_orderdate) + to_seconds((o_orderkey * 37) % 86400) as kickoff,
  'T' || (o_custkey % 20)::varchar as home, 'T' || ((o_custkey + 1 + o_orderkey % 19) % 20)::varchar as away,
  (case when h < 25 then 0 when h < 59 then 1 when h < 83 then 2 when h < 94 then 3 when h < 98 then 4 else 5 end)::bigint as home_goals,
  (case when a < 33 then 0 when a < 70 then 1 when a < 90 then 2 when a < 97 then 3 when a < 99 then 4 else 5 end)::bigint as away_goals
from (select *, (o_orderkey * 7919) % 100 as h, (o_orderkey * 104729) % 100 as a from orders)""",
    "filed": """
select *, case when seq % 5 = 0 then date_trunc('day', kickoff) else kickoff end as told, seq % 11 <> 0 and not (season like '97%' and (league like '4%' or league like '5%')) as usable
from matches""",
    "ranked": """
select l_orderkey, r, 5 + q as w, max(case when r = 1 then s % 7 end) over (partition by l_orderkey) as book_no, max(r) over (partition by l_orderkey) as n
from (select *, row_number() over (partition by l_orderkey order by l_linenumber) as r
      from (select l_orderkey, l_linenumber, max(l_quantity) as q, min(l_suppkey) as s from lineitem group by l_orderkey, l_linenumber)) where r <= 3""",
    "prices": """
select l_orderkey, r, book_no, market, substr(case market when '1X2' then 'HDA' else 'OU' end, r::int, 1) as outcome,
  sw / ((case when l_orderkey % 23 = 0 then 0.99::double else 1.02::double + 0.01::double * book_no + 0.01::double * (l_orderkey % 2) end) * w) as price
from (select *, '1X2' as market, sum(w) over (partition by l_orderkey) as sw from ranked where n >= 3
      union all select *, 'OU25', sum(w) over (partition by l_orderkey) from ranked where n >= 2 and r <= 2)
where not (l_orderkey % 17 = 0 and r = 1)""",
    "odds": """
select m.seq, m.league, m.season, m.kickoff, m.home, m.away, 'B' || book_no::varchar as book, market, period, outcome,
  case when period = 'open' then price * 1.02::double else price end as decimal
from prices p join matches m on p.l_orderkey = m.seq
join (values ('open'), ('close')) t(period) on period = 'close' or l_orderkey % 3 = 0""",
    "books": """
select seq, league, season, kickoff, home, away, book, market, prices, list_transform(prices, lambda d: 1 / d) as implied, list_sum(list_transform(prices, lambda d: 1 / d)) as book_sum
from (select seq, league, season, kickoff, home, away, book, market,
        case market when '1X2' then [max(decimal) filter (outcome = 'H'), max(decimal) filter (outcome = 'D'), max(decimal) filter (outcome = 'A')]
                    else [max(decimal) filter (outcome = 'O'), max(decimal) filter (outcome = 'U')] end as prices
      from odds where period = 'close' and decimal > 1 group by seq, league, season, kickoff, home, away, book, market)
where len(list_filter(prices, lambda d: d is null)) = 0""",
    "margined": "select * from books where book_sum > 1 + 1e-9",
    "rated": """
select *, 0.8::double + (substr(home, 2)::int % 10) / 10.0::double as lambda_home, 0.6::double + (substr(away, 2)::int % 10) / 10.0::double as lambda_away, -0.1::double as rho from matches""",
    "cells121": """
select seq, x, y, p / sum(p) over (partition by seq) as p from (
  select seq, x, y, exp(x * ln(lambda_home) - lambda_home - lgamma(x + 1)) * exp(y * ln(lambda_away) - lambda_away - lgamma(y + 1)) *
    case when x = 0 and y = 0 then 1 - lambda_home * lambda_away * rho when x = 0 and y = 1 then 1 + lambda_home * rho
         when x = 1 and y = 0 then 1 + lambda_away * rho when x = 1 and y = 1 then 1 - rho else 1 end as p
  from rated, (select unnest(range(11))::double as x), (select unnest(range(11))::double as y))""",
    "forecasts": """
select r.*, case when home_goals > away_goals then 0 when home_goals = away_goals then 1 else 2 end as outcome,
  p_home, p_draw, p_away, p_over25, 1 - p_over25 as p_under25
from rated r join (select seq, sum(p) filter (x > y) as p_home, sum(p) filter (x = y) as p_draw, sum(p) filter (x < y) as p_away, sum(p) filter (x + y > 2.5) as p_over25
                   from cells121 group by seq) using (seq)""",
    "power_k": """
select *, list_reduce(list_prepend({'lo': 1.0::double, 'hi': 64.0::double}, list_transform(range(80), lambda i: {'lo': 0.0::double, 'hi': 0.0::double})),
  lambda s, i: case when list_sum(list_transform(implied, lambda p: pow(p, (s.lo + s.hi) / 2))) > 1 then {'lo': (s.lo + s.hi) / 2, 'hi': s.hi} else {'lo': s.lo, 'hi': (s.lo + s.hi) / 2} end) as s from margined""",
    "shin_z": """
select *, list_reduce(list_prepend({'lo': 0.0::double, 'hi': 1 - 1e-12::double}, list_transform(range(80), lambda i: {'lo': 0.0::double, 'hi': 0.0::double})),
  lambda s, i: case when list_sum(list_transform(implied, lambda p: (sqrt(pow((s.lo + s.hi) / 2, 2) + 4 * (1 - (s.lo + s.hi) / 2) * p * p / book_sum) - (s.lo + s.hi) / 2) / (2 * (1 - (s.lo + s.hi) / 2)))) > 1
  then {'lo': (s.lo + s.hi) / 2, 'hi': s.hi} else {'lo': s.lo, 'hi': (s.lo + s.hi) / 2} end) as s from margined""",
    "ratio_c": """
select *, list_reduce(list_prepend({'lo': 1.0::double, 'hi': 4096.0::double}, list_transform(range(90), lambda i: {'lo': 0.0::double, 'hi': 0.0::double})),
  lambda s, i: case when list_sum(list_transform(implied, lambda p: p / ((s.lo + s.hi) / 2 * (1 - p) + p))) > 1 then {'lo': (s.lo + s.hi) / 2, 'hi': s.hi} else {'lo': s.lo, 'hi': (s.lo + s.hi) / 2} end) as s from margined""",
    "fair": """
select seq, book, market, league, season, kickoff, prices, implied, method, list_transform(raw, lambda x: x / list_sum(raw)) as fair from (
  select *, 'proportional' as method, implied as raw from margined
  union all by name select * exclude (s), 'power' as method, list_transform(implied, lambda p: pow(p, s.lo)) as raw from power_k
  union all by name select * exclude (s), 'shin' as method, list_transform(implied, lambda p: (sqrt(s.lo * s.lo + 4 * (1 - s.lo) * p * p / book_sum) - s.lo) / (2 * (1 - s.lo))) as raw from shin_z
  union all by name select * exclude (s), 'odds_ratio' as method, list_transform(implied, lambda p: p / (s.lo * (1 - p) + p)) as raw from ratio_c)""",
    "scored": """
select *, case market when '1X2' then (pow(model[1] - (realised = 0)::int, 2) + pow(model[3] - (realised = 2)::int, 2)) / 2 else pow(model[1] - (realised = 0)::int, 2) end as model_rps,
  case market when '1X2' then (pow(fair[1] - (realised = 0)::int, 2) + pow(fair[3] - (realised = 2)::int, 2)) / 2 else pow(fair[1] - (realised = 0)::int, 2) end as bench_rps
from (select f.*, case market when '1X2' then [p_home, p_draw, p_away] else [p_over25, p_under25] end as model,
        case market when '1X2' then outcome else (home_goals + away_goals <= 2)::int end as realised from fair f join forecasts c using (seq))""",
    "chosen": """
select *, case when chosen then 1.0 else 0.0 end as stake,
  case when chosen then case when won then price - 1 else -1 end else 0 end as profit from (
  select seq, league, book, market, method, place, model[place + 1] as model_p, fair[place + 1] as fair_p, prices[place + 1] as price, place = realised as won, model[place + 1] - fair[place + 1] > 0 as chosen
  from (select *, unnest(range(len(model))) as place from scored))""",
    "diffs": """
select league, book, market, method, row_number() over (partition by league, book, market, method order by kickoff, seq) as t, model_rps - bench_rps as d from scored""",
    "dm": """
select league, book, market, method, n, lag, mean, greatest(0, (g0 + 2 * coalesce(gk, 0)) / n) as variance from (
  select league, book, market, method, n, lag, mean, sum(c * c) as g0, sum(c * w) as gk from (
    select a.league, a.book, a.market, a.method, a.n, a.lag, a.mean, a.t, any_value(a.c) as c, sum(b.c * (1 - k / (a.lag + 1.0::double))) as w
    from (select *, d - mean as c from diffs join sizes using (league, book, market, method)) a
    left join (select *, d - mean as c from diffs join sizes using (league, book, market, method)) b
      on a.league = b.league and a.book = b.book and a.market = b.market and a.method = b.method and b.t > a.t and b.t <= a.t + a.lag
    left join (select unnest(range(1, 100)) as k) ks on k = b.t - a.t
    group by all) group by all)""",
    "sizes": """
select *, greatest(0, least(n - 1, floor(4 * pow(n / 100.0::double, 2.0::double / 9)))) as lag from (
  select league, book, market, method, count(*) as n, avg(d) as mean from diffs group by all) where n >= 2""",
    "results": """
select league, book, market, method, n_matches, model_rps, bench_rps, mean as rps_diff, mean / sqrt(variance / n) as dm_stat, n_bets, roi from (
  select league, book, market, method, count(*) as n_matches, avg(model_rps) as model_rps, avg(bench_rps) as bench_rps from scored group by all)
join dm using (league, book, market, method)
join (select league, book, market, method, count(*) filter (chosen) as n_bets, sum(profit) / nullif(sum(stake), 0) as roi from chosen group by all) using (league, book, market, method)""",
    "percell": """
select league, book, market, max(n_matches) as n_matches, max(roi) - min(roi) as roi_spread, max(bench_rps) - min(bench_rps) as rps_spread, min(roi) as roi_min, max(roi) as roi_max,
  max(roi) filter (method = 'proportional') as roi_proportional, max(roi) filter (method = 'shin') as roi_shin, max(n_bets) - min(n_bets) as n_bets_spread,
  coalesce(min(roi) < 0 and max(roi) > 0, false) as sign_flip,
  coalesce(sign(max(roi) filter (method = 'proportional')) <> sign(max(roi) filter (method = 'shin')), false) as sign_flip_prop_shin
from results group by all""",
    "margins": "select league, book, market, count(*) as n_books, avg(book_sum) as mean_book_sum, quantile_cont(book_sum, 0.5) as median_book_sum from books group by all",
    "coverage": """
select p.*, coalesce(n_matches, 0) as n_matches, coalesce(n_with_closing, 0) as n_with_closing from (
  select league, season, book, market, bool_or(period = 'open') as opening, bool_or(period = 'close') as closing from odds group by all) p
left join (select league, season, book, market, count(*) as n_with_closing from (
  select league, season, book, market, kickoff, home, away, count(distinct outcome) as k from odds where period = 'close' group by all)
  where k >= case market when '1X2' then 3 else 2 end group by all) c using (league, season, book, market)
left join (select league, season, count(*) as n_matches from matches group by all) s using (league, season)""",
    "losses": """
select event_type as series, row_number() over w as seq, (coalesce(value, 0) / 500) * (coalesce(value, 0) / 500) as a,
  coalesce(lag((coalesce(value, 0) / 500) * (coalesce(value, 0) / 500)) over w, 0.1) as b from events window w as (partition by event_type order by ts, event_id)""",
    "binaries": "select event_id as seq, least(1.0::double, coalesce(value, 0) / 400) as p, (event_id % 3 = 0)::int as o from events",
    "pvals": "select event_id as seq, (event_id * 7919 % 9973 + 1) / 10000.0::double as p, event_type from events",
    "weighted": "select *, exp(-rate * age) as w from (select *, ln(2::double) / 400 as rate, epoch_us(timestamp '2001-08-02' - kickoff) / 86400000000.0::double as age from rated) where age > 0",
}


def build(sql: str) -> str:
    """The query with the common tables that it uses, directly or through others, in order."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if name not in used and re.search(rf"\b(?:from|join)\s+{name}\b|,\s*{name}\b", text):
                need(TABLES[name])
                if name not in used:
                    used.append(name)

    need(sql)
    return ("with " + ",\n".join(f"{n} as ({TABLES[n]})" for n in used) + "\n" if used else "") + sql

"""The jobs as registered queries: each runs twice into one new folder and returns all that then stands there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import archive_intake, league_reports
from oddsmith.plans.catalogue import two_sided
from oddsmith.plans.oracle import M, build
from oddsmith.sources.seasons import MISSING
from oddsmith.sources.shared import new_folder


def job1_league_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "league-reports")
    for _ in range(2):
        league_reports.run(spark, sf_dir, folder)
    out = league_reports.read_back(spark, folder)
    shown = {"mean_book_sum": 7, "model_rps": 7, "bench_rps": 7, "rps_diff": 7, "dm_stat": 4, "dm_p": M, "q_value": 5, "roi": 6}
    return out.withColumns({c: F.round(c, k) + 0.0 for c, k in shown.items()})


def job2_archive_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archive-intake")
    for _ in range(2):
        archive_intake.run(spark, f"{sf_dir}/documents.parquet", folder, f"{folder}/checkpoint")
    texts, coverage = archive_intake.read_back(spark, folder)
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("shelf", "source", "lang")]
    counts = ["n_texts", "n_distinct", "n_problems"]
    return texts.alias("t").join(coverage.alias("c"), same, "left").select(
        *[f"t.{c}" for c in ("doc_id", "source", "lang", "n_bytes", "n_lines", "sha256", "problem", "shelf")], *[f"c.{c}" for c in counts], F.col("c.n_bytes").alias("bytes_covered"))


_RESULTS = """
select r.*, coalesce(n_arbitrage, 0) as n_arbitrage, n_seasons, mean_book_sum, P_VALUE as dm_p
from results r
left join (select league, book, market, count(*) as n_arbitrage from books where book_sum <= 1 + 1e-9 group by all) a using (league, book, market)
left join margins using (league, book, market)
left join (select league, book, market, count(distinct season) as n_seasons from coverage where closing and n_with_closing > 0 group by all) s using (league, book, market)
"""
_REPORTS = f"""
select book, market, method, n_matches, n_arbitrage, n_seasons, round(mean_book_sum, 7) + 0.0 as mean_book_sum, round(model_rps, 7) + 0.0 as model_rps,
  round(bench_rps, 7) + 0.0 as bench_rps, round(rps_diff, 7) + 0.0 as rps_diff, round(dm_stat, 4) + 0.0 as dm_stat, round(dm_p, {M}) + 0.0 as dm_p,
  round(q_value, 5) + 0.0 as q_value, q_value <= 0.1::double as discovery, n_bets, round(roi, 6) + 0.0 as roi, league
from (
  select *, least(1.0::double, min(dm_p * n / k) over (partition by method order by k desc rows unbounded preceding)) as q_value
  from (select *, row_number() over (partition by method order by dm_p) as k, count(*) over (partition by method) as n from ({_RESULTS})))
"""
_BLANK = ", ".join(f"'{w}'" for w in ("", *MISSING))
_INTAKE = f"""
with rows as (
  select doc_id, source, lang, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes,
         coalesce(len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))), 0)::int as n_lines, sha256(text) as sha256,
         case when text is null then 'missing' when trim(text, ' ') in ({_BLANK}) then 'blank' end as problem,
         case when source is null then 'none' else regexp_replace(substr(source, 1, 40), '[^0-9A-Za-z]', '_', 'g') || '-' || substr(md5(source), 1, 8) end as shelf
  from documents),
counts as (
  select source, lang, count(*)::bigint as n_texts, count(distinct sha256)::bigint as n_distinct, count(problem)::bigint as n_problems, sum(n_bytes)::bigint as bytes_covered
  from rows group by all)
select r.*, n_texts, n_distinct, n_problems, bytes_covered
from rows r join counts c on r.source is not distinct from c.source and r.lang is not distinct from c.lang
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_league_reports": job1_league_reports, "job2_archive_intake": job2_archive_intake}


def oracle_sql() -> dict[str, str]:
    return {"job1_league_reports": build(_REPORTS.replace("P_VALUE", two_sided("dm_stat"))), "job2_archive_intake": _INTAKE}

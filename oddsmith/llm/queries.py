"""The registered queries over the text tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import epsjoin, htmlmain, lexical, linededup, mixing, packing, pii, quality, simhash, tokenfiles, urltree, wordpiece
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), capacity=4096, end_id=1)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read(spark, sf_dir, "documents"), shingle=4, distance=4)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_verdicts(read(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents")).drop("mix_key")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract_main_text(read(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("score")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsjoin.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_file_index(read(spark, sf_dir, "documents"), end_id=2)


#: The rules of the query over urls, as (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.url_verdicts(read(spark, sf_dir, "pages"), URL_RULES)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def queries() -> dict[str, Query]:
    return {"op1_pack": op1_pack, "op2_simhash": op2_simhash, "op3_token_counts": op3_token_counts, "op4_line_dedup": op4_line_dedup, "op5_mix": op5_mix, "op6_pii": op6_pii, "op7_main_text": op7_main_text, "op8_quality": op8_quality, "op9_vectors": op9_vectors, "op10_token_files": op10_token_files, "op11_urls": op11_urls, "op12_search": op12_search}


def oracle_sql() -> dict[str, str]:
    return {"op5_mix": mixing.ORACLE, "op11_urls": urltree.oracle(URL_RULES), "op12_search": lexical.ORACLE}

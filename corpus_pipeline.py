"""Documents to packed training sequences: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes whole tables and whole texts. A null text counts as an empty one, a null source is a source, rows that
share a doc_id are documents of their own, and an empty table gives an empty one. All but the last stage return the columns
they got, whatever else these are called; the last returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oddsmith.llm import linededup, mixing, packing, quality, setjoin
from oddsmith.llm.common import materialize, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go: those of fewer than 20 words, so null and empty texts among them, those that
    repeat themselves, and those whose score lies below the threshold. Without labels only the rules judge."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or nearly so, go, and documents that this leaves empty."""
    return linededup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, Jaccard similarity of 0.8 or more. Of rows with both id
    and text in common one stays, and one of a group's rows without id beside the one that has one."""
    return setjoin.deduplicate(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place. The encoder and what it is sent at a time are held small, as executors
    still hold the memory of the stages before."""
    return packing.pack_documents(docs, most=40_000, chunk=500_000, batch_rows=500)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Fingerprints, ids and fitted ratios aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs

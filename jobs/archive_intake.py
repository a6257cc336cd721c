"""Take in what is new in a growing archive of texts: what arrived, whether it can be read, and what each source covers.

The archive is a folder of Parquet files (doc_id, text, lang, source; other columns are ignored) to which files are added. A file
stream with a checkpoint takes each file once. Written are

* `manifest`, a row for each text: its digest, bytes, lines and the problem that makes it unusable, partitioned by the
  batch that took it in and by shelf. A batch that is run again after a failure replaces its own partitions and no others.
* `coverage`, a row for each source and language: counts over all texts so far, partitioned by shelf. Only the shelves
  that got texts since their coverage was last written are read and replaced.

A shelf is a short name made of a source, safe as the name of a folder.

    python -m jobs.archive_intake --archive /data/documents.parquet --output /data/intake --checkpoint /data/intake-checkpoint
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, session, settings
from oddsmith.sources.seasons import clean_text, text_lines
from oddsmith.sources.shared import read_or_empty

NAME = "archive_intake"
ROW = "doc_id long, source string, lang string, n_bytes long, n_lines int, sha256 string, problem string"
MANIFEST = f"{ROW}, batch long, shelf string"
COVERAGE = "source string, lang string, n_texts long, n_distinct long, n_problems long, n_bytes long, upto_batch long, shelf string"


def shelf_of(source: Column) -> Column:
    """Up to 40 letters and digits of the source and eight digits of its digest; "none" for a null source."""
    short = F.regexp_replace(F.substring(source, 1, 40), "[^0-9A-Za-z]", "_")
    return F.when(source.isNull(), "none").otherwise(F.concat(short, F.lit("-"), F.substring(F.md5(source.cast("binary")), 1, 8)))


def manifest_rows(texts: DataFrame, shelf_by: str = "source") -> DataFrame:
    """A row for each text. Null text: no digest, problem "missing"; nothing but spaces, or a spelling that stands for a missing
    text: problem "blank". Null columns stay null, repeated rows stay."""
    text = F.col("text")
    problem = F.when(text.isNull(), "missing").when(clean_text(text) == "", "blank")
    lines = F.coalesce(F.size(text_lines(text)), F.lit(0))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    own = [F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", size.alias("n_bytes"), lines.alias("n_lines")]
    return texts.select(*own, F.sha2(text, 256).alias("sha256"), problem.alias("problem"), shelf_of(F.col(shelf_by)).alias("shelf"))


def coverage_rows(manifest: DataFrame) -> DataFrame:
    """Counts of each source and language; distinct texts are told apart by their digests."""
    digests = manifest.groupBy("shelf", "source", "lang", "sha256").agg(
        F.count(F.lit(1)).alias("n"), F.count("problem").alias("problems"), F.sum("n_bytes").alias("bytes"), F.max("batch").alias("batch"))
    return digests.groupBy("shelf", "source", "lang").agg(
        F.sum("n").alias("n_texts"), F.count("sha256").alias("n_distinct"), F.sum("problems").alias("n_problems"), F.sum("bytes").alias("n_bytes"),
        F.max("batch").alias("upto_batch"))


def _replace(df: DataFrame, path: str, *partitions: str) -> None:
    """Write df over its own partitions. Skewed partitions are split, small ones put together."""
    rows = df.hint("rebalance", *partitions)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def run(spark: SparkSession, archive: str, output: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Take in the files that the checkpoint doesn't know; the numbers of batches, of texts and of shelves written."""
    config = settings(NAME) | (config or {})
    wrote = {"batches": 0, "texts": 0, "shelves": 0}

    def take(rows: DataFrame, batch: int) -> None:
        _replace(manifest_rows(rows, config["shelf_by"]).withColumn("batch", F.lit(batch)), f"{output}/manifest", "batch", "shelf")
        n = read_or_empty(spark, f"{output}/manifest", MANIFEST).where(F.col("batch") == batch).count()  # from the files' footers
        wrote["batches"] += 1
        wrote["texts"] += n
        log.info("batch %d: read and wrote %d texts to %s/manifest", batch, n, output)

    schema = spark.read.parquet(archive).schema
    anything = archive if set(archive) & set("*?[{") else f"{archive[:-1]}[{archive[-1]}]"  # a pattern may also be a single file, a plain path only a folder
    # a file may have been written long before it came here
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).option("maxFileAge", "36500d")
    files = reader.parquet(anything)
    stream = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()

    manifest, coverage = (read_or_empty(spark, f"{output}/{n}", s) for n, s in (("manifest", MANIFEST), ("coverage", COVERAGE)))
    newest = manifest.groupBy("shelf").agg(F.max("batch").alias("newest"))  # of the folders' names, no file is read for it
    known = coverage.groupBy("shelf").agg(F.max("upto_batch").alias("known"))
    behind = newest.join(known, "shelf", "left").where("known is null or known < newest").select("shelf")
    wrote["shelves"] = behind.count()
    if wrote["shelves"]:
        _replace(coverage_rows(manifest.join(behind, "shelf", "left_semi")), f"{output}/coverage", "shelf")
    log.info("wrote the coverage of %d shelves to %s/coverage", wrote["shelves"], output)
    return wrote


def read_back(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, coverage) as they stand."""
    return read_or_empty(spark, f"{output}/manifest", MANIFEST), read_or_empty(spark, f"{output}/coverage", COVERAGE)


def main() -> None:
    args = argparse.ArgumentParser(prog="python -m jobs.archive_intake", description=__doc__.split("\n", 1)[0])
    for name, what in (("archive", "folder of Parquet files"), ("output", "folder of what is written"), ("checkpoint", "folder of the stream's checkpoint")):
        args.add_argument(f"--{name}", required=True, help=what)
    args.add_argument("--config", help="a JSON file that replaces settings")
    a = args.parse_args()
    with session(NAME) as spark:
        run(spark, a.archive, a.output, a.checkpoint, settings(NAME, a.config, spark))


if __name__ == "__main__":
    main()

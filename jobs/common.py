"""What the jobs share: settings, logging and a session for the command line."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("oddsmith.jobs")


def settings(name: str, path: str | None = None, spark: SparkSession | None = None) -> dict:
    """The settings file of a job: its own beside the job, or the one at path, which may be anywhere that Spark reads."""
    known = json.loads(Path(__file__).with_name(f"{name}.json").read_text())
    if path is None:
        return known
    text = spark.read.text(path, wholetext=True).first()
    own = json.loads(text[0] if text else "{}")
    if extra := set(own) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    return known | own


@contextmanager
def session(name: str) -> Iterator[SparkSession]:
    """A session for a command: made here, stopped here."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        yield spark
    finally:
        spark.stop()

"""Quality rules: exact text statistics, and a hashed n-gram log-likelihood ratio with a fitted threshold."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, lean, materialize

BUCKETS = 1 << 16
SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_BLANK = str.maketrans("", "", SPACES)


def repeated_window_words(ids: np.ndarray, size: int = 8) -> int:
    """Words that lie in a window of `size` words (a power of two) found twice or more; exact.

    Windows are ranked by doubling: equal ranks of two halves mean equal windows.
    """
    n = len(ids)
    if n <= size:
        return 0
    rank, width = ids.astype(np.int64), 1
    while width < size:
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        _, rank = np.unique(pair, return_inverse=True)
        width *= 2
        if int(rank.max()) + 1 == len(rank):
            return 0
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(twice)] += twice
    edge[size : size + len(twice)] -= twice
    return int((np.cumsum(edge[:n]) > 0).sum())


def base_statistics(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    repeats = 0
    if n > 8:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        if len(seen) < n:
            repeats = repeated_window_words(ids)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, n < 20 or 100 * repeats > 30 * n


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed features of a text: its words, its pairs of words, and the shapes of its words (letters' case, other marks)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    ends = [w[:1] + w[-3:] for w in raw.translate(_SHAPE).split()]
    shapes = np.fromiter(map(zlib.crc32, ends), np.uint64, len(words))
    one = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    two = ((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    form = (shapes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
    pair = ((shapes[:-1] * np.uint64(0xA24BAED4963EE407) + shapes[1:]) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(40)
    return (np.concatenate([one, two, form, pair]) % np.uint64(buckets)).astype(np.int64)


_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): feature counts over all documents, and over those with column trusted true."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                found = [ngram_buckets(t, buckets) for t in part["text"]]
                raw += np.bincount(np.concatenate(found), minlength=buckets)
                own = [x for x, trusted in zip(found, part["trusted"]) if trusted]
                if own:
                    target += np.bincount(np.concatenate(own), minlength=buckets)
        used = np.flatnonzero(raw)
        if len(used):
            yield pd.DataFrame({"bucket": used, "raw": raw[used], "target": target[used]})

    parts = docs.select("text", "trusted").mapInPandas(lean(run), "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> np.ndarray:
    """Per bucket: log of its smoothed share in the trusted target over that in the raw corpus. At most `buckets` rows
    reach the driver, whatever the input. Without trusted documents all ratios are zero."""
    rows = counts.toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.sum():
        return np.zeros(buckets)
    share = lambda c: (c + smoothing) / (c.sum() + smoothing * buckets)
    return np.log(share(target)) - np.log(share(raw))


def one_label_each(labels: DataFrame) -> DataFrame:
    """A row per labelled doc_id: the lower quality and the higher toxic of repeated labels; null labels don't count."""
    own = labels.where("doc_id is not null and quality is not null")
    return own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def fitted_threshold(scored: DataFrame, labels: DataFrame, step: float = 1 / 256, cost: float = 4.0) -> float:
    """The cut on the score with the least cost on labelled documents that pass the base rules.

    A good document below the cut costs `cost`, a poor one at or above it costs 1. Scores are counted in bins of width
    `step`, so what reaches the driver is bounded by the range of scores; of equal costs the lowest cut wins. Without
    labels of both kinds nothing is rejected.
    """
    own = scored.where("not base_failed").join(labels, "doc_id")
    bins = own.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.count(F.lit(1)).alias("n"))
    rows = bins.orderBy("bin").toPandas()
    good, poor = rows["good"].to_numpy(np.int64), (rows["n"] - rows["good"]).to_numpy(np.int64)
    if not good.sum() or not poor.sum():
        return float("-inf")
    costs = cost * np.r_[0, np.cumsum(good)] + poor.sum() - np.r_[0, np.cumsum(poor)]
    cut = int(costs.argmin())
    return float("-inf") if cut == 0 else (int(rows["bin"].iloc[cut - 1]) + 1) * step


def trusted_sample(label: DataFrame, most: int) -> DataFrame:
    """doc_id of at most `most` labelled documents of good quality that aren't toxic: those with the least hash."""
    own = label.where("quality > 0 and toxic = 0").select("doc_id")
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def text_score(text: str | None, ratio: np.ndarray) -> float:
    f = ngram_buckets(text, len(ratio))
    return float(ratio[f].mean()) if len(f) else 0.0


def fit_ratios(own: DataFrame, label: DataFrame, buckets: int, trusted_rows: int) -> np.ndarray:
    """Log ratios per bucket. The target is a bounded sample, whose ids (8 bytes each) may be broadcast; raw counts are
    over every document."""
    sample = materialize(trusted_sample(label, trusted_rows), "trusted")
    marked = own.join(F.broadcast(sample.withColumn("trusted", F.lit(True))), "doc_id", "left")
    return log_ratios(ngram_counts(marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")), buckets), buckets)


def scores(own: DataFrame, ratio: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BASE.split(", ")]
        for batch in batches:
            out = pd.DataFrame([base_statistics(t) for t in batch["text"]], columns=names)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            out["score"] = [text_score(t, ratio) for t in batch["text"]]
            yield out

    return materialize(own.mapInPandas(lean(run), f"doc_id long, {BASE}, score double"), "scored")


def quality_verdicts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = 32_768) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    The trusted target is labelled documents of good quality that aren't toxic, at most trusted_rows of them; the raw
    corpus is all of docs. The score is the mean log ratio of a text's hashed n-grams (words, pairs of words, word
    shapes and pairs of them). kept: the base rules pass and the score reaches the fitted threshold, which is the same
    for every document.

    Null text: no words, base_failed, not kept. Null doc_id: judged without a label. Repeated rows: a row each. Empty
    tables: no rows, and without labels the base rules decide alone. Other columns are ignored.
    """
    label = one_label_each(labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = scores(own, fit_ratios(own, label, buckets, trusted_rows))
    least = fitted_threshold(scored, label)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def keep_good(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = 32_768) -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with all their columns; each row is judged by its own text.

    Texts aren't shuffled: once the ratios and the threshold are known, each row is judged where it is read.
    """
    label = one_label_each(labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratio = fit_ratios(own, label, buckets, trusted_rows)
    least = fitted_threshold(scores(own, ratio), label)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = [not base_statistics(t)[-1] and text_score(t, ratio) >= least for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)

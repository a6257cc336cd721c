"""Token ids of a corpus in range-coded segments, in ascending document order, and their way back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, range_prefix, shuffle_partitions
from .rangecoder import BLOCK, NO_ID, read_segment, write_segment
from .tokens import encoder, public_path

VOCABULARY = "byte_bpe_50k.json"
AT_ONCE = 24_000_000  # characters that are encoded at a time; a longer text goes alone
SEGMENTS = "part int, place int, n_docs long, n_ids long, image binary"


def by_characters(batch: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """The rows of a batch in order, in runs whose texts have at most so many characters together, or of one row."""
    start = size = 0
    for i, text in enumerate(batch["text"]):
        own = len(text) if isinstance(text, str) else 0
        if i > start and size + own > most:
            yield batch.iloc[start:i]
            start, size = i, 0
        size += own
    if start < len(batch):
        yield batch.iloc[start:]


def by_ids(documents: Iterator[tuple[int | None, bytes]], most: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Documents in order, in runs of about so many ids. A run ends when what follows it has half as many, else it takes that in: a
    short segment costs nearly as much as a whole one."""
    held: list[tuple[int | None, bytes]] = []
    size = cut = upto = 0
    for document in documents:
        held.append(document)
        size += len(document[1]) // 4
        if cut and size - upto >= most // 2:
            yield held[:cut]
            held, size, cut = held[cut:], size - upto, 0
        if not cut and size >= most:
            cut, upto = len(held), size
    if held:
        yield held


def token_segments(docs: DataFrame, end_id: int = 2, path: str | None = None, block: int = BLOCK, segment_ids: int = 3_000_000) -> DataFrame:
    """Segments of about segment_ids ids: part and place order them, image is the segment's bytes, as in a file.

    Documents are range-partitioned and sorted by doc_id (nulls first, ties by text); each partition is encoded in one
    pass with memory for one segment. The table is written to shared storage, so lost executors cost nothing.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode_ids, end = encoder(path or public_path(VOCABULARY), chunk=2 * AT_ONCE), np.array([end_id], "<u4").tobytes()

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for rows in by_characters(batch, AT_ONCE):
                    for doc, ids in zip(rows["doc_id"], encode_ids(rows["text"])):
                        yield None if pd.isna(doc) else int(doc), ids + end

        for place, run in enumerate(by_ids(documents(), segment_ids)):
            doc_ids, ids = map(list, zip(*run))
            size = sum(map(len, ids)) // 4
            yield pd.DataFrame({"part": [part], "place": [place], "n_docs": [len(ids)], "n_ids": [size], "image": [write_segment(doc_ids, ids, block)]})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = own.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return materialize(dealt.mapInPandas(lean(encode), SEGMENTS), "token_segments")


def read_documents(segments: DataFrame) -> DataFrame:
    """One row per document from the segments' bytes alone: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers). A damaged segment fails the job."""
    narrow = range_prefix(segments.select("part", "place", "n_ids"), [F.col("part").asc(), F.col("place").asc()], {"upto": "n_ids"})
    starts = narrow.select("part", "place", (F.col("upto") - F.col("n_ids")).alias("first"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, first in zip(batch["image"], batch["first"]):
                documents, ids = read_segment(image)
                n = documents["ids"].astype(np.int64)
                ends = np.cumsum(n)
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                doc = pd.array(documents["doc_id"], "Int64")
                doc[documents["doc_id"] == NO_ID] = pd.NA
                yield pd.DataFrame({"doc_id": doc, "start": ends - n + int(first), "n_tokens": n, "ids_crc32": crc})

    rows = segments.join(starts, ["part", "place"]).select("image", "first")
    return rows.mapInPandas(lean(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_index(docs: DataFrame, **options: int) -> DataFrame:
    """Write the ids of all documents as segments, read them back and return read_documents of them.

    Null or empty text: the end id alone. Null doc_id: first. Repeated doc_id: a row each, ties by the text's hash. No
    rows: no rows. Ids must be below 65536. Texts are encoded whole; other columns are ignored.
    """
    return read_documents(token_segments(docs, **options))

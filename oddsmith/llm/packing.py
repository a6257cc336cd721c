"""Sum-of-squares packing of tokenised documents into sequences of a fixed number of ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, give_back, lean, materialize
from .tokens import CHUNK, MOST, encoder, public_path

VOCABULARY = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each size (1 to capacity), taken in falling order.

    Counts of open bins are held per residual gap. An item goes to the gap where moving one bin to its new gap leaves
    the sum of squared counts smallest; among equal sums to the smallest gap. A bin is opened only where none fits, as
    fewer sequences are wanted. An item costs a few vector operations over the gaps, whatever the number of bins.
    """
    n = np.zeros(capacity + 1, np.int64)
    doubled = np.zeros(capacity + 1, np.int64)
    doubled[0] = -1  # a filled bin leaves the counts: its square isn't added
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    none = np.int64(1) << 60
    bins, offsets, opened = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if s < capacity:
            change = np.where(n[s:capacity] > 0, doubled[: capacity - s] - doubled[s:capacity], none)
            j = int(change.argmin())
            gap = s + j if change[j] < none else capacity
        else:
            gap = capacity
        if gap == capacity:
            b, opened = opened, opened + 1
        else:
            b = open_bins[gap].pop()
            n[gap] -= 1
            doubled[gap] -= 2
        if gap > s:
            open_bins[gap - s].append(b)
            n[gap - s] += 1
            doubled[gap - s] += 2
        bins[i], offsets[i] = b, capacity - gap
    return bins, offsets


def tokenised_pieces(docs: DataFrame, capacity: int, end_id: int, path: str | None, most: int = MOST, chunk: int = CHUNK, trim: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document; only longer documents are cut.
    trim: freed memory goes back to the system after each batch, not only at a partition's end."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path or public_path(VOCABULARY), most, chunk)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], encode(batch["text"])):
                ids += end
                doc = None if pd.isna(doc) else int(doc)
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[a : a + 4 * capacity]
                    rows.append((doc, k, a // 4, len(own) // 4, zlib.crc32(own)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})
            if trim:
                del batch, rows, out
                give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(lean(cut), PIECES)


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None, group_rows: int = 65_536, most: int = MOST, chunk: int = CHUNK, batch_rows: int | None = None) -> DataFrame:
    """Pack all documents (doc_id, text; other columns are ignored) into as few sequences as the method finds.

    Returns one row per piece: doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32,
    sequence_id, offset (place in the sequence, gapless from 0).

    Null or empty text: the end id alone, a piece of length 1. Null doc_id: kept as null. Repeated rows: each is packed.
    Ties: sizes are taken in falling order, equal ones by hash, doc_id and piece, so reruns agree. No rows: no rows.

    Pieces are dealt by hash to groups of about group_rows; each group is packed on its own in one task, so memory
    and time of a task stay bounded while the number of groups follows the input. A group leaves at most a few
    sequences partly filled, which is less than one in ten thousand of its sequences.

    most and chunk bound the encoder's memory, see WordCachedEncoder, and batch_rows that of the texts a worker is sent at a
    time (None: the session's setting): less of any takes more time and gives the same rows.
    """
    with arrow_batches(docs.sparkSession, batch_rows):
        pieces = materialize(tokenised_pieces(docs, capacity, end_id, path, most, chunk, bool(batch_rows)), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["order", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, df["offset"] = place(df["length"].to_numpy(np.int64), capacity)
        df["sequence_id"] = bins + (df["pack_group"].to_numpy(np.int64) << 32)
        return df[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    dealt = pieces.withColumn("order", order).withColumn("pack_group", F.pmod("order", F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(pack, PACKED)

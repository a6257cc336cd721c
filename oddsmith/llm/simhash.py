"""SimHash fingerprints and near-duplicate groups by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, lean, materialize

BITS = 64


def shingle_digests(text: str | None, shingle: int = 4) -> bytes:
    """8 bytes for each word shingle in turn; one for a text of fewer words, none for a text without."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= shingle:
        return digest(joined, 42) if n else b""
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *[e + 1 for e in ends[: n - shingle]]]
    return b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])])


def text_fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if set in over half the hashes of the word shingles."""
    return majority(np.frombuffer(shingle_digests(text, shingle), np.uint8).reshape(-1, 8))


def majority(digests: np.ndarray) -> int:
    """Bitwise majority of big-endian 8-byte digests, strict."""
    n = len(digests)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        counts += np.unpackbits(digests[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([text_fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fp})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(lean(run), "doc_id long, fp long")


class Covering:
    """Anchors for one segment of the fingerprint: codewords of a Hamming code of length 2^m - 1 and radius 1, times
    all words of the segment's other bits.

    Every word lies within radius 1 of an anchor, its home. If two words differ in at most `within` bits, each lies
    within 1 + within of the other's home, so a word that is replicated to all anchors in that range meets it there.
    """

    def __init__(self, low: int, width: int, m: int, within: int):
        self.low, self.width, self.m, self.within = low, width, m, within
        self.n = (1 << m) - 1
        reach = 1 + within
        coded = [(0, 0)] + [(1 << i, 1) for i in range(self.n)]
        for d in range(2, reach + 1):
            coded += [(x | 1 << i, d) for x, e in coded if e == d - 1 for i in range(x.bit_length(), self.n)]
        spare = [(0, 0)]
        for i in range(width - self.n):
            spare += [(x | 1 << i, e + 1) for x, e in spare if e < reach]
        by: dict[int, list[tuple[int, int]]] = {}
        for x, d in coded:
            by.setdefault(self._syndrome_of(x), []).append((x, d))
        # for each syndrome the changes that lead to a codeword, crossed with changes of the spare bits
        self.moves = [np.array(sorted({a | b << self.n for a, d in by.get(s, []) for b, e in spare if d + e <= reach}), dtype=np.int64) for s in range(1 << m)]

    def _syndrome_of(self, x: int) -> int:
        s = 0
        for i in range(self.n):
            if x >> i & 1:
                s ^= i + 1
        return s

    def segment(self, fp: np.ndarray) -> np.ndarray:
        return ((fp >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def syndrome(self, seg: np.ndarray) -> np.ndarray:
        s = np.zeros(len(seg), np.int64)
        for i in range(self.n):
            s ^= ((seg >> i) & 1) * (i + 1)
        return s

    def homes(self, fp: np.ndarray) -> np.ndarray:
        seg = self.segment(fp)
        s = self.syndrome(seg)
        return seg ^ np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and anchors of all replicas."""
        seg = self.segment(fp)
        s = self.syndrome(seg)
        rows, at = [], []
        for k in np.unique(s):
            own = np.flatnonzero(s == k)
            at.append((seg[own, None] ^ self.moves[k][None, :]).ravel())
            rows.append(np.repeat(own, len(self.moves[k])))
        return np.concatenate(rows), np.concatenate(at)


def coverings(distance: int, segments: int) -> list[Covering]:
    """Segments of the 64 bits: within one of them two linked fingerprints differ in at most distance // segments bits."""
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        m = max(k for k in range(1, 6) if (1 << k) - 1 <= b - a)
        out.append(Covering(a, b - a, m, distance // segments))
    return out


def links_in_anchor(fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked among distinct fingerprints of an anchor, at most one for each fingerprint.

    A search from each home goes only to what it has not yet reached, so a dense group costs about its size and no
    pair is listed. Links between two replicas are left to the anchor that is home to one of them.
    """
    n = len(fp)
    left = np.arange(n)
    a, b = [], []
    todo = home.copy()
    for seed in np.flatnonzero(home):
        if not todo[seed]:
            continue
        todo[seed] = False
        left = left[left != seed]
        stack = [int(seed)]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= distance
            # two replicas need not be compared here
            if not home[x]:
                near &= home[left]
            hit = left[near]
            if len(hit):
                left = left[~near]
                a.append(np.full(len(hit), fp[seed]))
                b.append(fp[hit])
                todo[hit] = False
                stack.extend(hit.tolist())
    none = np.empty(0, fp.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def fingerprint_links(distinct: DataFrame, distance: int = 4, segments: int = 3, part_rows: int = 20_000) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that keep all components of the graph of links.

    An anchor with more than part_rows rows is split: its rows are dealt to parts by hash, and each pair of parts is a
    unit of work of its own, so that a task's memory is bounded for any number of close fingerprints.
    """
    spark = distinct.sparkSession

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cover = coverings(distance, segments)
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                fp = batch["fp"].to_numpy(np.int64)[at : at + 20_000].view(np.uint64)
                for k, c in enumerate(cover):
                    rows, anchor = c.anchors(fp)
                    yield pd.DataFrame({"anchor": anchor | k << 32, "fp": fp[rows].view(np.int64), "home": anchor == c.homes(fp)[rows]})

    replicas = distinct.select("fp").mapInPandas(lean(replicate), "anchor long, fp long, home boolean")
    counts = replicas.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows)
    large = materialize(counts.select("anchor", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")), "large")
    if large.isEmpty():
        units = replicas.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        # rows of a large anchor go to each unit of work (i, j), i <= j, that holds their part
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        units = (
            replicas.join(large, "anchor", "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("anchor", "fp", "home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        )
    schema = "u long, v long"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches of a partition that is sorted by unit; a unit may span batches."""
        held: list[pd.DataFrame] = []

        def work(df: pd.DataFrame) -> pd.DataFrame:
            key = df[["anchor", "i", "j"]].to_numpy()
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            fp, home = df["fp"].to_numpy(np.int64).view(np.uint64), df["home"].to_numpy(bool)
            us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for a, b in zip(cut, [*cut[1:], len(df)]):
                if b - a > 1 and home[a:b].any():
                    u, v = links_in_anchor(fp[a:b], home[a:b], distance)
                    us.append(u)
                    vs.append(v)
            return pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)}).drop_duplicates()

        for batch in batches:
            if not len(batch):
                continue
            df = pd.concat([*held, batch], ignore_index=True) if held else batch
            last = df[["anchor", "i", "j"]].to_numpy()
            same = (last == last[-1]).all(axis=1)
            keep = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if keep:
                yield work(df.iloc[:keep])
            held = [df.iloc[keep:]]
        if held:
            yield work(held[0])

    spread = units.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", F.desc("home"), "fp")
    edges = materialize(spread.mapInPandas(lean(compare), schema).distinct(), "links")
    discard(large)
    return edges


def near_duplicate_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links).

    Documents link where their fingerprints differ in at most `distance` bits; equal fingerprints are held once, so
    copies cost nothing in the search. Null or blank text: fingerprint zero, linked like any other. Repeated doc_id: a
    row each. Null doc_id: kept; it never is a component_id unless its whole component has null ids. No rows: no rows.
    Columns besides doc_id and text are ignored.
    """
    own = materialize(fingerprints(docs, shingle), "fingerprints")
    per = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    edges = fingerprint_links(per, distance, segments)
    labels = connected_components(edges).withColumnRenamed("node", "fp")
    labelled = per.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = materialize(labelled.join(least, "component").select("fp", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(by_fp, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, **options: int) -> DataFrame:
    """Keep the document with the least doc_id of each near-duplicate group; all columns stay.

    Of rows with one doc_id, and of rows without, the group keeps all that carry the kept id; rows with a null
    doc_id are kept as they cannot be told apart.
    """
    groups = near_duplicate_groups(docs, **options)
    away = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(away, "doc_id", "left_anti")

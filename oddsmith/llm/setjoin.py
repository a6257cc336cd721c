"""Near copies by the Jaccard similarity of their word shingles: SimHash links are verified first, an exact prefix join finds the rest.

A fingerprint of 64 bits can't decide a similarity of 0.8: such pairs differ in about 10 bits, with a deviation of 3. The
prefix join is complete: with the shingles of each document in one global order, two sets of at least that similarity
share a shingle among the first n - ceil(least * n) + 1 of each. Any order is right; common shingles come last, so that
few documents meet at one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, lean, materialize, release
from .simhash import fingerprint_links, majority, shingle_digests


SKETCH = 256  # parts of a set's sketch


def _unique(raw: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(raw, np.int64))


def _ratio(least: float) -> tuple[int, int]:
    f = Fraction(least).limit_denominator(1000)
    return f.numerator, f.denominator


def prefix(own: np.ndarray, common: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """The shingles of a set that one of any similar set must be among, rare ones first. common is sorted, weight its counts."""
    p, q = _ratio(least)
    n = len(own)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.lexsort((own, np.where(common[at] == own, weight[at], 0)))]
    return own[: n - -(-p * n // q) + 1] if n else own


def common_shingles(docs: DataFrame, shingle: int, sample: int = 10_000, at_least: int = 4, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur often in a sample of documents, sorted, with their counts. They only set the order of the join."""
    share = max(0.02, min(1.0, sample / max(1, docs.count())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"key": _unique(shingle_digests(text, shingle))})

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(10_000)) < int(share * 10_000)).select("text")
    counts = some.mapInPandas(lean(run), "key long").groupBy("key").count().where(F.col("count") >= at_least)
    rows = counts.orderBy(F.desc("count"), "key").limit(most).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(sid, items): the sorted shingles of each text, 8 bytes each; sid is the hash of the set."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for text in (batch["text"].iloc[i : i + 256] for batch in batches for i in range(0, len(batch), 256)):
            own = [_unique(shingle_digests(t, shingle)).tobytes() for t in text]
            yield pd.DataFrame({"sid": np.array([xxhash.xxh64_intdigest(s) for s in own], np.uint64).view(np.int64), "items": own})

    return docs.select("text").mapInPandas(lean(run), "sid long, items binary")


def text_key() -> Column:
    """Tells the texts of rows with one doc_id apart; "" for a null text."""
    return F.coalesce(F.md5("text"), F.lit(""))


def _outlines(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(doc_id, text_key, sid, n, fp, sketch, keys): a document's set by its hash and size, its fingerprint, the sizes of the set's
    parts by hash (up to 255) and its prefix."""
    import xxhash

    common, weight = common_shingles(docs, shingle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[i : i + 1000] for b in batches for i in range(0, len(b), 1000)):
            sid, n, fp, sketch, keys = [], [], [], [], []
            for text in batch["text"]:
                raw = shingle_digests(text, shingle)
                own = _unique(raw)
                sid.append(xxhash.xxh64_intdigest(own.tobytes()))
                n.append(len(own))
                fp.append(majority(np.frombuffer(raw, np.uint8).reshape(-1, 8)))
                sketch.append(np.minimum(np.bincount(own & (SKETCH - 1), minlength=SKETCH), 255).astype(np.uint8).tobytes())
                keys.append(prefix(own, common, weight, least))
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_key": batch["text_key"], "sid": signed(sid), "n": np.array(n, np.int32), "fp": signed(fp), "sketch": sketch, "keys": keys})

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text").mapInPandas(lean(run), "doc_id long, text_key string, sid long, n int, fp long, sketch binary, keys array<long>")


def _similar_sizes(a: str, b: str, least: float) -> Column:
    p, q = _ratio(least)
    return (F.col(a) * q >= F.col(b) * p) & (F.col(b) * q >= F.col(a) * p)


def possible(pairs: DataFrame, per: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sketches allow the similarity: common shingles are at most the lesser sizes of all parts.

    A part of 255 or more counts as of any size, so no similar pair is lost.
    """
    p, q = _ratio(least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                own = batch.iloc[i : i + 1000]
                a, b = (np.frombuffer(b"".join(own[c]), np.uint8).reshape(-1, SKETCH) for c in ("a", "b"))
                low = np.minimum(a, b)
                both = np.where((low == 255).any(axis=1), own[["m", "n"]].min(axis=1), low.sum(axis=1, dtype=np.int64))
                yield own.loc[both * (p + q) >= (own["m"] + own["n"]) * p, ["u", "v"]]

    side = per.select("sid", "n", "sketch")
    rows = pairs.join(side.toDF("u", "m", "a"), "u").join(side.toDF("v", "n", "b"), "v").where(_similar_sizes("m", "n", least))
    return rows.mapInPandas(lean(run), "u long, v long")


def involved_sets(involved: DataFrame, docs: DataFrame, per: DataFrame, shingle: int) -> DataFrame:
    """(sid, items) of the sets named, from the text of one document each."""
    ids = materialize(per.join(involved, "sid").where("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct(), "ids")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = own.join(ids, "doc_id", "left_semi").union(own.where("doc_id is null"))
    sets = materialize(_sets(texts, shingle).join(involved, "sid", "left_semi").dropDuplicates(["sid"]), "sets")
    discard(ids)
    return sets


def verified(pairs: DataFrame, docs: DataFrame, per: DataFrame, shingle: int, least: float, part: int = 1000) -> DataFrame:
    """The pairs (u, v) whose sets have at least the similarity, from the texts of the documents involved.

    A pair goes to the end that has more pairs: that end's set is read once, and the others pass by it one at a time. An end
    with more than `part` pairs is dealt to several tasks.
    """
    p, q = _ratio(least)
    involved = materialize(pairs.select(F.col("u").alias("sid")).union(pairs.select("v")).groupBy("sid").agg(F.count(F.lit(1)).alias("c")), "involved")
    sets = involved_sets(involved.select("sid"), docs, per, shingle)
    degree = involved.select("sid", "c")
    turned = pairs.join(degree.toDF("u", "m"), "u").join(degree.toDF("v", "n"), "v")
    more = F.col("m") >= F.col("n")
    turned = turned.select(F.when(more, F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(more, F.col("v")).otherwise(F.col("u")).alias("sid"), F.greatest("m", "n").alias("c"))
    turned = materialize(turned.select("hub", F.pmod(F.xxhash64("sid"), F.ceil(F.col("c") / part)).cast("int").alias("part"), "sid"), "turned")
    members = turned.join(sets, "sid").withColumn("head", F.lit(False))
    heads = turned.select("hub", "part").distinct().join(sets.withColumnRenamed("sid", "hub"), "hub").withColumn("sid", F.col("hub")).withColumn("head", F.lit(True))
    rows = members.unionByName(heads).repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("head"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = np.empty(0, np.int64)
        for batch in batches:
            hit = np.zeros(len(batch), bool)
            for i, (first, items) in enumerate(zip(batch["head"], batch["items"])):
                own = np.frombuffer(items, np.int64)
                if first:
                    head = own
                else:
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    hit[i] = both * (p + q) >= (len(head) + len(own)) * p
            yield pd.DataFrame({"u": batch["hub"][hit], "v": batch["sid"][hit]})

    edges = materialize(rows.mapInPandas(lean(compare), "u long, v long"), "alike")
    for old in (involved, sets, turned):
        discard(old)
    return edges


def pairs_in_units(unit: np.ndarray, size: np.ndarray, sketch: np.ndarray, component: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one unit, not of one component, whose sizes and sketches allow the similarity. Rows of a unit lie together.

    side: 0 for all rows of a unit that is compared with itself; 1 and 2 where only rows of different sides are compared.
    All pairs at one distance are compared at a time, over all units.
    """
    p, q = _ratio(least)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, len(unit)):
        i = np.flatnonzero(unit[d:] == unit[:-d])
        if not len(i):
            break
        j = i + d
        fits = (component[i] != component[j]) & ((side[i] != side[j]) | (side[i] == 0)) & (size[i] * q >= size[j] * p) & (size[j] * q >= size[i] * p)
        i, j = i[fits], j[fits]
        for at in range(0, len(i), 4096):
            a, b = i[at : at + 4096], j[at : at + 4096]
            low = np.minimum(sketch[a], sketch[b])
            both = np.where((low == 255).any(axis=1), np.minimum(size[a], size[b]), low.sum(axis=1, dtype=np.int64))
            hit = both * (p + q) >= (size[a] + size[b]) * p
            left.append(a[hit])
            right.append(b[hit])
    return np.concatenate(left), np.concatenate(right)


def apart_pairs(rows: DataFrame, per: DataFrame, least: float, part_rows: int = 4000) -> DataFrame:
    """(u, v): sets of different components that share a prefix shingle and whose sketches allow the similarity; rows: key,
    sid, component.

    The sets at a key form a unit under the least sid among them, and keys with the same least one share their unit, so
    every pair that shares a key meets in a unit, and a group of many copies is one unit rather than one for each
    shingle. Sketches are compared inside the unit; only pairs that pass are listed. A unit of more than part_rows sets is
    dealt to parts, and each pair of parts is a unit of work of its own, which bounds a task's memory.
    """
    hubs = rows.groupBy("key").agg(F.min("sid").alias("hub"))
    members = materialize(rows.join(hubs, "key").select("hub", "sid", "component").distinct(), "members")
    parts = members.groupBy("hub").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hub", F.ceil(F.col("c") / part_rows).cast("int").alias("parts"))
    dealt = members.join(parts, "hub").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("hub", "sid", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = dealt.withColumn("side", F.when(F.col("i") == F.col("j"), 0).when(F.col("own") == F.col("i"), 1).otherwise(2))
    units = dealt.join(per.select("sid", "n", "sketch"), "sid").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "sid")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def work(df: pd.DataFrame) -> pd.DataFrame:
            key = df[["hub", "i", "j"]].to_numpy()
            unit = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
            sketch = np.frombuffer(b"".join(df["sketch"]), np.uint8).reshape(-1, SKETCH)
            sid = df["sid"].to_numpy(np.int64)
            a, b = pairs_in_units(unit, df["n"].to_numpy(np.int64), sketch, df["component"].to_numpy(np.int64), df["side"].to_numpy(), least)
            return pd.DataFrame({"u": np.minimum(sid[a], sid[b]), "v": np.maximum(sid[a], sid[b])}).drop_duplicates()

        for batch in batches:
            if not len(batch):
                continue
            df = pd.concat([*held, batch], ignore_index=True) if held else batch
            last = (df[["hub", "i", "j"]].to_numpy() == df[["hub", "i", "j"]].iloc[-1].to_numpy()).all(axis=1)
            keep = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if keep:
                yield work(df.iloc[:keep])
            held = [df.iloc[keep:]]
        if held:
            yield work(held[0])

    found = materialize(units.mapInPandas(lean(compare), "u long, v long").distinct(), "apart")
    discard(members)
    return found


def _ordered(u: str, v: str) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def similar_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id and component_id, see keyed_groups."""
    return keyed_groups(docs, shingle, least).select("doc_id", "component_id")


def keyed_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, text_key, component (its group) and component_id, the least doc_id reachable over pairs of at least that similarity.

    Shingles are those of the fingerprints: `shingle` words in lower case, or all words of a shorter text. Equal sets are
    held once; texts without words are equal. Null doc_id: never a component_id unless its whole component has null ids.

    First each set is compared with the least one it shares a prefix shingle or a SimHash group with. What that joins
    isn't compared again, so a large group of near copies costs about its size; sets that share a prefix shingle and are
    still apart are then compared in bounded units.
    """
    spark = docs.sparkSession
    outlines = materialize(_outlines(docs, shingle, least), "outlines")
    own = materialize(outlines.select("doc_id", "text_key", "sid"), "own")
    per = outlines.groupBy("sid").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "fp", "sketch", "keys")])
    whole = materialize(per, "whole")
    discard(outlines)
    release(spark)
    per = materialize(whole.drop("keys"), "distinct")
    keyed = materialize(whole.select("sid", "n", F.posexplode("keys").alias("pos", "key")), "keyed")
    discard(whole)
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "shared")
    release(spark)
    rows = materialize(keyed.join(shared, "key"), "meeting")
    discard(keyed)
    discard(shared)
    release(spark)

    labels = connected_components(fingerprint_links(per.select("fp").distinct()))
    close = per.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("sid", F.coalesce("component", "fp").alias("g"))
    hubs = close.groupBy("g").agg(F.min("sid").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    stars = rows.join(rows.groupBy("key").agg(F.min("sid").alias("hub")), "key").select("sid", "hub")
    stars = stars.union(close.join(hubs, "g").select("sid", "hub")).where("sid <> hub").select(*_ordered("sid", "hub")).distinct()
    stars = materialize(stars, "stars")
    release(spark)
    first = verified(materialize(possible(stars, per, least), "possible"), docs, per, shingle, least)
    release(spark)

    groups = connected_components(first).toDF("sid", "component")
    met = rows
    rows = rows.join(groups, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    apart = rows.groupBy("key").agg((F.min("component") < F.max("component")).alias("apart")).where("apart").select("key")
    pairs = apart_pairs(rows.join(apart, "key"), per, least).join(stars, ["u", "v"], "left_anti")
    second = verified(materialize(pairs, "pairs"), docs, per, shingle, least)

    labels = connected_components(first.union(second)).toDF("sid", "component")
    known = per.select("sid", "first_id").join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    known = materialize(known, "components")
    least_id = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = known.join(least_id, "component").select("sid", "component", "component_id")
    out = materialize(own.join(named, "sid").select("doc_id", "text_key", "component", "component_id"), "groups")
    for old in (own, per, met, stars, first, second, known):
        discard(old)
    return out


def deduplicate(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Keep one document of each group: the one with the least doc_id, of equal ids the one whose text has the least digest.

    All columns stay. Rows with one id and other texts are judged each by its own text; of rows that have both id and text in
    common one stays, that of the least hash over all columns. Rows with a null doc_id stay beside those that have one, as
    nothing names them, but of a group's rows without id one stays as well.
    """
    same = F.col("doc_id").eqNullSafe(F.col("_oddsmith_id")) & (text_key() == F.col("_oddsmith_text"))
    named = lambda keys: keys.select(F.col("doc_id").alias("_oddsmith_id"), F.col("text_key").alias("_oddsmith_text"))
    groups = keyed_groups(docs, shingle, least).withColumn("unnamed", F.col("doc_id").isNull())
    kept = groups.groupBy("component", "unnamed").agg(F.min(F.struct("doc_id", "text_key")).alias("kept"))
    judged = groups.join(kept, ["component", "unnamed"]).withColumn("stays", F.struct("doc_id", "text_key").eqNullSafe(F.col("kept")))
    rest = docs.join(named(judged.where("not stays").select("doc_id", "text_key").distinct()), same, "left_anti")
    again = judged.where("stays").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    again = materialize(named(again), "again")
    if again.isEmpty():
        return rest
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = F.xxhash64(*[c for c, f in zip(columns, docs.schema) if "map<" not in f.dataType.simpleString()])
    copies = rest.join(again, same).groupBy("_oddsmith_id", "_oddsmith_text").agg(F.min_by(F.struct(*columns), hashed).alias("_oddsmith_row"))
    return rest.join(again, same, "left_anti").unionByName(copies.select("_oddsmith_row.*"))

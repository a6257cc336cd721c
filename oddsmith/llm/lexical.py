"""Ranked lexical search over a two-level quantised index.

The index cuts the documents into blocks. A row of it is one term in one block: the places of the documents that hold the
term, for each an impact of one byte (level one) and the exact number of occurrences (level two). An impact is what an
occurrence is worth whatever the term's weight; its byte is rounded upwards, so bytes times weights bound a score from
above, and one step less from below. A search sums level one alone, takes the k-th largest lower bound over all blocks,
and scores with exact integers every document whose upper bound reaches it, from level two of the blocks that hold one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, materialize, range_prefix

#: A term's characters, and the letters whose case is folded.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STEP = 4000  # an impact is below 1,000,000, so its byte is at most 250
BLOCK_BYTES = 16 << 20
BLOCK_DOCS = 32_768
BATCH_TERMS = 200_000
INDEX = "block long, term string, places array<int>, impacts binary, counts array<int>, doc_ids array<long>, lengths array<long>"
FIELDS = [("block", pa.int64()), ("term", pa.string()), ("places", pa.list_(pa.int32())), ("impacts", pa.binary()), ("counts", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]


class Index(NamedTuple):
    """rows: a row for each term of each block, and one without a term that has the block's doc_ids and lengths."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def _fold() -> np.ndarray:
    """For each byte of UTF-8 text what stands for it in a term, 0 outside terms."""
    to = np.zeros(256, np.uint8)
    to[128:] = np.arange(128, 256)
    for first, last in (("0", "9"), ("a", "z")):
        to[ord(first) : ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    to[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return to


def _doc_scale(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 25 + (25 * lengths * n_docs) // max(n_terms, 1)


def _impacts(counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 12 * scale)


def _tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts in order, and the place of the text that each is from. Works on the texts' bytes at once."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    folded = _fold()[data]
    inside = np.append(folded != 0, False)
    opens, closes = inside.copy(), inside[:-1].copy()
    opens[1:] &= ~inside[:-1]
    closes &= ~inside[1:]
    opens[ends[:-1]] = inside[ends[:-1]]  # a text's end also ends a term
    last = ends[1:][ends[1:] > 0] - 1
    closes[last] = inside[last]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(folded[inside[:-1]])])
    return words.dictionary_encode(), np.searchsorted(ends, starts, side="right") - 1


def index_block(block: int, doc_ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The index's rows of one block, terms in order of their bytes, the row of the documents first."""
    words, docs = _tokens(texts)
    n = len(texts)
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys = np.sort(rank[words.indices.to_numpy()] * n + docs)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(first, append=len(keys))
    term, place = keys[first] // n, keys[first] % n
    lengths = np.bincount(docs, minlength=n).astype(np.int64)
    steps = -(-_impacts(counts, _doc_scale(lengths, n_docs, n_terms)[place]) // STEP)
    bounds = np.searchsorted(term, np.arange(len(order) + 1)).astype(np.int32)
    head = lambda a: pa.concat_arrays([pa.nulls(1, a.type), a])
    listed = lambda a: head(pa.ListArray.from_arrays(bounds, pa.array(a.astype(np.int32))))
    bytes_ = pa.BinaryArray.from_buffers(pa.binary(), len(order), [None, pa.py_buffer(bounds), pa.py_buffer(steps.astype(np.uint8))])
    once = lambda a: pa.concat_arrays([pa.ListArray.from_arrays(np.array([0, n], np.int32), a), pa.nulls(len(order), pa.list_(a.type))])
    terms = words.dictionary.take(pa.array(order)).cast(pa.binary()).cast(pa.string())
    columns = [pa.array(np.full(len(order) + 1, block)), head(terms), listed(place), head(bytes_), listed(counts), once(doc_ids.cast(pa.int64())), once(pa.array(lengths))]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(FIELDS))


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> Index:
    """Index every document (doc_id, text; other columns are ignored), nothing is shuffled.

    Texts are read twice: impacts rest on the corpus' size, which the first pass counts. A block is a run of rows of one task
    with at most block_docs rows and block_bytes bytes, or one longer text. Null text: no terms. Null and repeated
    doc_ids: a document each. No rows: an index without blocks.
    """
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).cast("long")
    n_docs, n_terms = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            at = 0
            for i, k in enumerate(lengths.tolist()):
                if rows and (size + k > block_bytes or rows >= block_docs):
                    held.append(batch.slice(at, i - at))
                    yield _block(block, held, n_docs, n_terms)
                    block, held, size, rows, at = block + 1, [], 0, 0, i
                size, rows = size + k, rows + 1
            held.append(batch.slice(at))
        if rows:
            yield _block(block, held, n_docs, n_terms)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return Index(materialize(rows.mapInArrow(lean(build), INDEX), "lexical_index"), n_docs, n_terms)


def _block(block: int, held: list[pa.RecordBatch], n_docs: int, n_terms: int) -> pa.RecordBatch:
    column = lambda i: pa.concat_arrays([b.column(i).cast(t) for b in held]) if (t := (pa.int64(), pa.large_string())[i]) else None
    return index_block(block, column(0), column(1), n_docs, n_terms)


def _query_terms(queries: DataFrame) -> DataFrame:
    """(item, item_id, batch, term, n): each item's terms and how often it has them; items are rows, numbered, and dealt
    to batches of about BATCH_TERMS terms."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    items = queries.select("item_id", F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("terms"))
    items = items.withColumns({"one": F.lit(1), "size": F.size("terms")})
    items = range_prefix(items, [F.col("item_id").asc_nulls_first(), F.col("terms").asc()], {"item": "one", "upto": "size"})
    items = items.withColumn("batch", F.floor((F.col("upto") - F.col("size")) / BATCH_TERMS))
    own = items.select("item", "item_id", "batch", F.explode("terms").alias("term"))
    return own.groupBy("item", "item_id", "batch", "term").agg(F.count(F.lit(1)).alias("n"))


def _by_term(table: pa.Table, values: list[str], known: pa.Array) -> list[tuple[int, list[np.ndarray]]]:
    """Of each row with a term: the term's place in known, and the row's arrays."""
    table = table.filter(pc.is_valid(table["term"])).combine_chunks()
    ids = pc.index_in(table["term"].combine_chunks(), value_set=known).to_numpy(zero_copy_only=False)
    out = [(int(t), []) for t in ids]
    for name in values:
        array = table[name].combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = array.chunk(0) if array.num_chunks else pa.array([], array.type)
        bounds = array.offsets.to_numpy() if pa.types.is_list(array.type) else np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else []
        flat = array.values.to_numpy() if pa.types.is_list(array.type) else np.frombuffer(array.buffers()[2] or b"", np.uint8)
        for i, (_, arrays) in enumerate(out):
            arrays.append(flat[bounds[i] : bounds[i + 1]])
    return out


def _search_batch(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score): at most k rows an item and block that hold its k best; wanted: (item, term, n, w) of one batch."""
    vocabulary = wanted.select("term").distinct()
    pairs = wanted.select("item", "term", (F.col("n") * F.col("w")).alias("weight")).orderBy("item", "term").toArrow()  # bounded by the batch
    items, item_at = np.unique(pairs["item"].to_numpy(), return_inverse=True)
    coded = pairs["term"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    known, term_at, weight = coded.dictionary, coded.indices.to_numpy(), pairs["weight"].to_numpy().astype(np.int64)
    starts = np.searchsorted(item_at, np.arange(len(items) + 1))
    n_docs, n_terms = index.n_docs, index.n_terms

    def bounds(table: pa.Table) -> pa.Table:
        """Level one of a block: for each item its k largest lower bounds, and the places whose upper bound reaches the least of them."""
        rows = _by_term(table, ["places", "impacts"], known)
        n = max((int(p[-1]) + 1 for _, (p, _) in rows), default=0)
        upper = {t: (p, STEP * b.astype(np.int64)) for t, (p, b) in rows}
        out: dict[str, list] = {"item": [], "lows": [], "places": [], "uppers": []}
        high, low = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, item in enumerate(items.tolist()):
            high[:] = low[:] = 0
            for j in range(starts[i], starts[i + 1]):
                if found := upper.get(int(term_at[j])):
                    high[found[0]] += weight[j] * found[1]
                    low[found[0]] += weight[j] * np.maximum(found[1] - (STEP - 1), 0)
            if not high.any():
                continue
            lows = -np.sort(-np.partition(low, n - k)[n - k :]) if n > k else -np.sort(-low)
            reach = np.flatnonzero(high >= max(int(lows[-1]) if n >= k else 1, 1))
            for name, value in (("item", item), ("lows", lows[lows > 0]), ("places", reach.astype(np.int32)), ("uppers", high[reach])):
                out[name].append(value)
        block = table["block"][0].as_py()
        types = {"item": pa.int64(), "lows": pa.list_(pa.int64()), "places": pa.list_(pa.int32()), "uppers": pa.list_(pa.int64())}
        return pa.table({"block": pa.array([block] * len(out["item"]), pa.int64()), **{c: pa.array(v, types[c]) for c, v in out.items()}})

    level_one = index.rows.select("block", "term", "places", "impacts").join(vocabulary, "term", "left_semi").select("block", "term", "places", "impacts")
    bounded = materialize(level_one.groupBy("block").applyInArrow(bounds, "block long, item long, lows array<long>, places array<int>, uppers array<long>"), "bounds")
    best = Window.partitionBy("item").orderBy(F.col("low").desc())
    ranked = bounded.select("item", F.explode("lows").alias("low")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    least = ranked.groupBy("item").agg(F.when(F.count(F.lit(1)) >= k, F.min("low")).otherwise(F.lit(1)).alias("least"))
    reach = F.filter(F.arrays_zip("places", "uppers"), lambda x: x["uppers"] >= F.col("least"))
    reached = bounded.join(least, "item").select("block", "item", F.transform(reach, lambda x: x["places"]).alias("reached")).where(F.size("reached") > 0)
    reached = materialize(reached, "reached")

    def rescore(asked: pa.Table, level_two: pa.Table) -> pa.Table:
        """Exact scores of the documents that an item reached in a block; the k best of each item."""
        head = level_two.filter(pc.is_null(level_two["term"]))
        doc_ids, lengths = (head[c].combine_chunks().flatten() for c in ("doc_ids", "lengths"))
        scale = _doc_scale(lengths.to_numpy(), n_docs, n_terms)
        rows = dict(_by_term(level_two.drop_columns(["doc_ids", "lengths"]), ["places", "counts"], known))
        out: list[pa.Table] = []
        for item, places in zip(asked["item"].to_pylist(), asked["reached"]):
            places, i = places.values.to_numpy().astype(np.int64), int(np.searchsorted(items, item))
            score = np.zeros(len(places), np.int64)
            for j in range(starts[i], starts[i + 1]):
                held, counts = rows.get(int(term_at[j]), (None, None))
                if held is not None and len(held):
                    at = np.minimum(np.searchsorted(held, places), len(held) - 1)
                    has = held[at] == places
                    score[has] += weight[j] * _impacts(counts[at[has]].astype(np.int64), scale[places[has]])
            found = pa.table({"item": np.full(len(places), item), "doc_id": doc_ids.take(pa.array(places)), "score": score})
            found = found.filter(pc.greater(found["score"], 0))
            out.append(found.take(pc.sort_indices(found, [("score", "descending"), ("doc_id", "ascending")])[:k]))
        return pa.concat_tables(out)

    blocks = reached.select("block").distinct()
    level_two = index.rows.select("block", "term", "places", "counts", "doc_ids", "lengths").join(blocks, "block", "left_semi")
    own = level_two.where("term is not null").join(vocabulary, "term", "left_semi").select(*level_two.columns)
    level_two = own.union(level_two.where("term is null"))
    scored = reached.groupBy("block").cogroup(level_two.groupBy("block")).applyInArrow(rescore, "item long, doc_id long, score long")
    scored = materialize(scored, "scored")
    for old in (bounded, reached):
        discard(old)
    return scored


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of each row of queries (item_id, text): item_id, rank from 1, doc_id, score.

    Scores and weights as the query op12 states them; equal scores rank by doc_id, nulls last, and rows with equal
    doc_id each have a place. Items without terms, or none that a document has: no rows. Repeated items: each is answered.
    Other columns are ignored. Items are searched in batches of about BATCH_TERMS terms, which are sent to the tasks;
    every document is bounded in every batch. Of a block, however many documents tie, a task keeps k an item.
    """
    terms = materialize(_query_terms(queries), "query_terms")
    held = index.rows.where("term is not null").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = materialize(terms.join(held.select("term", weight.alias("w")), "term").where("w > 0"), "weighed")
    found = None
    for (batch,) in weighed.select("batch").distinct().orderBy("batch").collect():
        scored = _search_batch(index, weighed.where(F.col("batch") == batch), k)
        found = scored if found is None else found.union(scored)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(terms.select("item", "item_id").distinct(), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 20, **options: int) -> DataFrame:
    """Index the documents and search them: see build_index and search."""
    return search(build_index(docs, **options), queries, k)


ORACLE = f"""
with doc as (
  select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as terms
  from documents),
corpus as (select count(*) filter (len(terms) > 0) as n_docs, sum(len(terms))::bigint as n_terms from doc),
postings as (
  select d, doc_id, n, term, count(*)::bigint as tf
  from (select d, doc_id, len(terms)::bigint as n, unnest(terms) as term from doc) group by all),
item as (
  select row_number() over () as i, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as terms
  from benchmark),
asked as (select i, item_id, term, count(*)::bigint as n_asked from (select i, item_id, unnest(terms) as term from item) group by all),
weights as (
  select term, floor(1000 * ln((2.0::double * n_docs + 2) / (2 * df + 1)))::bigint as w
  from (select term, count(*)::bigint as df from postings group by term), corpus),
scored as (
  select i, item_id, d, doc_id,
         sum(n_asked * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::bigint as score
  from asked join weights using (term) join postings using (term), corpus
  group by i, item_id, d, doc_id),
ranked as (
  select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""

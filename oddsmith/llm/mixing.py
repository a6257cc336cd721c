"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, materialize, range_prefix

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def _source_key() -> Column:
    """Never null: "" for a null source, else "=" and the source."""
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))


def _random_key() -> Column:
    """The same for the same document in any run and any engine."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def source_targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(sk, source_size) -> (sk, source_size, target): shares by repeating weights, at most `most` times a source's size.

    The shares are the level x at which the sum of min(most * size, weight * x) reaches the total size: sources whose
    own bound is reached below that level stop there, and the rest share what is left by weight.
    """
    ranked = range_prefix(per_source.withColumn("one", F.lit(1)), [(F.col("sk") == "").asc(), F.col("sk").asc()], {"place": "one"})
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", cycle.cast("long")).withColumn("bound", F.col("source_size") * most)
    ranked = ranked.withColumn("level", F.col("bound") / F.col("w"))
    filled = materialize(range_prefix(ranked, [F.col("level").asc(), F.col("sk").asc()], {"bounds": "bound", "ws": "w"}), "filled")
    whole = filled.agg(F.sum("source_size").alias("total"), F.sum("w").alias("all_w"))
    own = filled.join(F.broadcast(whole)).withColumn("stops", F.col("bounds") + F.col("level") * (F.col("all_w") - F.col("ws")) <= F.col("total"))
    own = materialize(own, "stops")
    rest = own.agg(F.sum(F.when(F.col("stops"), F.col("bound")).otherwise(0)).alias("bound_sum"), F.sum(F.when(F.col("stops"), 0).otherwise(F.col("w"))).alias("free_w"))
    share = F.col("w") * ((F.col("total") - F.col("bound_sum")) / F.col("free_w"))
    target = F.when(F.col("stops"), F.col("bound").cast("double")).otherwise(share)
    return own.join(F.broadcast(rest)).select("sk", "source_size", target.alias("target"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, bucket_rows: int = 1024) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, size, source_size, target, taken, mix_key).

    size counts the words of the text. Sources rank by code point, null last; weights repeat along that rank. A source
    with target t and size s gives t // s whole epochs and then its documents in the order of mix_key, a hash of
    doc_id and text, up to the exact rest; the document at the cut gives only its first words. Null or blank text: size 0,
    nothing is taken. Identical rows: each counts; which of them is cut makes no difference. No rows: no rows.

    Keys are uniform, so their leading digits cut each source, however large, into buckets of about bucket_rows
    rows; a bucket is sorted in one task, and what precedes it comes from running sums of the buckets' totals, which
    are themselves taken over key ranges, not a source at a time.
    """
    return _takes(docs, weights, most, bucket_rows).drop("source_key")


def _takes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, bucket_rows: int = 1024) -> DataFrame:
    """mixture's rows with the source's key."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), _source_key().alias("sk"), size.alias("size"), _random_key().alias("mix_key"))
    rows = materialize(rows, "sizes")
    digits = 1
    n = rows.count()
    while 16**digits * bucket_rows < n and digits < 12:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("mix_key", 1, digits))
    buckets = materialize(rows.groupBy("sk", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    targets = source_targets(buckets.groupBy("sk").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    ranged = materialize(range_prefix(buckets, [F.col("sk").asc(), F.col("bucket").asc()], {"run": "bucket_size"}), "ranged")
    ranged = ranged.withColumn("ahead", F.col("run") - F.col("bucket_size"))
    starts = ranged.groupBy("sk").agg(F.min("ahead").alias("source_start"))
    plan = ranged.join(starts, "sk").select("sk", "bucket", (F.col("ahead") - F.col("source_start")).alias("before")).join(targets, "sk")
    budget = F.floor(F.col("target") + 0.5)
    plan = plan.withColumn("epochs", F.coalesce(F.try_divide(budget, F.col("source_size")).cast("long"), F.lit(0)))
    plan = materialize(plan.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "plan")
    inside = Window.partitionBy("sk", "bucket").orderBy("mix_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(plan, ["sk", "bucket"])
    start = F.col("before") + F.col("upto") - F.col("size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    taken = (F.col("size") * F.col("epochs") + extra).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "mix_key", F.col("sk").alias("source_key"))


def mixed_documents(docs: DataFrame, **options: int) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; the one at a source's cut keeps its first words.

    All columns stay; n_chars, where there is one, follows the text. Whole texts are shuffled once, by document. Rows meet
    their takes by source, id and text, so the same document under two sources is taken as each source's budget says; of
    rows equal in all three any may be the one that is cut. Null or blank texts are never taken. Null ids, null sources and
    columns of any other names are kept. No rows: no rows.
    """
    id_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    chosen = _takes(docs, **options).where("taken > 0").withColumn("_oddsmith_id", id_key).withColumnsRenamed({"mix_key": "_oddsmith_key", "source_key": "_oddsmith_source"})
    keys = ["_oddsmith_source", "_oddsmith_key", "_oddsmith_id"]
    chosen = materialize(chosen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("taken", "size"))).alias("_oddsmith_takes")), "taken")
    same = Window.partitionBy(*keys).orderBy(F.length("text"))
    rows = docs.withColumn("_oddsmith_id", id_key).withColumn("_oddsmith_key", _random_key())
    rows = rows.withColumn("_oddsmith_source", _source_key()).join(chosen, keys)
    rows = rows.withColumn("_oddsmith_take", F.get("_oddsmith_takes", F.row_number().over(same) - 1)).where("_oddsmith_take is not null")
    whole, over = F.expr("_oddsmith_take.taken div _oddsmith_take.size"), F.expr("_oddsmith_take.taken % _oddsmith_take.size")
    rows = rows.withColumn("_oddsmith_copy", F.explode(F.expr("sequence(1L, (_oddsmith_take.taken + _oddsmith_take.size - 1) div _oddsmith_take.size)")))
    rows = rows.withColumn("_oddsmith_cut", (F.col("_oddsmith_copy") > whole) & (over > 0))
    words = F.regexp_extract_all("text", F.lit(f"[{SPACES}]*{WORD}"), 0)
    rows = rows.withColumn("text", F.when(F.col("_oddsmith_cut"), F.array_join(F.slice(words, F.lit(1), over.cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_oddsmith_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


ORACLE = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as mix_key
  from documents),
per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place
  from sized group by source),
weighed as (
  select *, case (place - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, 3 * source_size as bound from per),
levels as (
  select *, bound / w::double as level,
         sum(bound) over o as bounds, sum(w) over o as ws,
         sum(source_size) over () as total, sum(w) over () as all_w
  from weighed window o as (order by bound / w::double, source nulls first rows unbounded preceding)),
stopped as (select *, bounds + level * (all_w - ws) <= total as stops from levels),
rest as (
  select sum(case when stops then bound else 0 end)::double as bound_sum,
         sum(case when stops then 0 else w end) as free_w from stopped),
targets as (
  select source, source_size, case when stops then bound::double else w * ((total - bound_sum) / free_w) end as target
  from stopped, rest),
budgets as (
  select *, floor(target + 0.5)::bigint as budget from targets),
placed as (
  select d.doc_id, d.size, b.source_size, b.target, b.budget,
         sum(d.size) over (partition by d.source order by d.mix_key, d.doc_id rows unbounded preceding) - d.size as start
  from sized d join budgets b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
       (case when source_size = 0 then 0
             else size * (budget // source_size)
                  + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) end)::bigint as taken
from placed
"""

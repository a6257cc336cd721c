"""Line dedup: exact repeats and lines within a few edits of an earlier one. Built-in functions only.

Equal lines are found by two hashes, 96 bits together. Near ones by a segment-partition join: a line that may differ by e edits is cut
into e + 1 disjoint segments; if two lines are that close, one segment of the one is a substring of the other, at nearly
the same place. Segments are indexed by number, length and hash; a line probes the index for its own and neighbouring
lengths. Candidates that agree in length and letter counts are verified by a banded bit-parallel edit distance inside
the join, which keeps a line as soon as one earlier line is found, so pairs are never listed.

Two lines may differ by one edit for each STEP characters of the shorter one, and by `edits` at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, new_path, release, shuffle_partitions

LETTERS = " entaoirsh"
STEP = 14
NO_ID = 1 << 62
HOT = 2_000  # lines at a segment from which its candidates are dealt further, by length
PART = 20_000  # candidates of a segment and length that one task compares


def _id() -> Column:
    """doc_id; rows without one come after all others, in an order of their own by hash of the text."""
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit(NO_ID - 1))
    return F.coalesce(F.col("doc_id").cast("long"), own + F.lit(NO_ID))


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _letter_counts(line: Column) -> Column:
    """Counts of some frequent letters, 6 bits each, in one number."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        n = F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(n.cast("long").bitwiseAND(63), 6 * i))
    return out


def _counts_apart(a: str, b: str) -> Column:
    """Sum of differences of the packed letter counts; an edit adds at most 2."""
    terms = []
    for i in range(len(LETTERS)):
        d = f"abs((shiftright({a}, {6 * i}) & 63) - (shiftright({b}, {6 * i}) & 63))"
        terms.append(f"least({d}, 64 - {d})")
    return F.expr(" + ".join(terms))


def _lost_blocks(a: str, b: str, n: str, edits: int, blocks: int = 8) -> Column:
    """How many of the equal blocks that line a (of length n) is cut into aren't found at their place in b, give or take
    `edits` characters; an edit costs at most one block."""
    out = F.lit(0)
    w = F.floor(F.col(n) / blocks).cast("int")
    for i in range(blocks):
        at = w * i + 1
        own = F.substring(F.col(a), at, w)
        around = F.substring(F.col(b), F.greatest(F.lit(1), at - edits), w + 2 * edits)
        out = out + F.when(F.contains(around, own), 0).otherwise(1)
    return out


def allowed(n: Column, edits: int) -> Column:
    """Edits by which a line of n characters may differ from one that isn't shorter."""
    return F.least(F.lit(edits), F.floor(n / STEP)).cast("int")


def segment_length(n: Column, edits: int) -> Column:
    """Length of each of the allowed + 1 segments of a line of n characters; lines of nearly equal length mostly share it."""
    return (F.floor(n / STEP) * (STEP - 2) / (allowed(n, edits) + 1)).cast("int")


def _segments(lines: DataFrame, edits: int) -> DataFrame:
    """(key, h, g, indexed) from (h, g, n, line): what a line is found by (indexed), and what it is looked up under.

    Segment i of e + 1 of a line of length n starts at i * (n - k) / e, for its segment length k. Up to e - 1 edits can
    lie on either side of an inner segment, if neither outer one is whole, so a probe takes the starts that far around;
    the outer segments lie at the line's ends. Shifts of neighbouring lengths are covered together, so a line is cut as its
    own length wants, and as a length up to `edits` away wants where that differs. A row is made for each cut before its
    substring is taken: few short expressions, which stay within compiled code.
    """
    cuts = [(o, i, s) for o in (0, -edits, edits) for i in range(edits + 1) for s in range(-(edits - 1), edits) if s == 0 or 0 < i < edits]
    cuts = F.array(*[F.struct(F.lit(o).alias("other"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for o, i, s in cuts])
    rows = lines.select("h", "g", "n", "line", segment_length(F.col("n"), edits).alias("own"), F.explode(cuts).alias("cut"))
    rows = rows.select("h", "g", "n", "line", "own", "cut.*").withColumn("m", F.col("n") + F.col("other"))
    rows = rows.withColumns({"k": segment_length(F.col("m"), edits), "e": allowed(F.col("m"), edits)})
    rows = rows.where("e > 0 and i <= e and (other = 0 or k <> own) and (shift = 0 or i < e)")
    rows = rows.withColumn("at", (F.floor(F.col("i") * (F.col("n") - F.col("k")) / F.col("e")) + F.col("shift")).cast("int"))
    rows = rows.where("at >= 0 and at + k <= n")
    key = F.xxhash64("i", "k", F.substring(F.col("line"), F.col("at") + 1, F.col("k")))
    return rows.select(key.alias("key"), "h", "g", ((F.col("other") == 0) & (F.col("shift") == 0)).alias("indexed"))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within `edits` edits, by a bit-parallel automaton over the band of 2 * edits + 1 diagonals.

    Common ends are cut off first. Then bit d of word e says that the text so far matches the pattern up to the place
    on diagonal d with at most e edits; a character updates all diagonals of a word at once.
    """
    wide = 2 * edits + 1
    full = (1 << wide) - 1

    def common(x: Column, y: Column, cut) -> Column:
        most = F.least(F.length(x), F.length(y))
        step = lambda s, _: F.when(cut(x, F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")) == cut(y, F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")),
            F.struct(F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int").alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), F.greatest(s["lo"], F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int") - 1).alias("hi")))
        rounds = F.sequence(F.lit(1), F.ceil(F.log2(most + 2)).cast("int") + 1)
        return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), most.alias("hi")), step, lambda s: s["lo"])

    def word(s: Column, e: int) -> Column:
        return F.shiftrightunsigned(s, 16 * e).bitwiseAND(full)

    start, cur = F.lit(0).cast("long"), 1 << edits
    for e in range(edits + 1):
        start = start.bitwiseOR(F.lit(cur << (16 * e)).cast("long"))
        cur = (cur | cur << 1) & full

    def verdict(c: Column) -> Column:
        def step(s: Column, j: Column) -> Column:
            ch = F.get(c["t"], j)
            same = F.lit(0).cast("long")
            for d in range(wide):
                at = j + (d - edits)
                hit = F.coalesce(F.get(c["p"], F.when(at >= 0, at)) == ch, F.lit(False)) & (at < c["m"])
                same = same.bitwiseOR(F.when(hit, F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long")))
            out, last_old, last_new = F.lit(0).cast("long"), None, None
            for e in range(edits + 1):
                old = word(s, e)
                new = old.bitwiseAND(same)
                if e:
                    new = new.bitwiseOR(last_old).bitwiseOR(F.shiftrightunsigned(last_old, 1)).bitwiseOR(F.shiftleft(last_new, 1).bitwiseAND(full))
                out = out.bitwiseOR(F.shiftleft(new, 16 * e))
                last_old, last_new = old, new
            return out

        states = F.aggregate(F.sequence(F.lit(0), c["n"] - 1), start, step)
        return F.call_function("shiftrightunsigned", word(states, edits), (c["m"] - c["n"] + edits).cast("int")).bitwiseAND(1) == 1

    def decided(c: Column) -> Column:
        short = F.when(c["n"] == 0, c["m"] <= edits).when(c["m"] == 0, c["n"] <= edits)
        return F.when(F.abs(c["m"] - c["n"]) > edits, F.lit(False)).otherwise(F.coalesce(short, verdict(c)))

    # each value that is used more than once is bound by a lambda, else its expression would be evaluated anew in every use
    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def without_head(s: Column) -> Column:
        head = common(s["a"], s["b"], lambda x, k: F.substring(x, F.lit(1), k))
        return let(F.struct(s["a"].alias("a"), s["b"].alias("b"), head.alias("k")), lambda c: without_tail(
            F.struct(F.substring(c["a"], c["k"] + 1, F.length(c["a"])).alias("a"), F.substring(c["b"], c["k"] + 1, F.length(c["b"])).alias("b"))))

    def without_tail(s: Column) -> Column:
        last = lambda x, k: F.when(k > 0, F.substring(x, -k, k)).otherwise(F.lit(""))
        return let(s, lambda c: let(F.struct(c["a"].alias("a"), c["b"].alias("b"), common(c["a"], c["b"], last).alias("k")), cores))

    def cores(s: Column) -> Column:
        cut = lambda x: F.substring(x, F.lit(1), F.length(x) - s["k"])
        return let(F.struct(F.split(cut(s["a"]), "").alias("p"), F.split(cut(s["b"]), "").alias("t"), (F.length(s["a"]) - s["k"]).alias("m"), (F.length(s["b"]) - s["k"]).alias("n")), decided)

    return let(F.struct(a.alias("a"), b.alias("b")), without_head)


def _bucketed(df: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """df as a table in shared storage that is bucketed by columns, so that joins on them don't move its rows."""
    spark = df.sparkSession
    table = f"oddsmith_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(shuffle_partitions(spark), *columns).option("path", new_path(spark, "bucketed")).saveAsTable(table)
    return spark.table(table), table


def _near_lines(distinct: DataFrame, edits: int) -> DataFrame:
    """(h, g, near): the hashes of lines near an earlier one, near is true."""
    spark = distinct.sparkSession
    keyed = materialize(_segments(distinct.where(F.col("n") >= STEP), edits), "segments")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bool_or("indexed").alias("any")).where("c > 1 and any")
    shared = materialize(shared.select("key", F.when(F.col("c") >= HOT, F.col("c")).alias("hot")), "shared")
    # shuffled at any size: adaptive execution can then split a hot key, and the cost keeps in step with the input
    rows = materialize(keyed.hint("merge").join(shared, "key").select("key", "h", "g", "indexed", "hot"), "candidates")
    discard(keyed)
    release(spark)

    # few lines share a segment with another; only their texts are read again, where they lie
    texts = distinct.join(materialize(rows.select("h", "g").distinct(), "involved"), ["h", "g"])
    texts = materialize(texts.select("h", "g", "first_id", "n", "line", _letter_counts(F.col("line")).alias("counts")), "texts")
    names = ["h", "g", "id", "n", "line", "counts"]
    sides = rows.join(texts, ["h", "g"])
    # a hot segment's candidates meet by length too, and in parts where even that leaves many
    parts = F.coalesce(F.ceil(F.col("hot") / PART), F.lit(1)).cast("int")
    lengths = F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.col("n") - edits, F.col("n") + edits))
    later = sides.withColumn("size", F.explode(lengths)).withColumn("part", F.pmod(F.col("g"), parts))
    earlier = sides.where("indexed").withColumn("size", F.when(F.col("hot").isNull(), F.lit(0)).otherwise(F.col("n")))
    earlier = earlier.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    meets = ["key", "size", "part"]
    later, earlier = (d.select(*[F.col(c).cast("long").alias(c) for c in meets], *[F.col(c).alias(f"{x}_{y}") for c, y in zip(texts.columns, names)]) for d, x in ((later, "a"), (earlier, "b")))
    order = F.struct("a_id", "a_h", "a_g") > F.struct("b_id", "b_h", "b_g")
    least = F.least("a_n", "b_n")
    alike = within_edits(F.col("a_line"), F.col("b_line"), edits)
    for e in range(1, edits):
        alike = F.when(least < (e + 1) * STEP, within_edits(F.col("a_line"), F.col("b_line"), e)).otherwise(alike)
    most = allowed(least, edits)
    close = order & (F.abs(F.col("a_n") - F.col("b_n")) <= most) & (_counts_apart("a_counts", "b_counts") <= 2 * most) & (_lost_blocks("a_line", "b_line", "a_n", edits) <= most)
    # both sides are written, so that the join has an exchange on each and adaptive execution can split a hot segment
    later, earlier = materialize(later, "later"), materialize(earlier, "earlier")
    same = (later["key"] == earlier["key"]) & (later["size"] == earlier["size"]) & (later["part"] == earlier["part"])
    found = later.hint("merge").join(earlier, same & close & alike, "left_semi")
    near = materialize(found.select(F.col("a_h").alias("h"), F.col("a_g").alias("g")).distinct().withColumn("near", F.lit(True)), "near")
    for old in (rows, shared, texts, later, earlier):
        discard(old)
    return near


def removed_lines(docs: DataFrame, edits: int = 2, min_chars: int = 1) -> DataFrame:
    """(id, keys): per document id (as _id has it) the lines to remove, as structs of hash, pos, near."""
    if edits not in (1, 2):
        raise ValueError("edits: 1 or 2")
    spark = docs.sparkSession
    lines = docs.select(_id().alias("id"), F.posexplode(_lines()).alias("pos", "line")).where(F.length(F.trim(F.col("line"))) >= max(1, min_chars))
    lines = lines.withColumns({"h": F.xxhash64("line"), "g": F.hash("line")})
    distinct = lines.groupBy("h", "g").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.first("line").alias("line"))
    distinct, table = _bucketed(distinct.withColumn("n", F.length("line")), "h", "g")
    try:
        release(spark)
        near = _near_lines(distinct, edits)
        verdicts = distinct.select("h", "g", "first_id", "last_id").join(near, ["h", "g"], "left").where("near or first_id < last_id")
        verdicts = materialize(verdicts.select("h", "g", "first_id", F.coalesce("near", F.lit(False)).alias("near")), "verdicts")
    finally:
        spark.sql(f"drop table {table}")

    own = lines.groupBy("id", "h", "g").agg(F.collect_set("pos").alias("places"))
    judged = own.join(verdicts, ["h", "g"], "left")
    away = F.coalesce(F.col("near") | (F.col("first_id") < F.col("id")), F.lit(False))
    gone = F.when(away, F.col("places")).otherwise(F.filter("places", lambda p: p > F.array_min("places")))
    judged = judged.withColumn("gone", gone).where(F.size("gone") > 0)
    rows = F.transform("gone", lambda p: F.struct(F.col("h").alias("hash"), p.alias("pos"), F.coalesce("near", F.lit(False)).alias("near")))
    return materialize(judged.groupBy("id").agg(F.flatten(F.collect_list(rows)).alias("keys")), "removed")


def line_verdicts(docs: DataFrame, **options: int) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_near (removed for a near line), removed (line numbers from 0).

    Lines are what "\\n" separates. Lines with fewer than min_chars characters besides outer spaces stay; by default these
    are the blank ones alone. A line goes if the same line occurs in a document with a lesser doc_id, or earlier in its
    own, or if an earlier line is near it: within an edit for each 14 characters of the shorter of the two, `edits` at most.
    The earlier of two lines is the one whose first document has the lesser id, ties by hash.

    Null or empty text: one empty line, nothing removed. Null doc_id: after all others, ordered by hash of the text (doc_id
    from 2**62 on lie among these). Repeated doc_id, and equal texts without one: as one document, so identical rows
    keep the same lines. No rows: no rows. Long texts and lines are taken whole; other columns are ignored.

    Hot lines are counted before they are shuffled; a common segment's candidates are dealt by length and in parts, and
    filtered inside a sort-merge join.
    """
    removed = removed_lines(docs, **options)
    narrow = docs.select(F.col("doc_id").cast("long"), _id().alias("id"), F.size(_lines()).alias("n_lines"))
    out = narrow.join(removed, "id", "left")
    keys = F.coalesce("keys", F.array().cast(removed.schema["keys"].dataType))
    return out.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(keys).cast("long").alias("n_removed"),
        F.size(F.filter(keys, lambda k: k["near"])).cast("long").alias("n_near"),
        F.sort_array(F.transform(keys, lambda k: k["pos"])).alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, **options: int) -> DataFrame:
    """docs with the lines that line_verdicts names taken out, all columns kept; a document left without a word goes.

    n_chars, where there is one, follows the text.
    """
    removed = removed_lines(docs, **options)
    rows = docs.withColumn("_oddsmith_id", _id()).join(removed.toDF("_oddsmith_id", "_oddsmith_keys"), "_oddsmith_id", "left")
    gone = F.transform("_oddsmith_keys", lambda k: F.struct(k["hash"].alias("hash"), k["pos"].alias("pos")))
    left = F.filter(_lines(), lambda x, i: ~F.array_contains(gone, F.struct(F.xxhash64(x).alias("hash"), i.alias("pos"))))
    rows = rows.withColumn("text", F.when(F.col("_oddsmith_keys").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    rows = rows.where(F.col("_oddsmith_keys").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_oddsmith_keys").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*docs.columns)

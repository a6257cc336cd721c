import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from helpers import documents, empty, rows, words
from pyspark.sql import functions as F

from oddsmith.llm import epsjoin, linededup, simhash
from oddsmith.llm.common import connected_components


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(70)] + [(7, 7), (None, 3)]
    u = Union()
    for a, b in edges:
        if a is not None and a != b:
            u.link(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: u.find(x) for x in u.up}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_documents():
    rng = random.Random(9)
    out = [r[:2] for r in rows()]
    base = words(rng, 400)
    for i in range(40):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed%d" % i
        out.append((500 + i, " ".join(w)))
    return out


def test_simhash_groups(spark):
    data = near_documents()
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", F.lit(1))
    fps = [fingerprint(t) for _, t in data]
    u = Union()
    for i in range(len(fps)):
        u.find(i)
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                u.link(i, j)
    first = defaultdict(lambda: None)
    for i, (d, _) in enumerate(data):
        r = u.find(i)
        if d is not None and (first[r] is None or d < first[r]):
            first[r] = d
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = sorted(((d, f"{fps[i]:016x}", first[u.find(i)]) for i, (d, _) in enumerate(data)), key=key)
    assert sorted((tuple(r) for r in simhash.near_duplicate_groups(df).collect()), key=key) == want
    kept = simhash.deduplicate(df).select("doc_id").collect()
    assert {r.doc_id for r in kept if r.doc_id is not None} == {v for v in first.values() if v is not None}
    assert simhash.near_duplicate_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("part_rows", [5, 10**6])
def test_covering_finds_every_link(spark, part_rows):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(6):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    u = Union()
    for i, x in enumerate(fps):
        u.find(x)
        for y in fps[:i]:
            if bin(x ^ y).count("1") <= 4:
                u.link(x, y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for segments in (2, 3, 4):
        e = simhash.fingerprint_links(df, 4, segments, part_rows).collect()
        v = Union()
        for x in fps:
            v.find(x)
        for r in e:
            v.link(r.u % (1 << 64), r.v % (1 << 64))
        assert len({(u.find(x), v.find(x)) for x in fps}) == len({u.find(x) for x in fps}) == len({v.find(x) for x in fps})


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutated(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, r = rng.randrange(len(s) + 1), rng.random()
        if r < 0.33:
            s.insert(i, rng.choice("abé"))
        elif s and r < 0.66:
            s.pop(min(i, len(s) - 1))
        elif s:
            s[min(i, len(s) - 1)] = rng.choice("abé")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2])
def test_banded_distance(spark, edits):
    rng = random.Random(5)
    pairs = []
    for _ in range(500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        pairs.append((a, mutated(rng, a, rng.randint(0, 4))))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.within_edits(F.col("a"), F.col("b"), edits).alias("y")).collect()
    assert all(r.y == (distance(r.a, r.b) <= edits) for r in got)


def line_documents():
    rng = random.Random(8)
    base = [words(rng, rng.randint(12, 30)) for _ in range(25)] + [words(rng, 9)[:n] for n in (13, 14, 15, 20, 26, 27, 28, 29, 30, 41, 42, 43, 50)]
    out = []
    for d in range(140):
        own = [mutated(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) if rng.random() < 0.9 else rng.choice(["short", "", "another short line"]) for _ in range(rng.randint(0, 5))]
        out.append((d, "\n".join(own)))
    return out + [(None, "only this line, in a row without an id"), (None, "only this line, in a row without an id\nid\nid"), (300, None), (301, ""), (302, out[5][1]), (302, out[5][1])]


def allowed(x, y, edits=2):
    return min(edits, min(len(x), len(y)) // 14)


def text_id(spark, t):
    """The id of a row without a doc_id."""
    return linededup.NO_ID + (spark.range(1).select(F.xxhash64(F.lit(t or "")).alias("x")).first().x & (linededup.NO_ID - 1))


def test_line_verdicts(spark):
    data = line_documents()
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(0) for c in ("h", "id", "line", "keys", "_id")})
    both = df.select(F.explode(F.split("text", "\n")).alias("line")).select("line", F.xxhash64("line").alias("x"), F.hash("line").alias("y")).distinct().collect()
    h = {r.line: (r.x, r.y) for r in both}
    ids = [text_id(spark, t) if d is None else d for d, t in data]
    first = {}
    for d, (_, t) in zip(ids, data):
        for x in (t or "").split("\n"):
            if x.strip(" "):
                first[x] = min(first.get(x, d), d)
    order = sorted(first, key=lambda x: (first[x], h[x]))
    near = {x for i, x in enumerate(order) if any(abs(len(x) - len(y)) <= 2 and 0 < allowed(x, y) >= distance(x, y) for y in order[:i])}
    assert any(len(x) < 28 for x in near) and any(28 <= len(x) < 56 for x in near) and any(len(x) > 100 for x in near)
    got = defaultdict(list)
    for r in linededup.line_verdicts(df).collect():
        got[r.doc_id, r.n_lines].append(r)
    for i_, (d, t) in zip(ids, data):
        own = (t or "").split("\n")
        gone = [i for i, x in enumerate(own) if x.strip(" ") and (x in near or first[x] < i_ or x in own[:i])]
        assert got[d, len(own)]
        for r in got[d, len(own)]:
            assert (r.n_lines, r.n_removed, r.removed, r.n_near) == (len(own), len(gone), gone, sum(own[i] in near for i in gone))
    left = linededup.without_repeated_lines(df)
    assert left.columns == df.columns
    texts = defaultdict(list)
    for r in left.collect():
        texts[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text or "")
    for d, t in data:
        own = (t or "").split("\n")
        gone = got[d, len(own)][0].removed
        kept = "\n".join(x for i, x in enumerate(own) if i not in gone)
        if gone and not kept.strip():
            assert d not in texts
        else:
            assert (kept if gone else t) in texts[d] and (d is None or len(set(texts[d])) == 1)
    assert linededup.line_verdicts(empty(spark)).count() == 0 and linededup.without_repeated_lines(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        linededup.line_verdicts(df, edits=3)
    assert linededup.line_verdicts(documents(spark)).count() == len(rows())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("oddsmith_")]


def test_lines_that_share_a_segment(spark, monkeypatch):
    """Many lines with one head, of which a few are near others; the same in parts and whole."""
    rng = random.Random(4)
    head = "all of these lines begin in the same way: "
    lines = [head + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(30, 40))) for _ in range(2500)]
    lines += [x[:50] + "z" + x[51:] for x in lines[:100]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    want = {i for i in range(2500, 2600)}
    for part in (linededup.PART, 1500):
        monkeypatch.setattr(linededup, "PART", part)
        assert {r.doc_id for r in linededup.line_verdicts(df).where("n_near > 0").collect()} == want


def brute_vectors(rows_, least=0.95):
    u, links = Union(), [0] * len(rows_)
    x = [None] * len(rows_)
    for i, (_, v) in enumerate(rows_):
        u.find(i)
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            x[i] = a / np.linalg.norm(a)
    for i in range(len(rows_)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least:
                links[i] += 1
                links[j] += 1
                u.link(i, j)
    first = {}
    for i, (d, _) in enumerate(rows_):
        if d is not None:
            first[u.find(i)] = min(first.get(u.find(i), d), d)
    return sorted((d, links[i], first.get(u.find(i)), first.get(u.find(i)) == d) for i, (d, _) in enumerate(rows_))


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 12))
    data = [(i, [float(np.float32(c)) for c in base[i % 20] + rng.normal(size=12) * 0.18 * (i % 6)]) for i in range(400)]
    data += [(5000 + i, data[3][1]) for i in range(20)] + [(6000, None), (6001, []), (6002, [0.0] * 12), (6003, [None] + [1.0] * 11), (6004, [float("nan")] * 12), (6005, [1.0, 2.0]), (6006, [2.0, 4.0]), (6007, [-0.0, 1.0]), (6008, [0.0, 1.0]), (6009, [float("inf")] * 12), (6010, [1e30] * 12), (6011, [1e-30] * 12)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({"h": F.lit(1), "label": F.lit(0)})
    assert sorted(tuple(r) for r in epsjoin.near_duplicate_vectors(df, interval_rows=64).collect()) == brute_vectors(data)
    assert epsjoin.near_duplicate_vectors(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in epsjoin.near_duplicate_vectors(twice).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    x = np.random.default_rng(1).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    counts, child, root = epsjoin.join_intervals(x, x[:, :3], np.ones(300, np.int64), 300, True, 0.8, leaf=16)
    g = x @ x.T >= 0.8
    np.fill_diagonal(g, False)
    assert (counts == g.sum(axis=1)).all()


def test_vectors_keep_double_precision(spark):
    at = lambda c, sign: [c, sign * (1 - c * c) ** 0.5]
    rows = [(1, [1.0, 0.0]), (2, at(0.95 + 1e-11, 1)), (3, at(0.95 - 1e-11, -1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in epsjoin.near_duplicate_vectors(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_only_near_intervals_meet(spark):
    rng = np.random.default_rng(4)
    lo = rng.uniform(0, 3, (90, 2))
    hi = lo + rng.uniform(0, 0.2, (90, 2))
    boxes = spark.createDataFrame([(i, *map(float, (a[0], b[0], a[1], b[1]))) for i, (a, b) in enumerate(zip(lo, hi))], "interval long, lo0 double, hi0 double, lo1 double, hi1 double")
    gap = np.maximum(0, np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None]))
    near = (gap**2).sum(axis=2) <= 0.04
    want = {(i, j) for i in range(90) for j in range(i, 90) if near[i, j]}
    got = [tuple(r) for r in epsjoin.close_intervals(boxes, 2, 0.04).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) < 90 * 91 / 4
    assert epsjoin.close_intervals(boxes.limit(0), 2, 0.04).count() == 0
    assert [tuple(r) for r in epsjoin.close_intervals(boxes.where("interval = 0"), 2, 0.04).collect()] == [(0, 0)]


def test_clusters_are_shipped_in_proportion(spark):
    """Vectors of separate tight clusters: an interval meets its neighbours in order, whatever the number of intervals."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(160, 6))
    x = np.repeat(centres, 20, axis=0) + rng.normal(scale=0.01, size=(3200, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    pairs = []
    whole = epsjoin.close_intervals
    try:
        epsjoin.close_intervals = lambda *a: pairs.append(whole(*a)) or pairs[-1]
        got = sorted(tuple(r) for r in epsjoin.near_duplicate_vectors(df, interval_rows=20).collect())
    finally:
        epsjoin.close_intervals = whole
    assert got == brute_vectors([(i, v.tolist()) for i, v in enumerate(x)])
    assert pairs[0].count() < 160 * 161 / 2 / 4

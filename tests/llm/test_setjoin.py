import hashlib
import random

import corpus_pipeline
from helpers import SCHEMA, documents, empty, words
from test_dedup import Union

from oddsmith.llm import setjoin


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) > k else {b" ".join(w)} - {b""}


def similar_documents():
    """Near copies around the similarity, chains of them, a large group, and a passage that many share."""
    rng = random.Random(11)
    common, out = words(rng, 12), []
    for base in range(25):
        w = words(rng, rng.choice([6, 30, 120, 400])).split()
        for _ in range(8):
            w = list(w)
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed%d" % rng.randrange(10**6)
            out.append(" ".join(w) + (" " + common if base % 2 else ""))
    many = words(rng, 200).split()
    for i in range(60):
        w = list(many)
        w[rng.randrange(len(w))] = "other%d" % i
        out.append(" ".join(w))
    out += ["", None, " \n", "one two", "One  two", "one two three", out[0], out[0].upper()]
    rng.shuffle(out)
    return [(None if i == 9 else i // 2 if i in (40, 41) else i, t, "en", "s", len(t or "")) for i, t in enumerate(out)]


def test_near_copies_stage_against_jaccard(spark):
    data = similar_documents()
    sets, u, between = [shingles(r[1]) for r in data], Union(), 0
    for i, a in enumerate(sets):
        u.find(i)
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 9 * both >= 4 * (len(a) + len(b)):
                u.link(i, j)
                between += 20 * both < 9 * (len(a | b) * 2)
    assert between > 50  # pairs from 0.8 to under 0.9
    first = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            first[u.find(i)] = min(first.get(u.find(i), r[0]), r[0])
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(((r[0], first.get(u.find(i))) for i, r in enumerate(data)), key=key)
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted((tuple(r) for r in setjoin.similar_groups(df).collect()), key=key) == want
    # of each group the least (id, digest) stays; rows with one id and other texts are judged each by itself
    keyed = [(r[0], hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else "") for r in data]
    least = {}
    for i, k in enumerate(keyed):
        if k[0] is not None:
            least[u.find(i)] = min(least.get(u.find(i), k), k)
    stay = [r[0] for i, r in enumerate(data) if r[0] is None or keyed[i] == least[u.find(i)]]
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    order = lambda x: -1 if x is None else x
    assert sorted((r.doc_id for r in kept.collect()), key=order) == sorted(stay, key=order)
    assert setjoin.similar_groups(empty(spark)).count() == 0


def test_rows_with_one_id_are_judged_by_their_texts(spark):
    a, b = ("word%d " * 40 % tuple(range(x, x + 40)) for x in (0, 100))
    data = [(1, a, "en", "s", 1), (5, a + "more", "en", "s", 1), (5, b, "en", "s", 1), (7, b, "en", "s", 1), (7, b, "en", "s", 1), (8, None, "en", "s", 0), (8, "", "en", "s", 0), (None, a, "en", "s", 1)]
    kept = setjoin.deduplicate(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept if r.doc_id is not None) == [(1, a), (5, b), (8, "")] and sum(r.doc_id is None for r in kept) == 1


def test_copies_under_one_id_or_none_are_one_document(spark):
    """Rows with one id and text stayed all together, as did all near copies without an id."""
    a, b, c = ("word%d " * 40 % tuple(range(x, x + 40)) for x in (0, 100, 200))
    data = [(1, a, "en", "s", 1), (1, a, "de", "s", 1), (1, a, "en", "s", 1), (2, b, "en", "s", 1), (2, None, "en", "s", 1), (2, None, "de", "s", 1)]
    data += [(None, a, "en", "s", 1), (None, a, "en", "t", 1), (None, a + "more", "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1)]
    docs = documents(spark, data)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    rows = kept.collect()
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in rows if r.doc_id is not None) == [(1, a), (2, ""), (2, b)]
    assert sorted(r.text.removesuffix("more") for r in rows if r.doc_id is None) == [a, c]
    again = corpus_pipeline.drop_near_copies(spark, docs.orderBy("source", "lang"), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, rows)) and set(map(str, rows)) <= set(map(str, docs.collect()))

"""Url verdicts and ranked search, held against their SQL and against plain Python on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from helpers import documents, empty, rows
from pyspark.sql import functions as F

from oddsmith.llm import lexical, queries, urltree

RULES = queries.URL_RULES
PAGES = "page_id long, url string, html string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def pages(spark, urls):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    return df.withColumns({c: F.lit(c) for c in ("host", "path", "n", "segments", "template", "block", "t", "_url", "_rule")})


def odd_urls():
    rng = random.Random(3)
    out = [None, "", "no scheme", "http://", "http://x.com", "http://x.com/", "HTTP://X.Com/A?b#c", "ftp://net/es/1", "http://a.net/es", "http://a.net/es/", "http://anet/es/",
           "https://www.example.com/en/1", "https://a.www.example.com/en/", "https://notexample.com/en/1", "http://example.com/en", "http://x.net:80/fr/", "a://b://c/es/", "http://ü.net/es/é",
           "http://a.org//", "http://a.org/" + "d/" * 400, "http://a.org/" + "q" * 20_000, "http://a.org/'\"[]*/0/deadbeefdeadbeef01"]
    for host in ("big.net", "big.net", "small.net", "big.org", "x.example.com"):
        out += [f"http://{host}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 999)}{rng.choice(['', '/', '.html', '?p=1'])}" for _ in range(60)]
    out += [f"http://slug.org/{rng.choice('abcdefgh') * 5}-{i}/view" for i in range(50)] + ["http://slug.org/about"] * 9
    return out


def brute_rule(host, path):
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_urls_by_rules_and_by_sql(spark):
    urls = odd_urls()
    got = urltree.url_verdicts(pages(spark, urls), RULES).toPandas()
    assert len(got) == len(urls)
    for r in got.itertuples():
        u = urls[r.page_id] or ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S).groups() if "://" in u else ("", "")
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        verdict, rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, null)", [(i, u) for i, u in enumerate(urls)])
    want = con.sql(urltree.oracle(RULES)).df()
    cols = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    a, b = (x[cols].sort_values("page_id").reset_index(drop=True) for x in (got, want))
    assert (a["purity"] - b["purity"]).abs().max() < 1e-12
    a, b = (x.drop(columns="purity").fillna("-").astype(str) for x in (a, b))
    assert (a == b).all().all()


def test_templates_generalise_from_labelled_urls(spark):
    """Labelled pages reject their template's other pages; branches that differ in their labels or shape stay apart."""
    urls = [(f"http://h.org/tag/{w}{i}/list", "block" if i % 3 == 0 else None) for i, w in enumerate(["ab", "cd", "ef", "gh"] * 20)]
    urls += [(f"http://h.org/story/{i}/{w}x", "allow" if i % 3 == 0 else None) for i, w in enumerate(["ab", "cd", "ef", "gh"] * 20)]
    urls += [(f"http://h.org/plain/{i}", None) for i in range(60)]
    df = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(urls)], "page_id long, url string, known string")
    got = {r.page_id: r for r in urltree.url_verdicts(df, [], label="known").collect()}
    assert {got[i].verdict for i in range(80)} == {"block"} and {got[i].verdict for i in range(80, 220)} == {"allow"}
    assert len({got[i].template for i in range(80)}) == 1 and got[0].template != got[80].template
    assert all(r.rule is None for r in got.values())


def test_few_labels_reject_nothing(spark):
    urls = [(f"http://h.org/x/{i}", "block" if i < 5 else None) for i in range(30)]
    df = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(urls)], "page_id long, url string, known string")
    assert {r.verdict for r in urltree.url_verdicts(df, [], label="known").collect()} == {"allow"}


def test_urls_of_no_rows(spark):
    assert urltree.url_verdicts(spark.createDataFrame([], PAGES), RULES).collect() == []


def brute_search(docs, items, k):
    held = [(d, Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = defaultdict(list)
    for at, (item, text) in enumerate(items):
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        scores = []
        for d, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        for r, (s, none, d) in enumerate(sorted(scores)[:k]):
            out[at].append((item, r + 1, None if none else d, -s))
    return sorted((x for v in out.values() for x in v), key=str)


ITEMS = [(1, "An ER then: on ti"), (2, None), (3, ""), (4, "absent word"), (5, "an an an é É AN"), (None, "on the"), (1, "th er"), (1, "th er"), (6, "anthon" * 400)]


@pytest.mark.parametrize("options", [{}, {"block_docs": 7}, {"block_bytes": 500}])
def test_search_against_brute_force(spark, options):
    data = [(d, None if t is None else t.replace("\n", ".\n")) for d, t, *_ in rows()] + [(500 + i, "th er on th") for i in range(40)] + [(499, "th er on th")]
    df = documents(spark, [(d, t, "en", "a", 1) for d, t in data]).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(1) for c in ("term", "block", "batch", "w", "rank", "score")})
    got = lexical.search_documents(df, items, k=5, **options).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(data, ITEMS, 5)


def test_search_batches_and_no_rows(spark, monkeypatch):
    data = [(d, t) for d, t, *_ in rows()]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(lexical, "BATCH_TERMS", 4)
    got = lexical.search_documents(documents(spark), items, k=3).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(data, ITEMS, 3)
    assert lexical.search_documents(empty(spark), items).collect() == []
    assert lexical.search_documents(documents(spark), items.limit(0)).collect() == []


def test_bounds_hold(spark):
    """Every exact impact lies between what its byte says."""
    counts = spark.range(1, 2000).toPandas()["id"].to_numpy()
    for scale in (75, 100, 777, 10**6):
        exact = lexical._impacts(counts, scale)
        steps = -(-exact // lexical.STEP)
        assert (steps <= 250).all() and (exact <= steps * lexical.STEP).all() and (exact > (steps - 1) * lexical.STEP).all()

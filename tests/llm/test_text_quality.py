import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import documents, empty, rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oddsmith.llm import htmlmain, mixing, pii, quality

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="a@.1-+2 0(b)é%", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_personal_data(spark):
    texts = ["mail bob.x@mail.example.com or 10.0.0.256 and 10.1.2.3", "card 4111 1111 1111 1111, +1 (743) 555-3824 4663622617512349 end", "write to bob at mail dot example dot com please", None, "", "9" * 40, "clean words only"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a@b.co")], "doc_id long, text string").withColumn("base", F.lit(1))
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, t in [*enumerate(texts), (None, "a@b.co")]:
        base = brute_spans(t or "")
        flat = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, flat.split(","))) <= set(r.spans.split(",")) and (t or r.spans == "")
    assert got[0].n_email == 1 and got[0].n_ip == 1 and got[6].spans == ""
    assert pii.personal_data(df.limit(0)).count() == 0
    found = pii.candidate_spans(texts[1], pii.base_spans(texts[1]))
    assert [(pii.KINDS[k], texts[1][a:b]) for a, k, b, _ in found] == [("phone", "+1 (743) 555-3824")] or {pii.KINDS[c[1]] for c in found} == {"phone", "card"}


def test_labelers_are_told_apart():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth) * 2 for a in (0.95, 0.9, 0.8, 0.75, 0.6)], axis=1)
    seen = Counter(map(tuple, votes.tolist()))
    v, n = np.array(list(seen)), np.array(list(seen.values()))
    p = pii.fit_labelers(np.zeros(len(v), int), v, n)
    at = {tuple(x): y for x, y in zip(v.tolist(), p)}
    assert np.mean((np.array([at[tuple(x)] for x in votes.tolist()]) > 0.5) == truth) > 0.94


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)


def test_statistics():
    rng = random.Random(2)
    texts = [r[1] for r in rows()] + [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(200)] + ["a\nb\na\n \n \n#", "x|y　z\x85q <>&", "w " * 9, ("a b c d e f g h " * 2).strip()]
    for t in texts:
        assert quality.base_statistics(t) == brute_statistics(t), t


def labelled(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(300):
        junk = i % 5 == 0
        t = words(rng, 60)
        docs.append((i, t.upper().replace(" ", "!! ") if junk else t, "en", "s", len(t)))
        if i % 2 == 0:
            labels.append((i, int(not junk), 0))
    docs += [(None if r[0] is None else r[0] + 1000, *r[1:]) for r in rows()[60:]]
    return documents(spark, docs), spark.createDataFrame(labels + [(0, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    got = quality.quality_verdicts(docs, labels).collect()
    assert len(got) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_statistics(text[r.doc_id])
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 2]
    assert np.mean([r.kept == (r.doc_id % 5 > 0) for r in held]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    none = quality.quality_verdicts(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality.quality_verdicts(empty(spark), labels).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_mixture(spark, seed):
    docs = documents(spark, rows(seed))
    got = mixing.mixture(docs, bucket_rows=4).drop("mix_key").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want = con.sql(mixing.ORACLE).df()
    a, b = (x[sorted(x.columns)].sort_values(["doc_id", "size", "taken"]).reset_index(drop=True) for x in (got, want))
    for c in a.columns:
        assert np.allclose(a[c].astype(float).fillna(-1), b[c].astype(float).fillna(-1), rtol=1e-12), c
    assert (got["taken"] <= 3 * got["size"]).all()
    by = got.assign(source=got["target"]).groupby("source").agg(t=("taken", "sum"), s=("source_size", "first"))
    assert (abs(by["t"] - np.floor(by.index.to_numpy() + 0.5)) <= 3 * 40).all()
    mixed = mixing.mixed_documents(docs, bucket_rows=4)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect()) == got["taken"].sum()
    assert mixing.mixture(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_same_document_under_two_sources(spark):
    """Each source takes its own share, also of documents that other sources hold too; nulls and clashing names are kept."""
    rng = random.Random(4)
    shared = [(i, words(rng, rng.randint(1, 30))) for i in range(40)]
    data = [(i, t, "en", s, len(t)) for i, t in shared for s in ("a", "b", None, "c") if s != "c" or i < 3]
    data += [(None, None, "en", "a", None), (None, "no id", "en", None, 5), (None, "no id", "en", "b", 5), (7, "", "en", "b", 0)]
    docs = documents(spark, data)
    want = Counter()
    for r in mixing._takes(docs, bucket_rows=4).collect():
        want[r.source_key[1:] or None] += r.taken
    got = Counter()
    for r in mixing.mixed_documents(docs, bucket_rows=4).collect():
        got[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.mix_key == "mix_key"
    assert got == want and len(want) == 4


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site-header"><h1>Site</h1><a href=/>Home</a></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies here.</div><!-- <p>gone</p> --><div id="sidebar"><p>A long text at the side that is not of the article at all, in fact.</p></div>
<article><h1>Title &amp; more&am</h1><p><b>First &eacute; paragraph\n  of it<br>and on.<p>Second&nbsp;one with a <a href=x>link</a> in it.</p><div class="ad">Buy now!</div><ul><li>one<li>two</ul>
<section class="comments"><p>I like this article very much, thanks a lot.</p></section></article><form><label>Name</label><button>Go</button></form><footer>&copy; X</footer></body></html>"""


def test_main_text(spark):
    pages = [(1, "u", PAGE), (2, "v", None), (3, None, ""), (None, "w", PAGE), (5, "x", "<p>" + "word and more. " * 20000), (6, "y", "no markup, just a plain sentence that runs on for a while, as such sentences do."), (1, "u", PAGE), (7, "z", "<<<>><a <b></ "), (8, "q", "<nav>only <a href=x>a menu</a>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = htmlmain.extract_main_text(df).collect()
    by = {r.url: r for r in got}
    want = "Title & more&am First é paragraph of it and on. Second one with a link in it. one two"
    assert len(got) == len(pages) and by["u"].text == by["w"].text == want and by["u"].n_chars == len(want)
    assert by["v"].text == "" and by[None].text == "" and by["q"].text == "" and by["y"].text in ("", pages[5][2]) and by["x"].n_chars == len("word and more. " * 20000) - 1
    assert htmlmain.extract_main_text(df.limit(0)).count() == 0


def test_minimum_cut():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 8)
        score = [rng.choice([-2.0, -1.0, -0.3, 0.4, 1.0, 3.0]) for _ in range(n)]
        edges = {(i, j): rng.choice([0.2, 0.5, 1.5]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(side):
            return sum(max(0, s) if not k else max(0, -s) for s, k in zip(score, side)) + sum(c for (a, b), c in edges.items() if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(htmlmain.minimum_cut(score, edges)) == pytest.approx(best)


def test_pages_of_the_test_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html as markup

    for r in htmlmain.extract_main_text(df).join(df.drop("url"), "page_id").collect():
        own = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        assert r.text == " ".join(markup.unescape(re.sub("<[^>]*>", " ", own)).split())



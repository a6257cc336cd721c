"""Main text of web pages by minimum-cut labelling of their text blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize
from .pii import fit_classifier

# Names of elements and words of class and id values, as the HTML standard and common practice have them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr nobr "
    "noscript template svg object select canvas audio video".split()
)
_DROPPED = frozenset("noscript template svg object select canvas audio video".split())  # what they hold isn't text of the page
_RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"  # no markup inside: they run to their end tag
_NOISE_TAGS = frozenset("nav footer aside menu dialog button".split())
_FORM_TAGS = frozenset("form fieldset".split())  # some sites wrap a whole page in a form, so an article inside counts
_CONTENT_TAGS = frozenset("article main".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner promo promotion promoted sponsor sponsored sidebar side menu nav navbar navigation topbar masthead "
    "footer foot header notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments reply replies respond disqus discussion breadcrumb breadcrumbs widget pagination pager toolbar search "
    "copyright legal disclaimer skip tags taglist byline toc rail teaser outbrain taboola".split()
)
_READER_WORDS = frozenset("comment comments reply replies respond disqus discussion".split())
_STORY_WORDS = frozenset("article post entry story".split())
_CONTENT_WORDS = frozenset("content main body text".split())
_QUOTED_TAGS = frozenset("blockquote pre figure".split())  # parts of articles far more often than boilerplate
_LAYOUT_WORDS = frozenset("has with without no not is show hide layout page template theme col columns above below before after".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# a quote opens a value only after "="; one that nothing closes is part of the value
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({_RAW})(?=[\s/>]){_ATTRIBUTES}(?:>|\Z).*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/>"'][^\s=/>]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PARTS = re.compile(r"[a-z]+")
_LEGAL = re.compile(r"©|\ball rights reserved\b|\bcookies?\b|\bsubscribe\b|\badvertis|\bsponsored\b|\bprivacy policy\b|\bsign (?:in|up)\b", re.I)
_END = re.compile(r"[.!?:;…»”\"')\]]\Z")


#: What the markup says of a block, in the unit of the classifier's log odds. Only HIDDEN can't be outvoted.
HIDDEN, NOISE, OPENS_NOISE, DOUBT, PLAIN, HINT, VERBATIM, STORY, ARTICLE = -20.0, -6.0, -4.0, -1.0, 0.0, 0.5, 1.5, 2.5, 3.0
FORM = -4.0
TELLING = 2.0  # markup that says at least this much labels a block for the classifier
FADES = 0.3  # what is left of an ancestor's evidence where an element inside says otherwise


class Block(NamedTuple):
    text: str
    parent: int  # number of the innermost block element
    depth: int
    structure: float  # what the markup says, HIDDEN to ARTICLE
    tag: str
    link_chars: int
    form: int  # number of the outermost form, 0 outside of one


class Marks(NamedTuple):
    evidence: float
    readers: bool  # named as readers' comments: nothing inside is the article


class Open(NamedTuple):
    """An open element: what holds for its text."""

    tag: str
    evidence: float
    readers: bool
    form: int
    block_tag: str
    block: int


OUTSIDE = Open("", PLAIN, False, 0, "", 0)


def _name_parts(token: str) -> list[str]:
    return _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())


def _name_evidence(parts: list[str]) -> float:
    """What a class or id says. The word it ends with names the thing ("news-search"), the one it opens with a part or a
    property of it ("comment-count-zero")."""
    if not parts or parts[0] in _LAYOUT_WORDS:
        return PLAIN
    if parts[-1] in _NOISE_WORDS:
        return NOISE
    if parts[0] in _NOISE_WORDS:
        return NOISE if parts[0] in _READER_WORDS else OPENS_NOISE
    if not _STORY_WORDS.isdisjoint(parts):
        return STORY
    return PLAIN if _CONTENT_WORDS.isdisjoint(parts) else HINT


def _marks(tag: str, attributes: str, inside_article: bool) -> Marks:
    """What an element's own name and attributes say.

    Tags, roles and hiding are certain; names of classes and ids are evidence. Names that contradict each other say
    nothing, unless they speak of readers' comments. A page's root and body carry names of its layout.
    """
    if tag in ("html", "body"):
        return Marks(PLAIN, False)
    certain = tag in _NOISE_TAGS or (tag == "header" and not inside_article)
    holder, readers = tag in _CONTENT_TAGS, False
    names = [PLAIN]
    for m in _ATTR.finditer(attributes):
        name = m[1].lower()
        if name not in ("class", "id", "role", "style", "hidden", "aria-hidden"):
            continue
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden":
            certain = True
        elif name == "aria-hidden":
            certain |= value.lower() == "true"
        elif name == "style":
            certain |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()))
        elif name == "role":
            certain |= value.lower() in _NOISE_ROLES
            holder |= value.lower() in ("main", "article")
        else:
            for token in value.split():
                parts = _name_parts(token)
                names.append(_name_evidence(parts))
                readers |= names[-1] == NOISE and parts[-1] in _READER_WORDS
    if certain:
        return Marks(HIDDEN, False)
    low, high = min(names), max(names)
    if holder:
        # what opens the name of an article element describes the article, and only its end says what it is
        return Marks(NOISE if low == NOISE else ARTICLE, readers)
    if low < 0 and high >= STORY and not readers:
        return Marks(PLAIN, False)
    own = low if low < 0 else high
    if tag in _QUOTED_TAGS and not readers:
        own = max(own, DOUBT)
    return Marks(VERBATIM if tag == "pre" and own == PLAIN else own, readers)


def _inherited(outer: Open, own: Marks) -> float:
    """Evidence of an element: its own and what is left of that around it."""
    if HIDDEN in (outer.evidence, own.evidence):
        return HIDDEN
    if outer.readers:
        return min(outer.evidence, own.evidence)
    if own.evidence >= STORY:
        return min(ARTICLE, own.evidence + FADES * outer.evidence)
    if own.evidence < 0:
        return max(NOISE + DOUBT, own.evidence + (FADES * outer.evidence if outer.evidence > 0 else outer.evidence))
    return min(ARTICLE, outer.evidence + own.evidence)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order. Unclosed and misnested tags are handled; nothing is cut off.

    An element's evidence holds for what is inside; that of an element inside counts more.
    """
    out: list[Block] = []
    text: list[str] = []
    stack: list[Open] = []
    open_tags: Counter = Counter()
    links = link_chars = number = dropped = 0

    def flush() -> None:
        nonlocal link_chars
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                top = stack[-1] if stack else OUTSIDE
                out.append(Block(" ".join(words), top.block, len(stack), top.evidence, top.block_tag, link_chars, top.form))
            text.clear()
        link_chars = 0

    def close(index: int) -> None:
        nonlocal links, dropped
        for t, *_ in stack[index:]:
            links -= t == "a"
            dropped -= t in _DROPPED
            open_tags[t] -= 1
        del stack[index:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not dropped:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                link_chars += len(piece)
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                text.append(" ")
            continue
        tag = tag.lower()
        if tag == "br" or tag == "hr":
            text.append(" ")
            continue
        if tag in _VOID:
            continue
        inline = tag in _INLINE
        if m[2]:
            if not inline:
                flush()
            if open_tags[tag]:
                close(max(i for i, e in enumerate(stack) if e[0] == tag) if stack[-1][0] != tag else len(stack) - 1)
            continue
        if not inline:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i].tag
                if t in _DROPPED:
                    break
                if (t == "p" and tag in _CLOSES_P) or (t == tag and tag in ("li", "option", "tr", "td", "th", "dd", "dt")) or (t == "head" and tag == "body"):
                    close(i)
                    break
                if t not in _INLINE and t != "p":
                    break
            number += 1
        elif tag == "a" and links:
            close(max(i for i, e in enumerate(stack) if e[0] == "a"))
        if m[4].rstrip().endswith("/") and inline:
            continue
        outer = stack[-1] if stack else OUTSIDE
        own = _marks(tag, m[4], outer.evidence > 0)
        form = outer.form or (number if tag in _FORM_TAGS else 0)
        place = (outer.block_tag, outer.block) if inline else (tag, number)
        stack.append(Open(tag, _inherited(outer, own), outer.readers or own.readers, form, *place))
        open_tags[tag] += 1
        links += tag == "a"
        dropped += tag in _DROPPED
    if at < len(page) and not dropped:
        text.append(page[at:])
    flush()
    return out


def features(blocks: list[Block]) -> list[tuple[int, ...]]:
    """Binned features that don't look at the markup's names, for the classifier."""
    out = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        density = b.link_chars / max(1, len(b.text))
        out.append((
            0 if words < 4 else 1 if words < 10 else 2 if words < 25 else 3,
            0 if not b.link_chars else 1 if density < 0.3 else 2 if density < 0.7 else 3,
            int(bool(_END.search(b.text))),
            int(bool(_LEGAL.search(b.text))),
            1 if b.tag in _HEADINGS else 2 if b.tag in ("li", "td", "th", "dd", "dt") else 3 if b.tag == "p" else 0,
            0 if i < 3 else 2 if i >= len(blocks) - 2 else 1,
        ))
    return out


_LEVELS = (4, 4, 2, 2, 4, 3)


def one_hot(rows: list[tuple[int, ...]]) -> np.ndarray:
    a = np.array(rows, np.int64).reshape(-1, len(_LEVELS))
    return np.concatenate([np.eye(n)[a[:, i]] for i, n in enumerate(_LEVELS)], axis=1)


def minimum_cut(score: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut.

    A positive score is the capacity from the source, a negative one that to the sink; edges hold the capacity both
    ways. A node whose own capacity outweighs all its edges lies on that terminal's side; its edges then count as its
    neighbours' own capacities, which may settle them too. Blocking flows over what is left (Dinic's method).
    """
    n = len(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        if c > 0 and a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + c
    score = list(score)
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        a = todo.pop()
        if side[a] is not None or abs(score[a]) < sum(near[a].values()):
            continue
        side[a] = score[a] > 0
        for b, c in near[a].items():
            score[b] += c if side[a] else -c
            del near[b][a]
            todo.append(b)
        near[a] = {}
    left = [a for a in range(n) if side[a] is None]
    if not left:
        return [bool(x) for x in side]

    # arcs come in pairs, k and k ^ 1, each the other's way back
    arcs: list[list[int]] = [[] for _ in range(n)]
    head: list[int] = []
    room: list[float] = []
    for a in left:
        for b, c in near[a].items():
            if a < b:
                arcs[a].append(len(head))
                arcs[b].append(len(head) + 1)
                head += (b, a)
                room += (c, c)
    tiny = 1e-12
    source, sink = [max(0.0, s) for s in score], [max(0.0, -s) for s in score]
    while True:
        level = dict.fromkeys((a for a in left if source[a] > tiny), 0)
        front, depth, ends = list(level), 0, False
        while front and not ends:
            ends = any(sink[a] > tiny for a in front)
            depth += 1
            wave = []
            for a in front:
                for k in arcs[a]:
                    if room[k] > tiny and head[k] not in level:
                        level[head[k]] = depth
                        wave.append(head[k])
            front = wave
        if not ends:
            for a in left:
                side[a] = a in level
            return [bool(x) for x in side]
        place = dict.fromkeys(level, 0)
        for start in [a for a, d in level.items() if d == 0]:
            a, path = start, []
            while source[start] > tiny:
                if sink[a] > tiny:
                    flow = min([source[start], sink[a], *(room[k] for k in path)])
                    source[start] -= flow
                    sink[a] -= flow
                    for k in path:
                        room[k] -= flow
                        room[k ^ 1] += flow
                    full = next((i for i, k in enumerate(path) if room[k] <= tiny), None)
                    if full is not None:
                        a = head[path[full] ^ 1]
                        del path[full:]
                    continue
                while place[a] < len(arcs[a]):
                    k = arcs[a][place[a]]
                    if room[k] > tiny and level.get(head[k], -1) == level[a] + 1:
                        break
                    place[a] += 1
                if place[a] < len(arcs[a]):
                    path.append(k)
                    a = head[k]
                elif path:
                    a = head[path.pop() ^ 1]
                    place[a] += 1
                else:
                    break


def label_blocks(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are article text.

    The classifier's log odds, held to +-3, and the markup's evidence give the capacities to the terminals. Boilerplate
    by name needs no support; a name that an article's own element contradicts leaves the classifier to decide. Forms
    are boilerplate unless they hold half of the page's text: some sites wrap a whole page in one. Neighbours in page
    order and blocks of one parent are joined by smoothness edges, weaker the further apart their depths, and almost
    none where the markup changes its mind.
    """
    odds = np.clip(one_hot(features(blocks)) @ weights, -3, 3).tolist()
    sizes: Counter = Counter()
    for b in blocks:
        if b.structure != HIDDEN:
            sizes[b.form] += len(b.text)
    wraps = {form for form, n in sizes.items() if form and 2 * n >= sizes.total()}
    score = [o + b.structure + (0.0 if not b.form or b.form in wraps else DOUBT if b.structure >= TELLING else FORM) for o, b in zip(odds, blocks)]
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            alike = abs(a.structure - b.structure) < TELLING and a.form == b.form
            edges[i - 1, i] = (1.5 if alike else 0.05) / (1 + abs(a.depth - b.depth))
        j = last.get(b.parent)
        if j is not None:
            edges[j, i] = edges.get((j, i), 0.0) + 1.0
        last[b.parent] = i
    return minimum_cut(score, edges)


def classifier_weights(pages: DataFrame, fit_pages: int) -> np.ndarray:
    """Logistic weights fitted to blocks whose markup is telling, counted by feature pattern (under 800 patterns).

    Uses the fit_pages pages with the least hash of page_id and url; all pages where there are no more.
    """
    keyed = pages.select(F.xxhash64("page_id", "url").alias("sample_key"), "html")
    # keys alone are ordered; the pages stay where they are and meet at most fit_pages keys, which may be broadcast
    keys = materialize(keyed.select("sample_key").orderBy("sample_key").limit(fit_pages).distinct(), "sample_keys")
    # one page of each key, so that repeats don't outgrow the bound
    sample = keyed.join(F.broadcast(keys), "sample_key", "left_semi").groupBy("sample_key").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch["html"]:
                found = blocks_of(page or "")
                for b, f in zip(found, features(found)):
                    if abs(b.structure) >= TELLING:
                        seen[f, b.structure > 0] += 1
        yield pd.DataFrame([("".join(map(str, f)), y, n) for (f, y), n in seen.items()], columns=["pattern", "article", "n"])

    counted = sample.mapInPandas(lean(run), "pattern string, article boolean, n long").groupBy("pattern", "article").agg(F.sum("n").alias("n"))
    rows = counted.orderBy("pattern", "article").collect()
    # a few imagined blocks of either kind, long sentences and short links, keep small samples from odd conclusions
    seen = [(tuple(map(int, r["pattern"])), float(r["article"]), float(r["n"])) for r in rows]
    seen += [((size, 0, 1, 0, tag, place), 1.0, 30.0) for size in (2, 3) for tag in (0, 3) for place in (0, 1, 2)]
    seen += [((0, 3, 0, legal, tag, place), 0.0, 30.0) for legal in (0, 1) for tag in (0, 2) for place in (0, 1, 2)]
    x, y, n = zip(*seen)
    return fit_classifier(one_hot(list(x)), np.array(y), np.array(n))


def extract_main_text(pages: DataFrame, fit_pages: int = 2000) -> DataFrame:
    """One row per page: page_id, url, text of the article (empty if none), n_chars (its code points).

    Null or empty html: an empty text. Null page_id or url and repeated rows: a row each. No rows: no rows. Pages are
    parsed whole, whatever their size; other columns are ignored. The classifier is fitted on a bounded sample of
    fit_pages pages; every page is labelled.
    """
    weights = classifier_weights(pages, fit_pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for page in batch["html"]:
                found = blocks_of(page or "")
                texts.append(" ".join(b.text for b, keep in zip(found, label_blocks(found, weights)) if keep) if found else "")
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(lean(run), "page_id long, url string, text string, n_chars long")

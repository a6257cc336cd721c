"""Personal data: exact base patterns, and further spans by weak supervision (voting labelers, EM, span classifier)."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "validity", "gazetteer", "context", "boundary")
Span = tuple[int, int, int]  # start, kind, end

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind. Same as searching each pattern from left to right, in linear time."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            found.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or "0") <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# Top-level names, country codes, issuer ranges and context words that the labelers look up.
_TLDS = frozenset("com org net edu gov io co de fr es it uk us eu ch at nl be ca au info biz me dev app".split())
_COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_ISSUER = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3[068]|35|6011|64[4-9]|65|62")
_NEAR = (
    re.compile(r"e-?mail|mail|contact|write|reach|correo|courriel|kontakt", re.I),
    re.compile(r"\bip\b|addr|host|server|login|from|client", re.I),
    re.compile(r"card|visa|master|amex|credit|debit|pay|carte|tarjeta|karte", re.I),
    re.compile(r"phone|tel|call|mobile|cell|fax|whatsapp|ruf|appel|llam", re.I),
)
_AGAINST = re.compile(r"version|token|password|isbn|order|invoice|serial|\bv\.?\s*$|[=#$]\s*[\"']?$", re.I)

_AT = r"\s{0,2}(?:[\[({]\s{0,2}at\s{0,2}[\])}]|\sat\s)\s{0,2}"
_DOT = r"(?:\.|\s{0,2}[\[({]\s{0,2}dot\s{0,2}[\])}]\s{0,2}|\sdot\s)"
_HIDDEN_MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_AT}|@)[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}})+", re.I)
_AT_HINT = re.compile(r"[\[({]\s{0,2}at|\sat\s", re.I)  # without it or "@" the pattern above can't match
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_ONE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[ .-][0-9]{4}){2}[ .-][0-9]{2,4}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{4,5})(?![0-9])")
_ONE_PHONE = re.compile(r"(?<![0-9+])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])")


def _luhn_vote(text: str) -> int:
    return 1 if luhn(_NO_DIGIT.sub("", text)) else -1


def _votes(text: str, kind: int, a: int, b: int) -> tuple[int, ...]:
    """One vote of each labeler on a span: 1 for, -1 against, 0 abstains."""
    own, before, after = text[a:b], text[max(0, a - 32) : a], text[b : b + 16]
    digits = _NO_DIGIT.sub("", own)
    if kind == 0:
        tail = re.split(_DOT, own, flags=re.I)[-1].lower()
        form = 1 if re.search(r"[\[({]|\sdot\s", own, re.I) or _DOMAIN.search(own) else -1
        validity = 1 if 2 <= len(tail) <= 24 and tail.isalpha() else -1
        gazetteer = 1 if tail in _TLDS else -1
    elif kind == 1:
        try:
            ipaddress.ip_address(own)
            validity = 1
        except ValueError:
            validity = -1
        form = 1 if own.count(".") == 3 or own.count(":") == 7 or ("::" in own and len(own) > 6) else -1
        gazetteer = 0
    elif kind == 2:
        form = 1 if len(digits) in (14, 15, 16, 19) else -1
        validity = _luhn_vote(own)
        gazetteer = 1 if _ISSUER.match(digits) else -1
    else:
        form = 1 if own[0] in "+(" or own.startswith("00") else 0
        national = digits[-10:]
        validity = 1 if 10 <= len(digits) <= 15 and national[0] not in "01" and len(set(digits)) > 2 else -1
        code = digits[:-10].removeprefix("00") if len(digits) > 10 else ""
        gazetteer = (1 if code in _COUNTRY_CODES else -1) if code else 0
    context = -1 if _AGAINST.search(before) else 1 if _NEAR[kind].search(before) or _NEAR[kind].search(after) else 0
    outer = text[a - 1 : a] + text[b : b + 1]
    boundary = -1 if any(c.isalnum() or c in "_/=" for c in outer) else 1
    return form, validity, gazetteer, context, boundary


def _pattern(kind: int, votes: tuple[int, ...], length: int) -> int:
    """Kind, votes and a length class in one number; what the classifier sees of a span."""
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    return code * 4 + min(3, length // 12)


def _unpacked(pattern: int) -> tuple[int, np.ndarray, int]:
    code, size = divmod(pattern, 4)
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v)
    return code, np.array(votes[::-1]), size


def candidate_spans(text: str, base: list[Span]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, pattern) of looser matches that overlap no base span, leftmost first for each kind."""
    out = []
    starts = [a for a, _, _ in base]
    ends = list(accumulate((b for _, _, b in base), max))  # the furthest end of the spans so far, as kinds may overlap

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or ends[k - 1] <= a

    found = []
    if "@" in text or _AT_HINT.search(text):
        found += [(0, m) for m in _HIDDEN_MAIL.finditer(text)]
    if text.count(":") > 1:
        found += [(1, m) for m in _IP6.finditer(text) if len(m[0]) > 3]
    found += [(2, m) for m in _ONE_CARD.finditer(text)]
    found += [(3, m) for m in _ONE_PHONE.finditer(text)]
    for kind, m in found:
        a, b = m.span()
        if free(a, b):
            out.append((a, kind, b, _pattern(kind, _votes(text, kind, a, b), b - a)))
    out.sort()
    kept: list[tuple[int, int, int, int]] = []
    for c in out:  # a card and a phone can't share digits: the earlier, then the longer one stays
        if not kept or c[0] >= kept[-1][2]:
            kept.append(c)
        elif c[0] == kept[-1][0] and c[2] > kept[-1][2]:
            kept[-1] = c
    return kept


def fit_labelers(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior that a span is real, for each vote pattern, by expectation-maximisation of the labelers' reliabilities.

    votes: 0 against, 1 abstains, 2 for. Each kind has its own prior; a labeler has for each kind and truth a
    distribution over its votes. The start is the share of votes in favour.
    """
    posterior = np.zeros(len(counts))
    for k in np.unique(kinds):
        own = kinds == k
        v, n = votes[own], counts[own].astype(float)
        score = (v - 1).sum(axis=1)
        p = 1 / (1 + np.exp(-1.5 * (score - 0.5)))
        for _ in range(rounds):
            prior = (n @ p + 1) / (n.sum() + 2)
            log = np.stack([np.full(len(v), np.log(1 - prior)), np.full(len(v), np.log(prior))])
            for i in range(v.shape[1]):
                for y, weight in enumerate((n * (1 - p), n * p)):
                    # reliabilities lean to better than chance, which keeps the two classes from changing places
                    table = np.bincount(v[:, i], weights=weight, minlength=3) + np.array([(2.0, 1.0, 0.5), (0.5, 1.0, 2.0)][y])
                    log[y] += np.log(table / table.sum())[v[:, i]]
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            if np.abs(new - p).max() < 1e-9:
                p = new
                break
            p = new
        posterior[own] = p
    return posterior


def fit_classifier(features: np.ndarray, soft: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps over counted patterns."""
    w = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (counts * (soft - p)) - ridge * w
        hessian = (features * (counts * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def pattern_probabilities(patterns: list[int], counts: list[int]) -> dict[int, float]:
    """The span classifier's probability for each pattern seen."""
    if not patterns:
        return {}
    parts = [_unpacked(p) for p in patterns]
    kinds, votes, size = np.array([p[0] for p in parts]), np.stack([p[1] for p in parts]), np.array([p[2] for p in parts])
    n = np.array(counts, float)
    soft = fit_labelers(kinds, votes, n)
    one_hot = [np.eye(4)[kinds], np.eye(4)[size]] + [np.eye(3)[votes[:, i]] for i in range(votes.shape[1])]
    x = np.concatenate(one_hot, axis=1)
    w = fit_classifier(x, soft, n)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {int(k): float(v) for k, v in zip(patterns, p)}


_FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("base", T.StringType())]
    + [T.StructField("seen", T.ArrayType(T.IntegerType()))]
    + [T.StructField("more", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pattern", T.IntegerType())])))]
)


def personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans.

    spans lists kind:start:end of all spans by start, then kind: the base ones, and candidates that no base span
    overlaps, that no check of validity (digits, ranges) refutes and that the classifier gives at least `least`. Labelers vote on base spans and candidates of the whole
    corpus; votes are counted by pattern (fewer than 4000 can exist, so the driver's share is bounded), EM estimates
    reliabilities from the counts, and a logistic span classifier is fitted to its posteriors. Offsets are code points.

    Null or empty text: zeros, the digest of nothing, no spans. Null doc_id and repeated rows: a row each. No rows: no
    rows. Texts are searched whole; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digit = re.compile(r"[0-9]")
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                doc = None if pd.isna(doc) else int(doc)
                if not text or not (digit.search(text) or "@" in text or text.count(":") > 1 or _AT_HINT.search(text)):
                    rows.append((doc, 0, 0, 0, 0, empty, "", [], []))
                    continue
                base = base_spans(text)
                n = [sum(1 for s in base if s[1] == k) for k in range(4)]
                flat = joined(base)
                seen = [_pattern(k, _votes(text, k, a, b), b - a) for a, k, b in base]
                rows.append((doc, *n, hashlib.sha256(flat.encode()).hexdigest(), flat, seen, candidate_spans(text, base)))
            yield pd.DataFrame(rows, columns=_FOUND.names).astype({"doc_id": "Int64"})

    found = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(lean(run), _FOUND), "found")
    patterns = F.concat("seen", F.transform("more", lambda m: m["pattern"]))
    counted = found.select(F.explode(patterns).alias("pattern")).groupBy("pattern").count().orderBy("pattern").collect()
    probability = pattern_probabilities([r["pattern"] for r in counted], [r["count"] for r in counted])
    accepted = F.array(*[F.lit(p) for p, v in sorted(probability.items()) if v >= least and _unpacked(p)[1][1] > 0]).cast("array<int>")
    added = F.filter("more", lambda m: F.array_contains(accepted, m["pattern"]))
    names = F.array(*[F.lit(k) for k in KINDS])
    whole = F.split("base", ",")
    base_rows = F.when(F.col("base") == "", F.array().cast("array<struct<start:int,kind:int,end:int>>")).otherwise(
        F.transform(whole, lambda s: F.struct(
            F.element_at(F.split(s, ":"), 2).cast("int").alias("start"),
            (F.array_position(names, F.element_at(F.split(s, ":"), 1)) - 1).cast("int").alias("kind"),
            F.element_at(F.split(s, ":"), 3).cast("int").alias("end"),
        ))
    )
    more_rows = F.transform(added, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    spans = F.array_join(
        F.transform(F.array_sort(F.concat(base_rows, more_rows)), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"))

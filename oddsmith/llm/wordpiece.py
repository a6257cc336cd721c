"""Token counts by a linear longest-match automaton over a trie with failure links and popped-token counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .tokens import public_path

VOCABULARY = "byte_bpe_50k.tiktoken"
_AUTOMATA: dict = {}


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a ranks file. A piece that opens with a space starts a word; one without blank bytes continues it."""
    import base64

    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in pieces if (body := p.removeprefix(b" ")) and body.split() == [body]]


class LongestMatch:
    """Counts the pieces of greedy longest-match-first splitting in one pass over the bytes, building no piece.

    For a trie node that spells s: popped(s) is how many pieces are certain to be cut from the front of s once the next
    byte does not extend it, failure(s) is the node of what is left. Reading a byte, the automaton follows failure
    links until the byte extends the node, adding the popped counts. A word ends as if by a byte that extends nothing.
    Every single byte is a piece here, opening and continuing alike, so a split always exists.
    """

    def __init__(self, pieces: list[bytes]):
        pieces = sorted({*pieces, *(bytes([b]) for b in range(256))})
        child: list[dict[int, int]] = [{}]
        spells = [False]
        for p in pieces:
            at = 0
            for b in p:
                nxt = child[at].get(b)
                if nxt is None:
                    nxt = child[at][b] = len(child)
                    child.append({})
                    spells.append(False)
                at = nxt
            spells[at] = True
        n = len(child)
        failure, popped = [-1] * n, [0] * n
        queue = [0]
        for node in queue:
            for b, to in child[node].items():
                queue.append(to)
                if spells[to]:
                    failure[to], popped[to] = 0, 1
                else:
                    z, count = failure[node], popped[node]
                    while z >= 0 and b not in child[z]:
                        count += popped[z]
                        z = failure[z]
                    failure[to], popped[to] = (child[z][b], count) if z >= 0 else (-1, count)
        self.goto = np.full((n, 256), -1, np.int32)
        for node, own in enumerate(child):
            for b, to in own.items():
                self.goto[node, b] = to
        self.failure, self.popped = np.array(failure, np.int32), np.array(popped, np.int32)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; words advance together, a byte at a time."""
        total = np.zeros(len(words), np.int64)
        if not words:
            return total
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = (np.cumsum(lengths) - lengths)[order]
        falling = -lengths[order]
        state, sums = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        for k in range(int(lengths.max())):
            m = int(np.searchsorted(falling, -k))  # words longer than k
            byte, cur = raw[first[:m] + k], state[:m]
            nxt = self.goto[cur, byte]
            left = np.flatnonzero(nxt < 0)
            while len(left):
                sums[left] += self.popped[cur[left]]
                cur[left] = self.failure[cur[left]]
                nxt[left] = self.goto[cur[left], byte[left]]
                left = left[nxt[left] < 0]
            state[:m] = nxt
        left = np.flatnonzero(state > 0)
        while len(left):
            sums[left] += self.popped[state[left]]
            state[left] = self.failure[state[left]]
            left = left[state[left] > 0]
        total[order] = sums
        return total


def automaton(path: str) -> LongestMatch:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = LongestMatch(read_vocabulary(path))
    return _AUTOMATA[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens (pieces of all its words), max_word_tokens.

    A word is a maximal run of bytes outside the six ASCII blanks; a space is set before it, and it is split greedily
    by the longest piece of the vocabulary. Null, empty or blank text: zeros. Null doc_id and repeated rows: a row
    each. No rows: no rows. A word of any length is taken whole; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = automaton(path or public_path(VOCABULARY))
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                split = [(t or "").encode("utf-8", "surrogatepass").split() for t in part["text"]]
                place: dict[bytes, int] = {}
                index = np.fromiter((place.setdefault(w, len(place)) for words in split for w in words), np.int64)
                n = np.fromiter(map(len, split), np.int64, len(split))
                per = counter.counts([b" " + w for w in place])[index]
                ends = np.cumsum(n)
                sums = np.r_[0, np.cumsum(per)]
                most = np.zeros(len(n), np.int64)
                full = np.flatnonzero(n)
                if len(full):
                    most[full] = np.maximum.reduceat(per, (ends - n)[full])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "n_words": n, "n_tokens": sums[ends] - sums[ends - n], "max_word_tokens": most})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(lean(run), "doc_id long, n_words long, n_tokens long, max_word_tokens long")

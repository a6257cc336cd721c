"""Byte-pair encoding of whole texts with the tokenizers library, sharing the work on repeated words."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENCODERS: dict = {}
CHUNK = 12_000_000  # characters that are worked on at a time; a longer text is a chunk of its own
MOST = 600_000  # pieces of a generation of the cache
MARKS = ".,!?;:*%&#$|"
_CUT = "\x00"


def _strung(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that begin at start, one after another, and their ends."""
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0)
    place += np.repeat(start - (ends - size), size)
    return flat.take(place), ends


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings from their bytes and ends."""
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data))


class _Pieces:
    """Different pieces and their ids, in arrays."""

    def __init__(self) -> None:
        self.names = pa.array([], pa.large_string())
        self.flat, self.start, self.size = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self.names)

    def find(self, names: pa.Array) -> np.ndarray:
        """Place of each name, -1 where it isn't known."""
        return pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, names: pa.Array, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Take in names that aren't known, and return their places."""
        n = len(self)
        self.names = pa.concat_arrays([self.names, names])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        return np.arange(n, len(self))


class _Seen(_Pieces):
    """A cache in two generations.

    When the young generation is full it becomes the old one, and the old one goes; what is looked up again returns to the
    young one. So pieces that keep occurring stay, whatever else is met.
    """

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, _Pieces()

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = _Pieces()
            self.old.__dict__.update({k: self.__dict__[k] for k in self.old.__dict__})
            self.__dict__.update(_Pieces().__dict__)

    def places(self, names: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Place of each of different names, after learning those that neither generation knows; learn tells which of them have
        ids of their own, these ids, and how many each has. The others' place is -1."""
        at = self.find(names)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = names.take(pa.array(missing))
            was = self.old.find(new)
            again = was >= 0
            if again.any():
                own, size = was[again], self.old.size[was[again]]
                at[missing[again]] = self.add(new.filter(pa.array(again)), _strung(self.old.flat, self.old.start[own], size)[0], size)
            unknown, missing = new.filter(pa.array(~again)), missing[~again]
            if len(missing):
                whole, flat, size = learn(unknown)
                at[missing[whole]] = self.add(unknown.filter(pa.array(whole)), flat, size)
        return at


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: those that print stand for themselves,
    the others for characters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


#: Characters of texts whose lower case is that of their letters one by one, in any library.
_ODD = re.compile(r"[^\t\n\x20-\x7e\xa1-\u012f\u0131-\u017f]")


#: Letters of alphabets that every version of Unicode's tables agrees on, behind a space or not.
_SIMPLE = "^ ?[A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+$"


class WordCachedEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; equal to Tokenizer.encode(text, add_special_tokens=False).

    Two kinds of vocabulary: one drops white space, so that any of it separates pre-tokens; in the other a single space
    between two other characters opens the next pre-token, and a single line feed is one of its own. A text is split
    there, each different piece is encoded once, and the ids are joined. Marks that end a piece of letters are a pre-token
    of their own and are cut off. A word of letters alone is one pre-token, so the library's merges are applied to it
    without the vocabulary's patterns and normalisation; where the vocabulary lowers case, texts are lowered first. Texts
    with other runs of white space are encoded whole where it isn't dropped. The cache holds two generations of `most` pieces,
    each with those of the `chunk` of characters that fills it; both bound memory and change no result.
    """

    def __init__(self, path: str, most: int = MOST, chunk: int = CHUNK):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.chunk = chunk
        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.drops_spaces = ids(" a") == ids("a")
        self.lowers = ids("A") == ids("a")
        self.cache, self.tails = _Seen(most), {}
        self.simple = re.compile(_SIMPLE)
        self.bare = Tokenizer(self.tokenizer.model)  # one model in memory; words of letters hold no added token
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = _byte_letters()
        self.letters = {b: c for b, c in letters.items() if b != 10}
        self.mark = letters[1]
        self.mark_id = self.bare.encode(self.mark, add_special_tokens=False).ids[0]
        # whether an id can only open a word: its letters begin with a space's
        self.opens = np.zeros(self.bare.get_vocab_size(), bool)
        self.opens[[i for token, i in self.bare.get_vocab().items() if token.startswith(letters[32])]] = True
        for t in (self.tokenizer, self.bare):
            resize = getattr(t.model, "_resize_cache", None)
            if resize:
                resize(256)  # the pieces are different, so the library's own cache would only fill

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many different words of letters from one call, and how many each has. A control character's id marks their
        ends, but where all open with a space: then their first ids tell."""
        text, spaced = "\n".join(words), not self.drops_spaces and all(w[0] == " " for w in words)
        text = text.replace(" ", self.letters[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        text = text.replace("\n", " ") if spaced else text.replace("\n", f" {self.mark} ") + f" {self.mark}"
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        if spaced:
            return ids, np.diff(np.flatnonzero(self.opens.take(ids)), append=len(ids))
        mark = ids == self.mark_id
        return ids[~mark], np.diff(np.flatnonzero(mark), prepend=-1) - 1

    def _whole(self, piece: str) -> bool:
        """Whether a piece's ids are the same wherever it stands."""
        if self.drops_spaces or piece == "\n":
            return True
        own = piece[1:] if piece[:1] == " " else piece
        return own != "" and not own[0].isspace() and not own[-1].isspace()

    def _learn(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode pieces, but for those that depend on what stands around them: which were encoded, their ids, and how many."""
        pieces = names.to_pylist()
        simple = pc.match_substring_regex(names, _SIMPLE).to_numpy(zero_copy_only=False)
        if self.lowers:
            simple &= np.fromiter(map(str.islower, pieces), bool, len(pieces))
        others = [i for i in np.flatnonzero(~simple).tolist() if self._whole(pieces[i])]
        words = np.flatnonzero(simple)
        # words that open with a space first, as their calls cost less
        spaced = np.fromiter((pieces[i][0] == " " for i in words.tolist()), bool, len(words))
        order = [*(w[i : i + 1024] for w in (words[spaced], words[~spaced]) for i in range(0, len(w), 1024))]
        found = [self._encode_words([pieces[i] for i in own.tolist()]) for own in order]
        rest = self._encode([pieces[i] for i in others])
        flat = np.concatenate([np.empty(0, "<u4"), *[f for f, _ in found], np.frombuffer(b"".join(rest), "<u4")])
        size, start = np.zeros((2, len(pieces)), np.int64)
        at = np.concatenate([*order, np.array(others, np.int64)])
        size[at] = np.concatenate([*[n for _, n in found], np.array([len(r) // 4 for r in rest], np.int64)])
        start[at] = np.cumsum(size[at]) - size[at]
        whole = simple
        whole[others] = True
        return whole, _strung(flat, start[whole], size[whole])[0], size[whole]

    def _tail(self, marks: str) -> bytes:
        found = self.tails.get(marks)
        if found is None:
            if len(self.tails) > 50_000:
                self.tails.clear()
            found = self.tails[marks] = self._encode([marks])[0]
        return found

    def _prepared(self, text: str) -> str:
        """The text with a mark where it is split."""
        if self.drops_spaces:
            return (text if _ODD.search(text) else text.lower()).replace("\n", " ")
        return text.replace(" ", _CUT + " ").replace("\n", f"{_CUT}\n{_CUT}").removeprefix(_CUT).removesuffix(_CUT)

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        # millions of small objects and no cycles: the collector would only walk them again and again
        was = gc.isenabled()
        gc.disable()
        try:
            out: list[bytes] = []
            held: list[str] = []
            size = 0
            for t in texts:
                held.append(t or "")
                size += len(held[-1])
                if size >= self.chunk:
                    out += self._ids(held)
                    held, size = [], 0
            return out + self._ids(held) if held else out
        finally:
            if was:
                gc.enable()

    def _tails(self, pieces: pa.Array, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the marks that end pieces, length bytes of each: a flat array, and each piece's start there and size."""
        marked = np.flatnonzero(length)
        _, offsets, data = pieces.buffers()
        ends = np.frombuffer(offsets, np.int64)[pieces.offset + 1 :].take(marked)
        tails = _strings(*_strung(np.frombuffer(data or b"", np.uint8), ends - length[marked], length[marked])).dictionary_encode()
        ids = [self._tail(t) for t in tails.dictionary.to_pylist()]
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        start, size = np.zeros((2, len(pieces)), np.int64)
        of = tails.indices.to_numpy(zero_copy_only=False)
        start[marked], size[marked] = (np.cumsum(sizes) - sizes)[of], sizes[of]
        return np.frombuffer(b"".join(ids), "<u4"), start, size

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Pieces are told apart in Arrow; Python sees each new piece once, and ids are laid out by NumPy."""
        self.cache.turn()
        split = pc.split_pattern(pa.array(map(self._prepared, texts), pa.large_string()), " " if self.drops_spaces else _CUT)
        bounds = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        at, pieces = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        cores = pc.utf8_rtrim(pieces, MARKS)
        cores = pc.if_else(pc.match_substring_regex(cores, _SIMPLE), cores, pieces)
        marks = pc.subtract(pc.binary_length(pieces), pc.binary_length(cores)).to_numpy(zero_copy_only=False)
        tails, tail_start, tail_size = self._tails(pieces, marks)
        coded = cores.dictionary_encode()
        place = self.cache.places(coded.dictionary, self._learn)[coded.indices.to_numpy(zero_copy_only=False)]
        blank = place < 0
        # a piece's ids are those of its core, then those of its marks
        runs, sizes = np.zeros((2, len(pieces), 2), np.int64)
        runs[~blank, 0], sizes[~blank, 0] = self.cache.start[place[~blank]], self.cache.size[place[~blank]]
        runs[:, 1], sizes[:, 1] = tail_start + len(self.cache.flat), tail_size
        flat, _ = _strung(np.concatenate([self.cache.flat, tails]), runs.ravel(), sizes.ravel())
        size = sizes.sum(axis=1)
        start = np.cumsum(size) - size
        del coded, pieces, cores, runs, sizes, place
        out: list[bytes] = []
        step = 0
        while step < len(texts):
            stop = max(step + 1, int(np.searchsorted(bounds, bounds[step] + 500_000, "right")) - 1)
            own = at[bounds[step] : bounds[stop]]
            laid, ends = _strung(flat, start[own], size[own])
            raw = laid.tobytes()
            cuts = (np.r_[0, ends][bounds[step : stop + 1] - bounds[step]] * 4).tolist()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            step = stop
        # texts that hold a run of spaces, or white space at an end of a piece
        odd = np.unique(np.searchsorted(bounds, np.flatnonzero(blank[at]), "right") - 1).tolist()
        if not self.drops_spaces:
            odd = sorted({*odd, *[i for i, t in enumerate(texts) if _CUT in t]})
        for i, x in zip(odd, self._encode([texts[i] for i in odd])):
            out[i] = x
        return out


def encoder(path: str, most: int = MOST, chunk: int = CHUNK) -> WordCachedEncoder:
    """One encoder for each vocabulary, size and Python worker."""
    key = path, most, chunk
    if key not in _ENCODERS:
        _ENCODERS[key] = WordCachedEncoder(*key)
    return _ENCODERS[key]


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)

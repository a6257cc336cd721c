import bisect
import sys
import tracemalloc
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from helpers import documents, empty, rows
from tokenizers import Tokenizer

from oddsmith.llm import packing, rangecoder, tokenfiles, wordpiece
from oddsmith.llm.tokens import WordCachedEncoder, encoder, public_path

ODD = [
    "", None, " a", "a ", "a  b", "a\n b", "a \nb", "<|endoftext|> a", "a <|startoftext|>b", "e ́x", "  ", "\n", "it's 's", "　 z", "a \x1c b", "x\x01 y", "a\nb", "a.\nB c\n\nd", "x\n\ty", "q.\n*w",
    "e\n's d", "x foo. bar!! Baz*** É.. q.. 5.. a.b. ...  a,b, it.s. İ. don. x<|endoftext|>. k", "ab" * 3000,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_is_that_of_the_library(name):
    fast, plain = WordCachedEncoder(public_path(name), most=50), Tokenizer.from_file(public_path(name))
    texts = ODD + [r[1] for r in rows()]
    for _ in range(2):
        for t, ids in zip(texts, fast(texts)):
            assert ids == np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t


def test_the_cache_is_bounded_by_chunks():
    """The pieces of all texts of a call were held, however few the cache should hold."""
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(200)]
    small, plain = WordCachedEncoder(public_path("word_bpe_49k.json"), most=100, chunk=500), encoder(public_path("word_bpe_49k.json"))
    assert small(texts) == plain(texts)
    assert len(small.cache) + len(small.cache.old) <= 2 * (100 + 500)


def test_known_pieces_are_held_in_arrays():
    """Each piece and its ids were two Python objects, over 200 bytes, and each lookup of one went through both."""
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(20_000)]
    texts = [" ".join(names[i : i + 100]) + " Éa ñu\nÀb." for i in range(0, len(names), 100)]
    fast, plain = WordCachedEncoder(public_path("byte_bpe_50k.json")), Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    fast(texts[:1])
    tracemalloc.start()
    try:
        first = fast(texts)
        held = tracemalloc.get_traced_memory()[0] - sum(map(sys.getsizeof, first))
    finally:
        tracemalloc.stop()
    assert len(fast.cache) > 19_000 and held < 100 * len(fast.cache)
    assert first == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    fast.cache.most = 10_000  # what is known moves to the old generation, and back as it is met again
    again = len(fast.cache)
    assert fast(texts[:50]) == first[:50] and len(fast.cache.old) == again and 4_000 < len(fast.cache) < 6_000


def test_place():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 101, 3000)
    bins, offsets = packing.place(sizes, 100)
    used = defaultdict(list)
    for b, o, s in zip(bins, offsets, sizes):
        used[b].append((o, s))
    for own in used.values():
        at = 0
        for o, s in sorted(own):
            assert o == at
            at += s
        assert at <= 100
    gaps, best = [], 0  # best fit in falling order
    for s in sorted(sizes.tolist(), reverse=True):
        i = bisect.bisect_left(gaps, s)
        best += i == len(gaps)
        gap = gaps.pop(i) if i < len(gaps) else 100
        if gap > s:
            bisect.insort(gaps, gap - s)
    assert len(used) <= best * 1.002
    assert len(set(packing.place(np.array([60, 60, 40, 40]), 100)[0])) == 2


def test_pack_documents(spark):
    plain = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    got = packing.pack_documents(documents(spark), capacity=256).collect()
    want = []
    for d, t, *_ in rows():
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d, k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 256 and all(sum(n for _, n in sorted(v)[:i]) == o for i, (o, _) in enumerate(sorted(v))) for v in used.values())
    assert len(used) <= -(-sum(r.length for r in got) // 256) + 1
    assert sorted(map(key, got)) == sorted(map(key, packing.pack_documents(documents(spark), capacity=256).collect()))
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_in_the_pipeline_sends_few_texts_at_a_time(spark, monkeypatch):
    """Workers were sent 10,000 whole texts at a time, whatever the encoder's own bounds."""
    setting, sent = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, written = spark.conf.get(setting), packing.materialize

    def noted(df, name):
        sent.append((name, int(spark.conf.get(setting))))
        return written(df, name)

    monkeypatch.setattr(packing, "materialize", noted)
    got = corpus_pipeline.pack(spark, documents(spark), "").collect()
    assert sent == [("pieces", 500)] and spark.conf.get(setting) == before
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted(map(key, packing.pack_documents(documents(spark), batch_rows=7).collect()))


def test_range_coder():
    rng = np.random.default_rng(2)
    ids = [rng.zipf(1.3, n).astype(np.int64) % 50257 for n in (0, 1, 700, 5000, 3)] + [np.full(900, 65535), np.tile([5, 9, 11], 400)]
    raw = [x.astype("<u4").tobytes() for x in ids]
    image = rangecoder.write_segment([3, None, -5, 7, 7, 8, 9], raw, block=512)
    documents_, back = rangecoder.read_segment(image)
    assert back.tobytes() == b"".join(raw) and documents_["ids"].tolist() == list(map(len, ids)) and documents_["doc_id"].tolist()[1] == rangecoder.NO_ID
    assert len(rangecoder.write_segment([1], [raw[6]], 2048)) < 400
    for at in (8, 30, len(image) - 40):
        bad = bytearray(image)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            rangecoder.read_segment(bytes(bad))
    with pytest.raises(ValueError):
        rangecoder.read_segment(image[:-1])
    with pytest.raises(ValueError):
        rangecoder.write_segment([1], [np.array([1 << 16], "<u4").tobytes()])
    assert rangecoder.read_segment(rangecoder.write_segment([], []))[1].size == 0


def test_blocks_are_independent():
    ids = np.tile(np.arange(64), (3, 4)).astype(np.int32)
    one = rangecoder.encode_blocks(ids, np.array([256, 256, 100]))
    assert one[0] == one[1] == rangecoder.encode_blocks(ids[:1], np.array([256]))[0]


def test_blocks_of_a_group_learn_together():
    """Each block had tables of its own, which took as much time and room as all else."""
    rng = np.random.default_rng(3)
    ids, sizes = (rng.zipf(1.2, (37, 128)) % 50257).astype(np.int32), np.r_[np.full(36, 128), 50]
    ids[36, 50:] = 0
    alone, together = rangecoder.encode_blocks(ids, sizes), rangecoder.encode_blocks(ids, sizes, 16)
    assert sum(map(len, together)) < 0.95 * sum(map(len, alone))
    for payloads, group in ((alone, 1), (together, 16)):
        assert (rangecoder.decode_blocks(payloads, sizes, group) == ids).all()
    assert rangecoder.encode_blocks(ids[16:32], sizes[16:32], 16) == together[16:32]  # groups don't depend on each other
    image = bytearray(rangecoder.write_segment([1], [ids[:36].astype("<u4").tobytes()], 128))
    image[20] ^= 1
    with pytest.raises(ValueError):
        rangecoder.read_segment(bytes(image))


def test_an_id_is_narrowed_at_once():
    """A missed id was narrowed three times, each with writes of single bytes, and four bytes ended a block: 6 and 2,144 here."""
    ids, sizes = np.full((3, 1), 777, np.int32), np.ones(3, np.int64)
    payloads = rangecoder.encode_blocks(ids, sizes)
    assert max(map(len, payloads)) <= 4 and (rangecoder.decode_blocks(payloads, sizes) == ids).all()
    rng = np.random.default_rng(5)
    ids, sizes = rng.integers(0, 1 << 16, (9, 1024)).astype(np.int32), np.r_[np.full(8, 1024), 1]  # all miss: carries run far
    ids[8, 1:] = 0
    payloads = rangecoder.encode_blocks(ids, sizes, 4)
    assert (rangecoder.decode_blocks(payloads, sizes, 4) == ids).all() and max(map(len, payloads)) < 2140
    for n in (0, 1, 2, 7, 300):  # anything is decoded to its end, and told by its checksum
        assert rangecoder.decode_blocks([rng.bytes(n)] * 9, sizes, 4).shape == (9, 1024)


def test_texts_are_encoded_by_their_characters():
    """3,000 texts were encoded at a time, however short or long."""
    batch = pd.DataFrame({"doc_id": range(6), "text": ["ab", None, "abc", "a" * 9, "", "abcde"]})
    assert [r["doc_id"].tolist() for r in tokenfiles.by_characters(batch, 5)] == [[0, 1, 2], [3], [4, 5]]
    assert len(list(tokenfiles.by_characters(pd.DataFrame({"doc_id": range(4000), "text": ["a"] * 4000}), 5000))) == 1
    assert list(tokenfiles.by_characters(batch[:0], 5)) == []


def test_no_segment_is_a_small_rest():
    """6.7 million ids made segments of 3, 3 and 0.7 million; the last took twice the time of an id."""
    run = lambda sizes, most: [[len(x) // 4 for _, x in r] for r in tokenfiles.by_ids(((1, b"abcd" * n) for n in sizes), most)]
    assert list(map(sum, run([1] * 67, 30))) == [30, 37] and list(map(sum, run([1] * 76, 30))) == [30, 30, 16]
    assert run([], 5) == [] and run([1, 1], 5) == [[1, 1]] and run([9, 1, 1, 40, 1, 9, 0], 4) == [[9], [1, 1, 40], [1, 9, 0]]


def test_token_files(spark):
    plain = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    got = tokenfiles.token_file_index(documents(spark), block=128, segment_ids=900).collect()
    at, want = 0, []
    for d, t, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenfiles.token_file_index(empty(spark)).count() == 0


def test_token_counts(spark):
    vocabulary = set(wordpiece.read_vocabulary(public_path(wordpiece.VOCABULARY))) | {bytes([b]) for b in range(256)}
    longest = max(map(len, vocabulary))

    def pieces(w):
        n = i = 0
        while i < len(w):
            i += next(k for k in range(min(longest, len(w) - i), 0, -1) if w[i : i + k] in vocabulary)
            n += 1
        return n

    got = wordpiece.token_counts(documents(spark)).collect()
    want = []
    for d, t, *_ in rows():
        per = [pieces(b" " + w) for w in (t or "").encode().split()]
        want.append((d, len(per), sum(per), max(per, default=0)))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    a = wordpiece.automaton(public_path(wordpiece.VOCABULARY))
    odd = [b"", b" ", b" " + b"a" * 5000, b" \xff\xfe\x00", " é中文".encode(), b" aaaaab"]
    assert a.counts(odd).tolist() == list(map(pieces, odd))
    tiny = wordpiece.LongestMatch([b" a", b"abcd", b"abcde", b"bc", b"efgz"])
    own = {b" a", b"abcd", b"abcde", b"bc", b"efgz", *(bytes([b]) for b in range(256))}
    vocabulary, longest = own, 5
    for w in (b" aabcdefgh", b"abcdef", b" abcdz", b"bcbc"):
        assert tiny.counts([w])[0] == pieces(w)
    assert wordpiece.token_counts(empty(spark)).count() == 0
    assert encoder(public_path("byte_bpe_50k.json")) is encoder(public_path("byte_bpe_50k.json"))

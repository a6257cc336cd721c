"""Token ids as compact binary segments: an adaptive context-mixing range coder in groups of blocks that are reset independently.

Format of a segment (all integers little-endian):

    magic "OSRC", version u16, block ids u16, blocks u32, documents u32, crc32 of the group and the tables u32, group u16,
    block table: per block ids u32, payload bytes u32, crc32 of its ids (u32 each) u32,
    document table: per document doc_id i64 (the least number for null), ids u32,
    payloads in order.

A block codes its ids one by one. Order-2 and order-1 tables, indexed by a hash of the ids before, name the id that came
last after that context, with a trust that its hits raise. The more trusted of the two is the candidate. Three estimates that it
is next - the hit rates of the order-2 and order-1 trusts, and the candidate's standing in the order-0 statistics - are mixed in
the logistic domain with weights that learn; the mix drives a binary range coder. On a miss the id is coded by the order-0
statistics of its high and its low byte. The coder's numbers have 64 bits, so that an id narrows the span once, and 16 bits leave
at a time; a payload is such words, high byte first, and zeros follow it. `group` consecutive blocks have tables and statistics in common and go through them
in step, an id of each at a time; rates and order-0 statistics are counted up between refreshes. Weights are each block's own.
All state starts anew in each group, so groups are independent: they are coded side by side, a lane for each block, in
arithmetic that gives the same bytes on any machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"OSRC"
HEADER = struct.Struct("<4sHHIIIH")
NO_ID = -(1 << 63)
BLOCK = 1024
TABLE_BITS = 11
TABLE = 1 << TABLE_BITS  # contexts of an order and group
BITS, UNITS = 12, 14  # of a hit's probability, and of the order-0 statistics of a byte
WORD = 16  # bits that leave the coder at a time; a span below 2**48 is widened by so many
REFRESH = 64  # ids of a lane between two rebuilds of the order-0 statistics
EARLY = {1, 2, 4, 8, 16, 32}  # and steps with one before
GROUP = 64  # blocks that learn together
ONE = 1 << BITS
_U = np.arange(ONE + 1, dtype=np.uint64)  # numbers of the coder's type
_LEAST = _U[1] << _U[64 - WORD]

_x = np.arange(4096)
_p = (_x + 0.5) / 4096
STRETCH = np.clip(np.rint(np.log(_p / (1 - _p)) * 256), -2047, 2047).astype(np.int32)
SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-(_x - 2048) / 256))), 1, 4095).astype(np.int32)
#: Trust after a miss and, from 8 on, after a hit.
TRUST = np.array([max(x >> 1, 1) for x in range(8)] + [min(x + 1, 7) for x in range(8)], np.int32)


class _Model:
    """The state of all lanes, in flat arrays. Lanes of a group have tables and order-0 statistics in common; where two of them
    write one entry in a step, the later lane's stays."""

    def __init__(self, lanes: int, group: int):
        n = self.n = -(-lanes // group)
        self.of = np.arange(lanes) // group
        self.base256 = self.of * 256
        # order 2, then order 1
        self.base, self.base16 = (np.stack([self.of * k, (self.of + n) * k]) for k in (TABLE, 16))
        self.table = np.zeros(2 * n * TABLE, np.int32)  # id << 3 | trust
        # misses and hits by trust, 16 of each order and group: those of an order start at the rates that are usual
        usual = [np.arange(8) * a + b for a, b in ((450, 200), (400, 150))]
        self.tried = np.concatenate([np.tile(np.r_[4096 - u, u] >> 6, n) for u in usual])
        self.weights = np.repeat(np.array([[22000], [16000], [6000]], np.int32), lanes, axis=1)
        self.inputs = np.empty((3, lanes), np.int32)
        self.seen = np.zeros(n * 256, np.int64)  # ids so far by a hash of the id
        self.standing = np.full(n * 256, STRETCH[64], np.int32)
        self.high, self.low = np.ones(n * 256, np.int64), np.ones(n * 256, np.int64)
        self.fresh, self.tries = np.empty((REFRESH, lanes), np.int64), np.empty((REFRESH, 2, lanes), np.int64)  # since the last refresh
        self.count = 0
        self.last1, self.last2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.mixed = np.empty((2, lanes), np.uint32)
        self.step = 0
        self.refresh()

    def refresh(self) -> None:
        """Intervals from the counts, 2**UNITS in all with at least 1 each, and standings; the same in coder and decoder. The last
        interval is the whole, for lanes that don't code a byte."""
        if self.count:
            ids, tries = self.fresh[: self.count], self.tries[: self.count]
            self.count = 0
            for name, at, more in (("seen", self.slot(ids) + self.base256, 1), ("high", (ids >> 8) + self.base256, 24), ("low", (ids & 255) + self.base256, 24), ("tried", tries, 1)):
                counts = getattr(self, name)
                counts += np.bincount(at.ravel(), minlength=len(counts)) * more
            share = self.seen.reshape(self.n, 256) * 3072 // (self.seen.reshape(self.n, 256).sum(axis=1, keepdims=True) + 8)
            self.standing = STRETCH.take(np.minimum(share + 64, 4095).ravel())
        tried = self.tried.reshape(2 * self.n, 2, 8)
        rate = STRETCH.take(tried[:, 1] * 4080 // tried.sum(axis=1) + 8)
        rate[: self.n, 0] = 0  # without trust order 2 has no say
        self.rate = np.concatenate([rate, rate], axis=1).ravel()  # 16 apart, as tries are
        for name in ("high", "low"):
            upto = np.zeros((self.n, 257), np.int64)
            np.cumsum(getattr(self, name).reshape(self.n, 256), axis=1, out=upto[:, 1:])
            upto = upto * ((1 << UNITS) - 256) // upto[:, 256:] + np.arange(257)
            setattr(self, f"{name}_start", np.append(upto[:, :256], 0).astype(np.uint64))
            setattr(self, f"{name}_width", np.append(np.diff(upto, axis=1), 1 << UNITS).astype(np.uint64))

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Candidate of each lane and its probability in 1/4096."""
        np.multiply(self.last1, np.uint32(0x85EBCA6B), out=self.mixed[1])
        np.multiply(self.mixed[1] ^ self.last2 * np.uint32(0xC2B2AE35), np.uint32(0x9E3779B1), out=self.mixed[0])
        self.at = (self.mixed >> np.uint32(32 - TABLE_BITS)) + self.base
        entry = self.table.take(self.at)
        self.named, self.trust = entry >> 3, entry & 7
        candidate = np.where(self.trust[0] > 0, self.named[0], self.named[1])
        self.r = self.base16 + self.trust
        x = self.inputs
        self.rate.take(self.r, out=x[:2], mode="clip")
        x[1] = np.where(self.named[1] == candidate, x[1], -x[1] >> 1)
        self.standing.take(self.base256 + self.slot(candidate), out=x[2], mode="clip")
        total = (self.weights * x >> 16).sum(axis=0, dtype=np.int32)
        total += 2048
        self.p = SQUASH.take(total, mode="clip")
        return candidate, self.p

    @staticmethod
    def slot(ids: np.ndarray) -> np.ndarray:
        return (ids * 40503 >> 4) & 255

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        error = (hit * np.int32(ONE) - self.p) >> 2
        self.weights += self.inputs * error >> 8
        right = (self.named == ids).view(np.int8) << 3
        self.table[self.at] = np.where(self.trust > 1, self.named, ids) << 3 | TRUST.take(self.trust + right)
        np.add(self.r, right, out=self.tries[self.count])
        self.fresh[self.count] = ids
        self.count += 1
        self.last2, self.last1 = self.last1, ids.astype(np.uint32)
        self.step += 1
        if self.step % REFRESH == 0 or self.step in EARLY:
            np.clip(self.weights, -(1 << 19), 1 << 19, out=self.weights)
            self.refresh()


def _live(sizes: np.ndarray) -> list[int]:
    """How many lanes still have ids at each step."""
    return np.searchsorted(-sizes, -np.arange(sizes.max(initial=0))).tolist()


def encode_blocks(ids: np.ndarray, sizes: np.ndarray, group: int = 1) -> list[bytes]:
    """Payloads of blocks; ids: lanes x block, of which row i holds sizes[i] ids. Sizes must fall or stay along the rows.
    group: consecutive blocks that learn together; they are decoded together too."""
    lanes, longest = len(sizes), int(sizes.max(initial=0))
    model = _Model(lanes, group)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out = np.zeros((3 * longest + 8, lanes), np.uint16)  # an id takes less than three words
    flat, at = out.ravel(), np.arange(lanes)

    def carry(lane: np.ndarray) -> None:
        k = at[lane] - lanes
        while len(k):
            v = flat[k] + np.uint16(1)  # 65535 wraps to 0 and carries on
            flat[k] = v
            k = k[v == 0] - lanes

    whole = len(model.high_width) - 1
    steps = np.ascontiguousarray(ids[:, :longest].T, np.int32)
    for own, live in zip(steps, _live(sizes)):
        candidate, p = model.predict()
        hit = candidate == own
        now, low_, span_, at_ = hit[:live], low[:live], span[:live], at[:live]
        p = p[:live].astype(np.uint64)
        # the hit or the miss
        r = span_ >> _U[BITS]
        bound = r * p
        upper = np.where(now, _U[0], bound)
        r = np.where(now, bound, r * (_U[ONE] - p))
        # both bytes at once, which for a hit are the whole
        high, low_byte = (np.where(now, whole, x[:live] + model.base256[:live]) for x in (own >> 8, own & 255))
        width = model.high_width.take(high)
        start = (model.high_start.take(high) << _U[UNITS]) + width * model.low_start.take(low_byte)
        width *= model.low_width.take(low_byte)
        r >>= _U[2 * UNITS]
        upper += r * start
        low_ += upper
        np.multiply(r, width, out=span_)
        over = np.flatnonzero(low_ < upper)
        if len(over):
            carry(over)
        # a word is written in any case, and counts if the span is small
        flat[at_] = low_ >> _U[64 - WORD]
        small = span_ < _LEAST
        at_ += small * lanes
        shift = small.astype(np.uint64) << _U[4]
        low_ <<= shift
        span_ <<= shift
        more = np.flatnonzero(span_ < _LEAST)
        while len(more):
            v, k = low.take(more), at.take(more)
            flat[k] = v >> _U[64 - WORD]
            at[more] = k + lanes
            low[more] = v << _U[WORD]
            x = span.take(more) << _U[WORD]
            span[more] = x
            more = more[x < _LEAST]
        model.update(own, hit)
    # one word says which value between low and low + span is meant: those that follow are zeros
    last = low + (_LEAST - _U[1])
    carry(np.flatnonzero(last < low))
    flat[at] = last >> _U[64 - WORD]
    words = at // lanes + 1
    out = out[: words.max(initial=0)].T.astype(">u2", order="C")
    return [out[i, :n].tobytes() for i, n in enumerate(words.tolist())]


def decode_blocks(payloads: list[bytes], sizes: np.ndarray, group: int = 1) -> np.ndarray:
    """Inverse of encode_blocks; places beyond a block's size are zero."""
    lanes, longest = len(sizes), int(sizes.max(initial=0))
    model = _Model(lanes, group)
    wide = max(map(len, payloads), default=0) // 2 + 8  # zeros follow
    data = np.zeros((lanes, wide), np.uint16)
    for i, p in enumerate(payloads):
        data[i, : len(p) // 2] = np.frombuffer(p, ">u2", len(p) // 2)
    data = np.ascontiguousarray(data.T)
    code = np.zeros(lanes, np.uint64)
    for k in range(4):
        code = code << _U[WORD] | data[k]
    span = np.full(lanes, (1 << 64) - 1, np.uint64)
    at = np.arange(4 * lanes, 5 * lanes)
    most = np.arange(lanes) + (wide - 1) * lanes  # a damaged payload reads its last zero again
    out = np.zeros((longest, lanes), np.int32)
    flat = data.ravel()
    held, names = None, np.arange(256 * model.n, dtype=np.uint16 if model.n <= 256 else np.int64)

    def byte(name: str, value: np.ndarray, unit: np.ndarray, group_units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The byte whose interval holds a value in these units, what is left of the value, and the interval's width."""
        starts, widths = getattr(model, f"{name}_start"), getattr(model, f"{name}_width")
        want = np.minimum((value / unit).astype(np.int64), (1 << UNITS) - 1)
        symbol = tables[name].take(group_units + want).astype(np.int64)
        left, width = value - unit * starts.take(symbol), unit * widths.take(symbol)
        wrong = np.flatnonzero(left >= width)  # below zero is beyond, too: the quotient was rounded, or a payload is damaged
        if len(wrong):
            own = symbol[wrong]
            i = own & ~255
            own = np.where(value[wrong] < unit[wrong] * starts[own], np.maximum(own - 1, i), np.minimum(own + 1, i + 255))
            symbol[wrong] = own
            left[wrong], width[wrong] = value[wrong] - unit[wrong] * starts[own], unit[wrong] * widths[own]
        return symbol & 255, left, width

    for t, live in enumerate(_live(sizes)):
        candidate, p = model.predict()
        if held is not model.high_width:
            held = model.high_width
            tables = {k: np.repeat(names, getattr(model, f"{k}_width")[:-1].astype(np.int64)) for k in ("high", "low")}
        code_, span_ = code[:live], span[:live]
        p = p[:live].astype(np.uint64)
        r = span_ >> _U[BITS]
        bound = r * p
        hit = np.zeros(lanes, bool)
        now = np.less(code_, bound, out=hit[:live])
        own = np.where(hit, candidate, 0)
        np.copyto(span_, bound)
        miss = np.flatnonzero(~now)
        if len(miss):
            of, b = model.of.take(miss) << UNITS, bound.take(miss)
            unit = r.take(miss) * (_U[ONE] - p.take(miss)) >> _U[2 * UNITS]
            high, left, width = byte("high", code.take(miss) - b, unit << _U[UNITS], of)
            low, code[miss], span[miss] = byte("low", left, width >> _U[UNITS], of)
            own[miss] = high << 8 | low
        # the span of a hit is as the coder's, in whole units of both bytes
        span_[now] = span_[now] >> _U[2 * UNITS] << _U[2 * UNITS]
        small = np.flatnonzero(span_ < _LEAST)
        while len(small):
            k = at.take(small)
            code[small] = code.take(small) << _U[WORD] | flat.take(k)
            at[small] = np.minimum(k + lanes, most.take(small))
            x = span.take(small) << _U[WORD]
            span[small] = x
            small = small[x < _LEAST]
        if live < lanes:  # a lane that has ended sees what the coder saw there: zeros
            hit[live:] = candidate[live:] == 0
            own[live:] = 0
        out[t] = own
        model.update(own, hit)
    return np.ascontiguousarray(out.T)


_BLOCKS = np.dtype([("ids", "<u4"), ("size", "<u4"), ("crc", "<u4")])
_DOCUMENTS = np.dtype([("doc_id", "<i8"), ("ids", "<u4")])


def write_segment(doc_ids: list[int | None], ids: list[bytes], block: int = BLOCK, group: int = GROUP) -> bytes:
    """One segment from documents' ids (little-endian unsigned 32-bit)."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    if len(flat) and flat.max() > 0xFFFF:
        raise ValueError("ids above 65535")
    n = -(-len(flat) // block)
    table, payloads = np.zeros(n, _BLOCKS), []
    if n:
        table["ids"] = block
        table["ids"][-1] = len(flat) - block * (n - 1)
        lanes = np.zeros((n, block), np.int32)
        lanes.ravel()[: len(flat)] = flat
        payloads = encode_blocks(lanes, table["ids"].astype(np.int64), group)
        table["size"] = [len(p) for p in payloads]
        table["crc"] = [zlib.crc32(flat[i * block : (i + 1) * block].tobytes()) for i in range(n)]
    documents = np.zeros(len(ids), _DOCUMENTS)
    documents["doc_id"] = [NO_ID if d is None else d for d in doc_ids]
    documents["ids"] = [len(x) // 4 for x in ids]
    tables = table.tobytes() + documents.tobytes()
    return b"".join([HEADER.pack(MAGIC, 3, block, n, len(ids), zlib.crc32(tables, group), group), tables, *payloads])


def read_segment(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(documents, ids) of a segment; raises ValueError where a checksum or the form is wrong."""
    if len(image) < HEADER.size:
        raise ValueError("no segment")
    magic, version, _, blocks, count, crc, group = HEADER.unpack_from(image)
    if magic != MAGIC or version != 3:
        raise ValueError("no segment of this format")
    end = HEADER.size + blocks * _BLOCKS.itemsize
    stop = end + count * _DOCUMENTS.itemsize
    if zlib.crc32(image[HEADER.size : stop], group) != crc or not group:
        raise ValueError("the tables don't match their checksum")
    table = np.frombuffer(image, _BLOCKS, blocks, HEADER.size)
    documents = np.frombuffer(image, _DOCUMENTS, count, end)
    ends = stop + np.cumsum(table["size"], dtype=np.int64)
    payloads = [image[e - s : e] for e, s in zip(ends.tolist(), table["size"].tolist())]
    if (ends[-1] if blocks else stop) != len(image) or table["ids"].sum() != documents["ids"].sum():
        raise ValueError("the segment isn't whole")
    lanes = decode_blocks(payloads, table["ids"].astype(np.int64), group)
    parts = [row[:n].astype("<u4") for row, n in zip(lanes, table["ids"].tolist())]
    for i, (part, own) in enumerate(zip(parts, table["crc"].tolist())):
        if zlib.crc32(part.tobytes()) != own:
            raise ValueError(f"block {i} doesn't match its checksum")
    return documents, np.concatenate(parts) if parts else np.empty(0, "<u4")

"""A context-mixing range coder for token ids, working on many blocks side by side in numpy.

A file is cut into blocks of BLOCK ids.  Each block starts from the same state and carries
its own checksum, so any block can be read alone.  For every id the coder mixes three
predictions into one distribution of total 2**24:

* order 0: the file's histogram of ids, scaled to 2**18, times a weight a;
* order 1: the id that last followed the previous id, with weight b * 2**18;
* order 2: the id that last followed the previous two, with weight d * 2**18.

a + b + d = 64; b and d adapt: they are the hit rates, of which newer ids count more, in a state made of
how often in a row both predictions were right and whether they agree.  The interval of an id under the mixture
drives a 64-bit range coder that emits 32-bit words and carries into words already written.

Lanes (blocks) are independent, so one step codes the next id of every block at once.
"""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np

BLOCK = 2048
MAGIC = b"CMR2"
_T1, _T2 = 9, 10
_SOME = 32  # blocks that are turned at a time
_LOW = 0 if sys.byteorder == "little" else 1  # place of the lower half of a number
_F = 18
U64 = np.uint64


class CorruptBlock(ValueError):
    """A block does not decode to the ids its checksum was made of."""


_U32 = np.uint32
_MOST = _U32(0xFFFF)
_RATE = 5
_LOSS = _U32((0xFFFF >> _RATE) * 0x10001)  # keeps what is shifted out of the upper rate from the lower one
_GAIN = np.array([0, 1, 1 << 16, 1 << 16], _U32) * _U32((1 << 16 - _RATE) - 1)  # by which of the two candidates was right


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values at places, the last one for places beyond; looking for those would take longer."""
    return values.take(places, mode="clip")


class _Model:
    """Followers of the last id and the last two by lane, and how often they are right.

    Everything a step looks up is one number a place: a follower with how often it was right in a row (3 at most), two rates.
    """

    def __init__(self, lanes: int):
        self.s1, self.s2 = np.zeros(lanes << _T1, _U32), np.zeros(lanes << _T2, _U32)
        self.rates = np.full(lanes << 5, 1 << 13 | 1 << 29, _U32)  # right by one id, right by two; of 2**16
        lane = np.arange(lanes, dtype=np.int64)
        self.at1, self.at2, self.atw = lane << _T1, lane << _T2, lane << 5
        self.p1 = self.p2 = np.zeros(lanes, _U32)

    def predict(self, n: int):
        """For the first n lanes: candidates of order 1 and 2 and their weights out of 2**24."""
        h = self.p1[:n] * _U32(2654435761)
        self.i1 = self.at1[:n] + (h >> _U32(32 - _T1))
        h ^= self.p2[:n] * _U32(2246822519)
        self.i2 = self.at2[:n] + (h >> _U32(32 - _T2))
        x1, x2 = _at(self.s1, self.i1), _at(self.s2, self.i2)
        c1, c2 = x1 >> _U32(2), x2 >> _U32(2)
        x1 &= _U32(3)
        x2 &= _U32(3)
        state = x2 << _U32(2)
        state += x1
        state += (c1 == c2) * _U32(16)
        self.q1, self.q2 = x1, x2
        self.w = self.atw[:n] + state
        v = self.v = _at(self.rates, self.w)
        b, d = v & _MOST, v >> _U32(16)
        b *= _U32(60)
        d *= _U32(60)
        b >>= _U32(16)
        d >>= _U32(16)
        return c1, c2, b, d

    def update(self, n: int, s: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        v = self.v
        loss = v >> _U32(_RATE)
        loss &= _LOSS
        v -= loss
        v += _at(_GAIN, hit1 + 2 * hit2.view(np.uint8))
        self.rates[self.w] = v
        new = s << _U32(2)
        for known, i, q, hit in ((self.s1, self.i1, self.q1, hit1), (self.s2, self.i2, self.q2, hit2)):
            q += q < 3
            q *= hit
            q += new
            known[i] = q
        self.p2 = self.p1[:n]
        self.p1 = s


def _histogram(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their shares of 2**18, each 1 at least."""
    if ids.max() < 1 << 24:  # a count for each id, without a sort
        all_ = np.bincount(ids)
        found = np.flatnonzero(all_)
        counts = all_[found]
    else:
        found, counts = np.unique(ids, return_counts=True)
    if len(found) >= 1 << _F:
        raise ValueError("too many distinct ids for one file")
    share = np.maximum(1, counts * ((1 << _F) - len(found)) // len(ids))
    share[share.argmax()] += (1 << _F) - int(share.sum())
    return found.astype(np.uint32), share.astype(np.uint32)


def _own(both: np.ndarray, s: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of the ids s by the histogram alone, of weight a."""
    x = _at(both, s)
    x *= a
    x = x.view(_U32)
    return x[_LOW::2].copy(), x[1 - _LOW :: 2].copy()


def _gathered(sent: list, carried: list, words: np.ndarray) -> np.ndarray:
    """The words of all lanes, one lane after the other.

    sent: lanes and the next word of each, step by step; carried: lanes that had a carry into their words so far and
    how many those were; words: how many each has.  Carries are added at the end, as their order does not matter.
    """
    out = np.concatenate([x for _, x in sent])[np.argsort(np.concatenate([x for x, _ in sent]), kind="stable")].astype(U64)
    first = np.cumsum(words) - words - 1
    np.add.at(out, first[np.concatenate([x for x, _ in carried])] + np.concatenate([n for _, n in carried]), U64(1))
    while len(over := np.flatnonzero(out >> U64(32))):  # a carry into a full word goes on to the one before
        out[over] &= U64(0xFFFFFFFF)
        out[over - 1] += U64(1)
    return out.astype("<u4")


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The file of a sequence of ids below 2**32."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n, lanes = len(ids), -(-len(ids) // block)
    if not n:
        return MAGIC + struct.pack("<QII", 0, block, 0)
    found, share = _histogram(ids)
    freq, cum = share, np.concatenate(([0], np.cumsum(share)[:-1])).astype(_U32)
    if found[-1] < 1 << 24:
        place = np.zeros(int(found[-1]) + 1, np.uint32)
        place[found] = np.arange(len(found), dtype=np.uint32)
        number = lambda x: _at(place, x)
    else:
        number = lambda x: np.searchsorted(found, x).astype(np.uint32)
    grid = np.zeros((block, lanes), np.uint32)
    for i in range(0, lanes, _SOME):  # some blocks at a time, so nothing of the file's length is made beside the grid
        own = number(ids[i * block : (i + _SOME) * block])
        grid[:, i : i + _SOME] = np.append(own, np.zeros(-len(own) % block, _U32)).reshape(-1, block).T
    low, span, words = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64), np.zeros(lanes, np.int64)
    model, sent, carried, short = _Model(lanes), [], [], np.uint16 if lanes <= 1 << 16 else np.int64  # short numbers are sorted faster
    both = cum.astype(U64) | freq.astype(U64) << U64(32)
    for t in range(min(block, n)):
        k = lanes if t < n - (lanes - 1) * block else lanes - 1  # only the last block can be short
        s = grid[t, :k]
        c1, c2, b, d = model.predict(k)
        hit1, hit2 = s == c1, s == c2
        start, width = _own(both, s, _U32(64) - b - d)
        b <<= _U32(_F)
        d <<= _U32(_F)
        start += b * (s > c1)
        start += d * (s > c2)
        width += b * hit1
        width += d * hit2
        r = span[:k] >> U64(24)
        new = r * start
        r *= width
        new += low[:k]
        over = np.flatnonzero(new < low[:k])
        carried.append((over, words[over]))
        small = np.flatnonzero(r < U64(1 << 32))
        top = new[small]
        sent.append((small.astype(short), (top >> U64(32)).astype(_U32)))
        words[small] += 1
        new[small] = top << U64(32)
        r[small] <<= U64(32)
        low[:k], span[:k] = new, r
        model.update(k, s, hit1, hit2)
    del model, grid
    every = np.arange(lanes, dtype=short)
    sent += [(every, (low >> U64(32)).astype(_U32)), (every, (low & U64(0xFFFFFFFF)).astype(_U32))]
    words += 2
    out = _gathered(sent, carried, words)
    head = zlib.compress(np.diff(found, prepend=np.uint32(0)).astype("<u4").tobytes() + share.astype("<u4").tobytes(), 1)
    parts = [MAGIC, struct.pack("<QII", n, block, len(head)), head]
    ends = np.cumsum(words)
    for i in range(lanes):
        own = ids[i * block : (i + 1) * block]
        parts += [struct.pack("<III", len(own), int(words[i]), zlib.crc32(own.astype("<u4").tobytes())), out[ends[i] - words[i] : ends[i]].tobytes()]
    return b"".join(parts)


def decode(data: bytes, only: int | None = None) -> np.ndarray:
    """The ids of a file, or of one of its blocks alone; raises CorruptBlock where a block's checksum fails."""
    if data[:4] != MAGIC:
        raise CorruptBlock("not a file of this format")
    n, block, size = struct.unpack_from("<QII", data, 4)
    if not n:
        return np.zeros(0, np.uint32)
    at = 20 + size
    head = np.frombuffer(zlib.decompress(data[20:at]), "<u4")
    found, share = np.cumsum(head[: len(head) // 2], dtype=np.uint32), head[len(head) // 2 :]
    freq, cum = share.astype(_U32), np.concatenate(([0], np.cumsum(share)[:-1])).astype(_U32)
    slot = np.repeat(np.arange(len(found), dtype=np.uint32), share)
    lanes, heads, payload = -(-n // block), [], []
    for _ in range(lanes):
        heads.append(struct.unpack_from("<III", data, at))
        payload.append(np.frombuffer(data, "<u4", heads[-1][1], at + 12))
        at += 12 + 4 * heads[-1][1]
    if only is not None:  # every block starts from the same state
        heads, payload, lanes, n = [heads[only]], [payload[only]], 1, heads[only][0]
    source = np.concatenate(payload)
    first = np.cumsum([0, *map(len, payload[:-1])])
    code, span, read = source[first].astype(U64) << U64(32) | source[first + 1], np.full(lanes, 2**64 - 1, U64), first + 2
    grid, model = np.zeros((block, lanes), np.uint32), _Model(lanes)
    both = cum.astype(U64) | freq.astype(U64) << U64(32)
    for t in range(min(block, n)):
        k = lanes if t < n - (lanes - 1) * block else lanes - 1
        c1, c2, b, d = model.predict(k)
        r = span[:k] >> U64(24)
        v = np.minimum(code[:k] // r, U64((1 << 24) - 1)).astype(_U32)
        a = _U32(64) - b - d  # then where the candidates' own intervals are, and what lies before v beside the histogram
        b <<= _U32(_F)
        d <<= _U32(_F)
        same = c1 == c2
        x1, w1 = _own(both, c1, a)
        x2, w2 = _own(both, c2, a)
        x1 += d * (c1 > c2)
        x2 += b * (c2 > c1)
        w1 += x1
        w1 += b
        w1 += d * same
        w2 += x2
        w2 += d
        w2 += b * same
        over1, over2 = v >= w1, v >= w2
        hit1, hit2 = (v >= x1) > over1, (v >= x2) > over2
        before = b * over1
        before += d * over2
        v -= before
        v //= a
        s = _at(slot, v)  # the last place for what lies beyond
        np.copyto(s, c1, where=hit1)
        np.copyto(s, c2, where=hit2)
        start, width = _own(both, s, a)
        start += before
        width += b * hit1
        width += d * hit2
        rest = code[:k] - r * start
        r *= width
        small = np.flatnonzero(r < U64(1 << 32))
        place = read[small]
        rest[small] = rest[small] << U64(32) | _at(source, place)
        read[small] = place + 1
        r[small] <<= U64(32)
        code[:k], span[:k] = rest, r
        grid[t, :k] = s
        model.update(k, s, hit1, hit2)
    del model
    ids = np.concatenate([_at(found, grid[:, i : i + _SOME].T) for i in range(0, lanes, _SOME)]).reshape(-1)[:n]
    for i, (count, _, crc) in enumerate(heads):
        if zlib.crc32(ids[i * block : i * block + count].astype("<u4").tobytes()) != crc:
            raise CorruptBlock(f"block {i}")
    return ids

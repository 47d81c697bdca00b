"""
An adaptive context-mixing range coder for token ids (0 to 65535), in independently reset, checksummed blocks.

Three predictions are mixed into one distribution for every id:

* order 0: the shares of the ids in the block's group, which the group's header states (65536 parts in all);
* order 1 and order 2: the id that the last id (the last two ids) named most lately in this block, with a confidence.

P(id) = w0 * order0(id) + w1 * [id is order 1's] + w2 * [id is order 2's]. The weights depend on both confidences and on whether
both orders name the same id; every coded id moves the weights of its case by the part that each prediction had in it
(a step of online expectation maximisation). An id is coded by one narrowing of the range, an id's own part being the sum of what all three give it.

A block starts from empty contexts and from given weights and can be decoded with its group's header alone. Blocks of a group are
coded in lockstep: each numpy operation handles one id of each block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block at most, and blocks coded in lockstep.
BLOCK, LANES = 1 << 16, 3072
#: Ids of a block from which more lanes are worth their empty contexts.
LEAST = 4096
#: Cells of the tables of order 1 and order 2 in a block.
_N1, _N2 = 512, 1024
#: Confidences that a cell may have, from 0.
_SURE = 4
#: Order 0's parts, the steps of its weight, and the parts of the code space.
_PARTS, _STEPS = 1 << 16, 256
_SPACE = _PARTS * _STEPS
#: Speed at which weights are learnt, and the least and most of the code space that order 1 and order 2 can have.
_RATE, _FLOOR, _CEILING = np.float32(1 / 32), np.float32(2048), 0.98
_FULL, _LOW, _DIGIT = float(1 << 48), float(1 << 32), float(1 << 16)
_GROUP, _HEAD = struct.Struct("<4sII"), struct.Struct("<4sIII")
GROUP_MAGIC, MAGIC = b"IDG2", b"IDB2"
#: What a cell gains, by 2 * confidence + hit: a hit adds one up to the highest, a miss halves; below 2 it loses its id instead.
_GAIN = np.array([((k + 1 < _SURE) if hit else k // 2 - k) << 16 for k in range(_SURE) for hit in (0, 1)], np.int32)


class Shares:
    """Order 0: the parts of each id (whole numbers that add up to _PARTS), and the id at each part."""

    def __init__(self, parts: np.ndarray):
        self.size = parts.astype(np.int32)
        self.start = (np.cumsum(parts) - parts).astype(np.int32)
        self.at = np.repeat(np.arange(len(parts), dtype=np.int32), parts)

    @classmethod
    def of(cls, ids: np.ndarray) -> Shares:
        """In proportion to the ids' counts, every id that occurs having one part at least."""
        count = np.bincount(ids, minlength=65536)
        parts = np.where(count > 0, np.maximum(1, count * (_PARTS - np.count_nonzero(count)) // max(1, len(ids))), 0)
        parts[parts.argmax()] += _PARTS - parts.sum()
        return cls(parts)

    def pack(self) -> bytes:
        body = zlib.compress(self.size.astype("<u4").tobytes(), 6)
        return _GROUP.pack(GROUP_MAGIC, len(body), zlib.crc32(body)) + body

    @classmethod
    def unpack(cls, data: bytes, at: int) -> tuple[Shares, int]:
        """(shares, place after them). Raises ValueError if they are damaged."""
        if len(data) - at < _GROUP.size:
            raise ValueError("group header cut off")
        magic, size, crc = _GROUP.unpack_from(data, at)
        body = data[at + _GROUP.size : at + _GROUP.size + size]
        if magic != GROUP_MAGIC or len(body) != size or zlib.crc32(body) != crc:
            raise ValueError("not a group of blocks")
        parts = np.frombuffer(zlib.decompress(body), "<u4").astype(np.int64)
        if len(parts) != 65536 or parts.sum() != _PARTS:
            raise ValueError("not a group of blocks")
        return cls(parts), at + _GROUP.size + size


class _Model:
    """
    The predictions and weights of ``n`` blocks. Arrays of two rows hold order 1 and order 2, so that one operation serves both. Tables have the same cell of all blocks
    side by side: blocks meet the same frequent ids, so that few cache lines serve most look-ups.
    """

    def __init__(self, n: int, shares: Shares):
        self.shares = shares
        lane = np.arange(n)
        self.lane, self.lanes = lane, np.int32(n)
        self.cells, self.mask = np.stack([lane, n * _N1 + lane]), np.array([[_N1 - 1], [_N2 - 1]], np.int32)
        self.table = np.zeros(n * (_N1 + _N2), np.int32)  # confidence << 16 | id
        conf2, conf1, same = np.meshgrid(np.arange(_SURE), np.arange(_SURE), np.arange(2), indexing="ij")
        first = np.stack([(conf1 + 0.2) / (conf1 + 10) * np.where(same, 0.1, 0.4), (conf2 + 0.5) / (conf2 + 6)], -1) * (0.9 * _SPACE)
        # weights of order 1 and order 2 by case, side by side: one look-up, as a number of 8 bytes, for both
        self.weights = np.repeat(first.astype(np.float32).reshape(-1, 2).view(np.int64).ravel(), n)
        self.last, self.before = np.zeros(n, np.int32), np.zeros(n, np.int32)

    def predict(self, n: int) -> None:
        """What the orders name (c), their parts of the code space (a), and the steps of order 0 (s0), for the first n blocks."""
        last = self.last[:n]
        hashed = np.empty((2, n), np.int32)
        np.multiply(last, 40503, out=hashed[0])
        np.bitwise_xor(last * 40507, self.before[:n] * 30011, out=hashed[1])
        hashed >>= 5
        hashed &= self.mask
        hashed *= self.lanes
        self.at = self.cells[:, :n] + hashed
        self.held = self.table.take(self.at)
        self.c, self.sure = self.held & 65535, self.held >> 16
        self.same = self.c[0] == self.c[1]
        self.case = self.lane[:n] + ((self.sure[1] * _SURE + self.sure[0] << 1) + self.same) * self.lanes
        self.both = self.weights.take(self.case).view(np.float32).reshape(-1, 2)
        self.a = self.both.T.astype(np.int32, order="C")
        self.s0 = (_SPACE - self.a[0] - self.a[1]) >> 16

    def part(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of each block's id in the code space."""
        self.hit = self.c == ids
        at = ids.astype(np.int64)
        below, within = self.a * (self.c < ids), self.a * self.hit
        start = self.s0 * self.shares.start.take(at) + below[0] + below[1]
        self.size = self.s0 * self.shares.size.take(at) + within[0] + within[1]
        return start, self.size

    def find(self, place: np.ndarray) -> np.ndarray:
        """The id whose part holds each block's place in the code space."""
        c, a, s0 = self.c, self.a, self.s0
        other, at = a[::-1], c.astype(np.int64)
        over = place - (s0 * self.shares.start.take(at) + other * (c[::-1] < c))
        past = over >= 0
        inside = past & (over < s0 * self.shares.size.take(at) + a + other * self.same)
        before = a * past
        rest = place - before[0] - before[1]
        x = self.shares.at.take((rest.astype(np.float64) / s0).astype(np.int64), mode="clip")
        x += (c[0] - x) * inside[0]
        x += (c[1] - x) * inside[1]
        return x

    def learn(self, n: int, ids: np.ndarray) -> None:
        """After ``part`` of the same ids."""
        gain = np.float32(_SPACE * _CEILING) * _RATE / self.size.astype(np.float32)
        both = self.both
        by = np.empty_like(both)
        by[:, 0], by[:, 1] = gain * self.hit + (np.float32(1) - _RATE)
        both *= by
        self.weights[self.case] = np.maximum(both, _FLOOR, out=both).view(np.int64).ravel()
        new = self.held + _GAIN.take((self.sure << 1) + self.hit)
        new += (ids - new) * ((self.sure < 2) > self.hit)
        self.table[self.at] = new
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


def _even(n: int, parts: int) -> np.ndarray:
    """Sizes of ``parts`` parts of n, the larger first."""
    return np.full(parts, n // parts, np.int64) + (np.arange(parts) < n % parts)


def encode(ids: np.ndarray) -> bytes:
    """
    Groups of blocks of ``ids`` (uint16). A group has a header with order 0's shares; a block has one with magic, ids, bytes and the crc32 of the
    ids as little-endian 32-bit integers. Blocks have BLOCK ids at most, and fewer where that lets more of them be coded in lockstep.
    """
    return b"".join(_encode_group(ids[lo : lo + BLOCK * LANES]) for lo in range(0, len(ids), BLOCK * LANES))


def _encode_group(ids: np.ndarray) -> bytes:
    lanes = max(-(-len(ids) // BLOCK), min(LANES, -(-len(ids) // LEAST)))
    sizes = _even(len(ids), lanes)
    length = int(sizes[0])
    starts = np.cumsum(sizes) - sizes
    shares = Shares.of(ids)
    model = _Model(lanes, shares)
    low, rng = np.zeros(lanes), np.full(lanes, _FULL)
    room = length + 64
    out, at = np.zeros(room * lanes, np.uint32), np.arange(lanes)  # digit by digit, those of all blocks side by side
    steps = np.zeros((lanes, length), np.uint16)
    steps[np.arange(length) < sizes[:, None]] = ids
    steps = np.ascontiguousarray(steps.T)
    for t in range(length):
        n = lanes if t < sizes[-1] else int(np.searchsorted(-sizes, -t, "left"))
        if t % 256 == 0 and int(at.max()) + 600 * lanes > len(out):  # two digits an id at most
            out = np.concatenate([out, np.zeros((length // 2 + 1024) * lanes, np.uint32)])
        x = steps[t, :n].astype(np.int32)
        model.predict(n)
        start, size = model.part(x)
        r = np.floor(rng[:n] * (1 / _SPACE))
        low[:n] += r * start.astype(np.float64)
        rng[:n] = r * size.astype(np.float64)
        small = np.flatnonzero(rng[:n] < _LOW)
        while len(small):
            lo = low[small]
            digit = np.floor(lo * (1 / _LOW))  # 65536 or more where there is a carry, which is handed on at the end
            where = at[small]
            out[where] = digit
            at[small] = where + lanes
            low[small] = (lo - digit * _LOW) * _DIGIT
            wider = rng[small] * _DIGIT
            rng[small] = wider
            small = small[wider < _LOW]
        model.learn(n, x)
    for _ in range(3):
        digit = np.floor(low * (1 / _LOW))
        out[at] = digit
        at += lanes
        low = (low - digit * _LOW) * _DIGIT
    count = (at - np.arange(lanes)) // lanes
    digits = out[: int(count.max()) * lanes].reshape(-1, lanes)
    for k in range(len(digits) - 1, 0, -1):
        digits[k - 1] += digits[k] >> np.uint32(16)
    data = np.ascontiguousarray(digits.astype(np.uint16).T).astype(">u2")
    blocks = [shares.pack(), struct.pack("<I", lanes)]
    for k in range(lanes):
        body = data[k, : count[k]].tobytes()
        blocks.append(_HEAD.pack(MAGIC, int(sizes[k]), len(body), _crc(ids[starts[k] : starts[k] + sizes[k]])) + body)
    return b"".join(blocks)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def decode(data: bytes) -> np.ndarray:
    """All ids of consecutive groups. Raises ValueError for a block or header that is damaged."""
    parts, at = [], 0
    while at < len(data):
        shares, at = Shares.unpack(data, at)
        if len(data) - at < 4:
            raise ValueError("group header cut off")
        (lanes,) = struct.unpack_from("<I", data, at)
        at += 4
        heads = []
        for _ in range(lanes):
            if len(data) - at < _HEAD.size:
                raise ValueError("block header cut off")
            magic, n, size, crc = _HEAD.unpack_from(data, at)
            at += _HEAD.size
            if magic != MAGIC or size % 2 or at + size > len(data) or not 0 < n <= BLOCK:
                raise ValueError("not a block of ids")
            heads.append((n, at, size, crc))
            at += size
        for lo in range(0, lanes, LANES):
            parts.append(decode_blocks(data, heads[lo : lo + LANES], shares))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def decode_blocks(data: bytes, heads: list[tuple[int, int, int, int]], shares: Shares) -> np.ndarray:
    """The ids of blocks (ids, place, bytes, crc32), any choice of a group's; the longest are to come first, as the writer puts them."""
    order = sorted(range(len(heads)), key=lambda k: -heads[k][0])
    sizes = np.array([heads[k][0] for k in order])
    lanes, length = len(order), int(sizes[0])
    held = np.array([heads[k][2] // 2 + 4 for k in order])
    at = np.cumsum(held) - held
    stream = np.zeros(int(held.sum()) + 1)  # zeros after each block: reading may run past its end
    for k, a in zip(order, at, strict=True):
        _, lo, size, _ = heads[k]
        stream[a : a + size // 2] = np.frombuffer(data, ">u2", size // 2, lo)
    model = _Model(lanes, shares)
    off = (stream[at] * _DIGIT + stream[at + 1]) * _DIGIT + stream[at + 2]
    at, rng = at + 3, np.full(lanes, _FULL)
    past = np.zeros((length, lanes), np.uint16)
    for t in range(length):
        n = lanes if t < sizes[-1] else int(np.searchsorted(-sizes, -t, "left"))
        model.predict(n)
        r = np.floor(rng[:n] * (1 / _SPACE))
        x = model.find(np.minimum(off[:n] / r, _SPACE - 1).astype(np.int32))
        start, size = model.part(x)
        off[:n] -= r * start.astype(np.float64)
        rng[:n] = r * size.astype(np.float64)
        small = np.flatnonzero(rng[:n] < _LOW)
        while len(small):
            where = np.minimum(at[small], len(stream) - 1)
            off[small] = off[small] * _DIGIT + stream.take(where)
            at[small] = where + 1
            wider = rng[small] * _DIGIT
            rng[small] = wider
            small = small[wider < _LOW]
        past[t, :n] = x
        model.learn(n, x)
    parts: list = [None] * lanes
    for row, k in enumerate(order):
        got = past[: sizes[row], row].copy()
        if _crc(got) != heads[k][3]:
            raise ValueError("block fails its checksum")
        parts[k] = got
    return np.concatenate(parts)

"""
Progressive JPEG in numpy: many images at once.

Decoding accumulates the scans of an image (spectral selection and successive approximation, for DC and AC) into arrays of
coefficients, transforms them back, upsamples components that are sampled more coarsely, and gives full-resolution RGB
tensors. Bits of one restart interval can only be read in turn, but intervals do not depend on each other: the
intervals of all images in a batch are read in lockstep, one numpy operation for one symbol of each.

Encoding here stores given coefficients without loss, as images with chroma at half resolution in both directions (4:2:0): an MCU has four blocks of luma
and one of each chroma component.

The inverse transform uses integer-valued constants in double precision: all sums are exact, so equal images give
equal tensors wherever and in whatever company they are decoded.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

#: MCUs of a restart interval, and of an image row, that the encoder makes; blocks of an MCU.
INTERVAL, ROW, CELLS = 16, 2048, 6


def _zigzag() -> np.ndarray:
    """Natural position (row * 8 + column) of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_SCALE = 1 << 13


def _inverse() -> np.ndarray:
    """(64 coefficients in zigzag order, 64 samples), times _SCALE, rounded to integers."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    full = np.einsum("ur,vc->uvrc", basis, basis).reshape(64, 64)
    return np.rint(full[ZIGZAG] * _SCALE)


_IDCT = _inverse()


# Huffman tables

def lengths(weights: dict[int, float]) -> tuple[bytes, bytes]:
    """(number of codes of each length 1..16, symbols by length) of a prefix code without an all-ones code."""
    heap = [(w, k, (s,)) for k, (s, w) in enumerate(sorted(weights.items()))]
    heap.append((0.0, -1, (-1,)))  # takes the longest code, which stays unused
    size = dict.fromkeys([-1, *weights], 0)
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            size[s] += 1
        n += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
    counts = np.bincount(list(size.values()), minlength=64)
    for k in range(len(counts) - 1, 16, -1):  # codes of at most 16 bits
        while counts[k]:
            j = k - 2
            while not counts[j]:
                j -= 1
            counts[k] -= 2
            counts[k - 1] += 1
            counts[j + 1] += 2
            counts[j] -= 1
    last = max(np.flatnonzero(counts))
    counts[last] -= 1
    order = sorted(weights, key=lambda s: (size[s], s))
    return bytes(counts[1:17].tolist()), bytes(order)


def codes(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code, its bits) of each symbol."""
    code, bits = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    at, k = 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            code[table[1][k]], bits[table[1][k]] = at, length
            at, k = at + 1, k + 1
        at <<= 1
    return code, bits


def lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """bits << 8 | symbol for each 16 bits that may come next; 0 where there is no such code."""
    out = np.zeros(1 << 16, np.int32)
    at, k = 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            if k < len(table[1]) and at < 1 << 16:
                out[at : at + (1 << 16 - length)] = length << 8 | table[1][k]
            at, k = at + (1 << 16 - length), k + 1
    return out


_COEFFICIENT, _SKIP, _OTHER = 0, 1, 2


def lookup_ac(table: tuple[bytes, bytes]) -> np.ndarray:
    """
    For each 16 bits that may come next in a first AC scan all that a step needs, in one number: bits to go on (5), what it is (2), places
    to go on (7), the coefficient + 2048 (12). An end of block goes on by 64 places. Longer codes, runs of blocks and errors are _OTHER.
    """
    base = lookup(table).astype(np.int64)
    bits, run, size = base >> 8, base >> 4 & 15, base & 15
    rest = np.arange(1 << 16) << bits & 0xFFFF  # what follows the code
    v = rest >> (16 - size)
    v = np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)
    kind = np.where(size > 0, _COEFFICIENT, _SKIP)
    kind = np.where((base == 0) | (bits + size > 16) | (size > 11) | ((size == 0) & (run > 0) & (run < 15)), _OTHER, kind)
    places = np.where(size > 0, run, np.where(run == 15, 16, 64))
    out = (v + 2048) << 14 | places << 7 | kind << 5 | (bits + size)
    return np.where(kind == _OTHER, _OTHER << 5, out).astype(np.int32)


#: A table by which an interval that is at its end stays there.
_STAY = np.full(1 << 16, _SKIP << 5, np.int32)


def _ac_weights(zero: float) -> dict[int, float]:
    """Symbols run << 4 | size: a run of zeros is geometric, sizes 1 to 10 by how often they are met in text; EOB runs are rare."""
    size = [0.0, 0.22, 0.265, 0.26, 0.14, 0.073, 0.012, 0.03, 0.002, 1e-6, 1e-7]
    out = {r << 4 | s: zero**r * size[s] for r in range(16) for s in range(1, 11)}
    return out | {0: 0.03, 0xF0: 1e-3} | {r << 4: 1e-6 for r in range(1, 15)}


DC_TABLE = lengths({s: w for s, w in enumerate([0.06, 0.08, 0.13, 0.2, 0.22, 0.14, 0.08, 0.05, 0.03, 1e-3, 1e-5, 1e-6])})
AC_TABLE = lengths(_ac_weights(0.16))


# Encoding


_SIZES = np.array([v.bit_length() for v in range(1 << 12)], np.int64)


def bit_sizes(v: np.ndarray) -> np.ndarray:
    return _SIZES[np.abs(v)]


def pack(segment: np.ndarray, value: np.ndarray, bits: np.ndarray, segments: int) -> list[bytes]:
    """Bit strings in order -> the bytes of each segment, filled up with ones, and FF followed by 00."""
    total = np.bincount(segment, bits, segments).astype(np.int64)
    fill = -total % 8
    size = (total + fill) // 8
    start = np.cumsum(size) - size
    first = np.searchsorted(segment, np.arange(segments))
    sums = np.cumsum(bits) - bits
    base = np.append(sums, sums[-1] + bits[-1] if len(bits) else 0)[first]
    off = sums - base[segment] + 8 * start[segment]
    # a segment's filling comes after its items: items move up by the number of segments before theirs
    own, filled = np.arange(len(value)) + segment, np.append(first[1:], len(value)) + np.arange(segments)

    def merged(items: np.ndarray, fills: np.ndarray) -> np.ndarray:
        out = np.empty(len(items) + segments, items.dtype)
        out[own], out[filled] = items, fills
        return out

    value, bits, off = merged(value, (np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1)), merged(bits, fill), merged(off, 8 * start + total)
    words = np.zeros(int(size.sum()) // 4 + 3, np.uint64)
    at = off >> 5
    wide = value << (64 - bits - (off & 31)).astype(np.uint64)
    wide[bits == 0] = 0
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    words[at[cut]] += np.add.reduceat(wide >> np.uint64(32), cut)
    words[at[cut] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), cut)
    data = words.astype(">u4").tobytes()
    return [data[a : a + n].replace(b"\xff", b"\xff\x00") for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def _values(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v > 0, v, v + (1 << size) - 1).astype(np.uint64)


def _dc_first(dc: np.ndarray, seg: np.ndarray, al: int):
    """dc: (MCUs, CELLS), four of luma first. Each is told by its difference from the component's last one in the segment."""
    v = dc >> al
    d = v.copy()
    same = seg[1:] == seg[:-1]
    d[1:, 0] -= np.where(same, v[:-1, 3], 0)
    d[:, 1:4] -= v[:, :3]
    d[1:, 4:] -= np.where(same[:, None], v[:-1, 4:], 0)
    d = d.ravel()
    size = bit_sizes(d)
    code, bits = codes(DC_TABLE)
    return np.repeat(seg, CELLS), code[size] << size.astype(np.uint64) | _values(d, size) * (size > 0), bits[size] + size


def _ac_first(c: np.ndarray, seg: np.ndarray, al: int):
    """c: (blocks, band)."""
    n, width = c.shape
    v = (np.sign(c) * (np.abs(c) >> al) if al else c).ravel()
    at = np.flatnonzero(v)
    b = at // width
    k = at - b * width
    x = v[at]
    before = np.full(len(b), -1)
    if len(b):
        before[1:] = np.where(b[1:] == b[:-1], k[:-1], -1)
    run = k - before - 1
    zrl = run >> 4
    last = np.full(n, -1)
    last[b] = k
    eob = last < width - 1
    code, bits = codes(AC_TABLE)
    size = bit_sizes(x)
    symbol = (run & 15) << 4 | size
    place = np.cumsum(1 + zrl) - 1 + (np.cumsum(eob) - eob)[b]  # after its ZRLs and the EOBs of earlier blocks
    items = len(b) + int(zrl.sum()) + int(eob.sum())
    value, length, owner = np.full(items, code[0xF0]), np.full(items, bits[0xF0]), np.zeros(items, np.int64)
    value[place], length[place] = code[symbol] << size.astype(np.uint64) | _values(x, size), bits[symbol] + size
    per_block = np.bincount(b, 1 + zrl, n).astype(np.int64) + eob
    ends = np.cumsum(per_block)
    at = ends[eob] - 1
    value[at], length[at] = code[0], bits[0]
    owner = np.repeat(seg, per_block)
    return owner, value, length


def _ac_refine(c: np.ndarray, seg: np.ndarray, al: int):
    """One more bit (``al``) of (blocks, band) after a scan with al + 1."""
    n, width = c.shape
    size = np.abs(c) >> al
    old, new = size > 1, size == 1
    zero = size == 0
    number = np.cumsum(new, axis=1)
    # zeros since the block's last new coefficient
    zeros = np.cumsum(zero, axis=1)
    base = np.maximum.accumulate(np.where(new, zeros, 0), axis=1)
    since = zeros - np.concatenate([np.zeros((n, 1), base.dtype), base[:, :-1]], axis=1)
    followed = number < number[:, -1:]
    zrl = zero & (since > 0) & (since % 16 == 0) & followed
    event = new | zrl
    left = width - 1 - np.where(event.any(axis=1), width - 1 - np.argmax(event[:, ::-1], axis=1), -1)
    eob = left > 0
    per_block = event.sum(axis=1) + eob
    first = np.cumsum(per_block) - per_block
    eid = first[:, None] + np.cumsum(event, axis=1) - event  # of the event at or after each coefficient
    code, bits = codes(AC_TABLE)
    eb, ek = np.nonzero(event)
    fresh = new[eb, ek]
    symbol = np.where(fresh, (since[eb, ek] & 15) << 4 | 1, 0xF0)
    value = np.where(fresh, code[symbol] << np.uint64(1) | (c[eb, ek] > 0), code[symbol])
    length = bits[symbol] + fresh
    ob, ok = np.nonzero(old)
    keys = np.r_[2 * eid[eb, ek], 2 * (first + per_block - 1)[eob], 2 * eid[ob, ok] + 1]
    value = np.r_[value, np.full(int(eob.sum()), code[0]), (size[ob, ok] & 1).astype(np.uint64)]
    length = np.r_[length, np.full(int(eob.sum()), bits[0]), np.ones(len(ob), np.int64)]
    owner = np.r_[seg[eb], seg[eob], seg[ob]]
    order = np.argsort(keys, kind="stable")
    return owner[order], value[order], length[order]


#: The encoder's scans: components, first and last coefficient, bit positions before and after.
SCANS = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 0), ((1,), 1, 5, 0, 0), ((2,), 1, 5, 0, 0), ((0, 1, 2), 0, 0, 1, 0), ((0,), 6, 63, 0, 0), ((1,), 6, 63, 0, 0), ((2,), 6, 63, 0, 1), ((2,), 6, 63, 1, 0))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


class _Layout:
    """Where the blocks of many images are: each image's luma row by row, then both chroma components."""

    def __init__(self, counts: np.ndarray):
        mcus = -(-counts // CELLS)
        self.wide = np.minimum(mcus, ROW)
        self.rows = -(-mcus // self.wide)
        self.full = self.wide * self.rows
        self.start = np.cumsum(self.full) - self.full
        self.image, self.nth = self._each(self.full)
        first = CELLS * self.start[self.image]
        luma, within = self._each(4 * self.full)
        self.planes = (CELLS * self.start[luma] + within, first + 4 * self.full[self.image] + self.nth, first + 5 * self.full[self.image] + self.nth)
        self.segments = {plane: self._segments(times * self.full) for plane, times in ((0, 4), (1, 1))}
        y, x = np.divmod(self.nth, self.wide[self.image])
        across = 2 * self.wide[self.image]
        corners = [first + (2 * y + j) * across + 2 * x + i for j in (0, 1) for i in (0, 1)]
        self.mcus = np.stack([*corners, *self.planes[1:]], 1)

    @staticmethod
    def _each(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(image, place in the image) of every item, images having ``sizes`` items."""
        image = np.repeat(np.arange(len(sizes)), sizes)
        return image, np.arange(len(image)) - (np.cumsum(sizes) - sizes)[image]

    def _segments(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment of every item, first segment of every image, its segments)"""
        n = -(-sizes // INTERVAL)
        first = np.cumsum(n) - n
        image, nth = self._each(sizes)
        return first[image] + nth // INTERVAL, first, n


def encode(blocks: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """
    blocks: (all blocks, 64) coefficients in zigzag order, -1023 to 1023; counts: blocks of each image (1 at least). They fill the image's luma row by row, then
    its chroma components; rows have ROW MCUs, and what is left of the image is zero. A comment holds the count.
    """
    lay = _Layout(counts)
    c = np.zeros((CELLS * int(lay.full.sum()), 64), np.int32)
    image, nth = lay._each(counts)
    c[CELLS * lay.start[image] + nth] = blocks
    parts = []
    for comps, ss, se, ah, al in SCANS:
        plane = min(comps[0], 1) if len(comps) == 1 else 1
        seg, first, n_seg = lay.segments[plane]
        if se == 0:
            dc = c[:, 0][lay.mcus]
            items = _dc_first(dc, seg, al) if not ah else (np.repeat(seg, CELLS), (dc.ravel() >> al & 1).astype(np.uint64), np.ones(dc.size, np.int64))
        else:
            band = c[lay.planes[comps[0]], ss : se + 1]
            items = _ac_refine(band, seg, al) if ah else _ac_first(band, seg, al)
        parts.append((pack(*items, int(n_seg.sum())), first, n_seg))
    tables = _segment(0xDB, b"\0" + bytes([1] * 64)) + _segment(0xC4, b"\x00" + DC_TABLE[0] + DC_TABLE[1] + b"\x10" + AC_TABLE[0] + AC_TABLE[1]) + _segment(0xDD, struct.pack(">H", INTERVAL))
    heads = [_segment(0xDA, bytes([len(comps)]) + b"".join(bytes([k + 1, 0]) for k in comps) + bytes([ss, se, ah << 4 | al])) for comps, ss, se, ah, al in SCANS]
    restart = [bytes([0xFF, 0xD0 + k]) for k in range(8)]
    out = []
    for i in range(len(counts)):
        size = struct.pack(">BHHB", 8, int(lay.rows[i]) * 16, int(lay.wide[i]) * 16, 3)
        data = [b"\xff\xd8", _segment(0xFE, struct.pack(">I", int(counts[i]))), _segment(0xC2, size + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), tables]
        for head, (segs, first, n_seg) in zip(heads, parts, strict=True):
            data.append(head)
            for k in range(n_seg[i]):
                if k:
                    data.append(restart[(k - 1) % 8])
                data.append(segs[first[i] + k])
        out.append(b"".join(data) + b"\xff\xd9")
    return out


# Decoding


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks of a row as coded alone, rows, and both as stored (whole MCUs)
    high: int = 0
    across: int = 0
    down: int = 0
    base: int = 0  # its first block among all images' blocks
    shape: tuple = ()  # all that the order of its blocks in a scan depends on, counted from the image's first block


@dataclass
class Image:
    width: int = 0
    height: int = 0
    base: int = 0  # its first block among all images' blocks
    components: dict[int, Component] = field(default_factory=dict)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RST = re.compile(rb"\xff[\xd0-\xd7]")
_lookups: dict[tuple[bytes, bytes], np.ndarray] = {}
_lookups_ac: dict[tuple[bytes, bytes], np.ndarray] = {}


def _cached(kept: dict, table: tuple[bytes, bytes], make) -> np.ndarray:
    if table not in kept:
        if len(kept) >= 64:  # files with tables of their own must not fill the memory
            kept.clear()
        kept[table] = make(table)
    return kept[table]


class Reader:
    """Scans of many images, parsed into lanes (restart intervals) and decoded together, scan by scan."""

    def __init__(self, images: list[bytes]):
        self.blocks = 0
        self.tables: dict[tuple[bytes, bytes], int] = {}
        self.steps: list[list] = []  # the n-th scans of all images
        self.orders: dict[tuple, tuple] = {}  # images of one size share what their scans' order is
        self.images = [self._parse(x) for x in images]
        self.coefficients = np.zeros((self.blocks, 64), np.int32)
        luts = [_cached(_lookups, t, lookup) for t in self.tables]
        self.luts = np.concatenate(luts) if luts else np.zeros(0, np.int32)
        self.luts_ac = np.concatenate([*(_cached(_lookups_ac, t, lookup_ac) for t in self.tables), _STAY])
        try:
            for scans in self.steps:
                self._decode(scans)
        except IndexError as e:  # read past the end of the data
            raise ValueError("damaged scan") from e

    def _parse(self, data: bytes) -> Image:
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        image, huff, interval, at, n_scan = Image(), {}, 0, 2, 0
        while True:
            if at + 2 > len(data) or data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                return image
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    table = (body[1:17], body[17 : 17 + n])
                    huff[body[0]] = self.tables.setdefault(table, len(self.tables))
                    body = body[17 + n :]
            elif marker == 0xDD:
                interval = int.from_bytes(body, "big")
            elif marker == 0xFE:
                image.comments.append(body)
            elif marker == 0xC2:
                self._frame(image, body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not a progressive JPEG file")
            elif marker == 0xDA:
                end = _END.search(data, at)
                stop = end.start() if end else len(data)
                parts = [x.replace(b"\xff\x00", b"\xff") for x in _RST.split(data[at:stop])] if interval else [data[at:stop].replace(b"\xff\x00", b"\xff")]
                if n_scan == len(self.steps):
                    self.steps.append([])
                self.steps[n_scan].append(self._scan(image, body, dict(huff), interval, parts))
                n_scan += 1
                at = stop

    def _frame(self, image: Image, body: bytes) -> None:
        precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
        if precision != 8 or not image.height or not image.width:
            raise ValueError("8 bits and a size expected")
        for k in range(n):
            i, hv, q = body[6 + 3 * k : 9 + 3 * k]
            image.components[i] = Component(hv >> 4, hv & 15, q)
        h, v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
        mw, mh = -(-image.width // (8 * h)), -(-image.height // (8 * v))
        image.base = self.blocks
        for c in image.components.values():
            c.across, c.down = mw * c.h, mh * c.v
            c.wide, c.high = -(-(-(-image.width * c.h // h)) // 8), -(-(-(-image.height * c.v // v)) // 8)
            c.base = self.blocks
            c.shape = (c.h, c.v, c.wide, c.high, c.across, c.down, c.base - image.base)
            self.blocks += c.across * c.down

    def _scan(self, image: Image, body: bytes, huff: dict, interval: int, parts: list[bytes]):
        """(blocks in coded order, component of each, lanes' first blocks, lanes' bytes, tables of components, ss, se, ah, al)"""
        n = body[0]
        comps = [image.components[body[1 + 2 * k]] for k in range(n)]
        chosen = [body[2 + 2 * k] for k in range(n)]
        ss, se, hl = body[1 + 2 * n : 4 + 2 * n]
        key = (interval, *(c.shape for c in comps))
        if key not in self.orders:
            self.orders[key] = self._order(interval, comps, image.base)
        blocks, which, first = self.orders[key]
        if image.base:
            blocks = blocks + image.base
        if len(parts) < len(first):
            raise ValueError("restart intervals are missing")
        tables = [huff.get((chosen[k] >> 4) if ss == 0 else 0x10 | (chosen[k] & 15), 0) for k in range(n)]
        return blocks, which, first, parts[: len(first)], tables, ss, se, hl >> 4, hl & 15

    @staticmethod
    def _order(interval: int, comps: list[Component], base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(blocks in coded order, from ``base``; component of each; lanes' first blocks) of a scan."""
        c = comps[0]
        if len(comps) == 1:
            blocks = (c.base - base + np.arange(c.high)[:, None] * c.across + np.arange(c.wide)).ravel()
            which, per = np.zeros(len(blocks), np.int64), 1
        else:
            mw, mh = c.across // c.h, c.down // c.v
            y, x = np.divmod(np.arange(mw * mh), mw)
            cells = [(k, (c.base - base + (y * c.v + j) * c.across + x * c.h + i)) for k, c in enumerate(comps) for j in range(c.v) for i in range(c.h)]
            blocks, which, per = np.stack([b for _, b in cells], 1).ravel(), np.tile(np.array([k for k, _ in cells]), mw * mh), len(cells)
        return blocks, which, np.arange(0, len(blocks), interval * per) if interval else np.zeros(1, np.int64)

    def _decode(self, scans: list) -> None:
        for dc in (True, False):
            for refine in (False, True):
                some = [s for s in scans if (s[5] == 0) == dc and (s[7] > 0) == refine]
                if some:
                    self._lanes(some)
                    if dc:
                        (self._dc_refine if refine else self._dc_first)()
                    else:
                        (self._ac_refine if refine else self._ac_first)()

    def _lanes(self, scans: list) -> None:
        """Arrays over lanes: bit position, first and last block in ``order``, table, band."""
        gap = b"\0" * 8
        parts = [p for s in scans for p in s[3]]
        sizes = np.array([len(p) for p in parts]) + 8
        data = np.frombuffer(gap.join(parts) + gap + gap, np.uint8).astype(np.uint32)
        self.words = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        self.order = np.concatenate([s[0] for s in scans])
        self.which = np.concatenate([s[1] for s in scans])
        base = np.cumsum([0, *(len(s[0]) for s in scans)])
        self.first = np.concatenate([s[2] + b for s, b in zip(scans, base, strict=False)])
        self.last = np.r_[self.first[1:], base[-1]]
        per = np.array([len(s[2]) for s in scans])
        self.pos = 8 * (np.cumsum(sizes) - sizes).astype(np.int64)
        self.limit = self.pos + 8 * sizes
        self.tables_of = np.repeat(np.array([(s[4] + [0] * 4)[:4] for s in scans], np.int64), per, axis=0) << 16
        self.ss, self.se, self.al = (np.repeat(np.array([s[k] for s in scans]), per) for k in (5, 6, 8))

    def _peek(self, pos: np.ndarray) -> np.ndarray:
        """The next 25 bits at least, at the top of 32."""
        return (self.words[np.minimum(pos >> 3, len(self.words) - 1)] << (pos & 7).astype(np.uint32)).astype(np.int64)

    @staticmethod
    def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)

    def _dc_first(self) -> None:
        pos, at = self.pos.copy(), self.first.copy()
        before = np.zeros((len(pos), 4), np.int64)
        on = np.arange(len(pos))
        while len(on):
            p, a = pos[on], at[on]
            comp = self.which[a]
            code = self.luts[self.tables_of[on, comp] + (self._peek(p) >> 16)]
            p = p + (code >> 8)
            size = code & 15
            v = self._extend(self._peek(p) >> (32 - size), size) * (size > 0)
            pos[on] = p + size
            before[on, comp] += v
            self.coefficients[self.order[a], 0] = before[on, comp] << self.al[on]
            at[on] += 1
            if (code == 0).any() or (pos[on] > self.limit[on]).any():
                raise ValueError("damaged scan")
            on = on[at[on] < self.last[on]]

    def _dc_refine(self) -> None:
        lane = np.repeat(np.arange(len(self.first)), self.last - self.first)
        pos = self.pos[lane] + np.arange(len(lane)) - self.first[lane]
        self.coefficients[self.order, 0] |= (self._peek(pos) >> 31).astype(np.int32) << self.al[lane]

    def _ac_first(self) -> None:
        flat = self.coefficients.reshape(-1)
        words = self.words.astype(np.int64)
        stay = len(self.luts_ac) - (1 << 16)
        pos, at, last, al, k, ss, se, table, limit = self.pos.copy(), self.first.copy(), self.last, self.al, self.ss.copy(), self.ss, self.se, self.tables_of[:, 0].copy(), self.limit
        shifts, ended = al.any(), 0
        while len(pos):
            e = self.luts_ac[table + (words[pos >> 3] >> (16 - (pos & 7)) & 0xFFFF)]
            pos += e & 31
            k += e >> 7 & 127
            kind = e >> 5 & 3
            some = kind == _COEFFICIENT
            i = np.flatnonzero(some)
            v = (e[i] >> 14) - 2048
            flat[(self.order[at[i]] << 6) + np.minimum(k[i], 63)] = v << al[i] if shifts else v
            k += some
            other = np.flatnonzero(kind == _OTHER)
            if len(other):
                self._ac_other(other, words, pos, at, k, al, table, limit, flat)
            over = np.flatnonzero(k > se)
            if len(over):
                at[over] += 1
                k[over] = ss[over]
                done = over[at[over] >= last[over]]
                if len(done):
                    if (pos[done] > limit[done]).any():
                        raise ValueError("damaged scan")
                    table[done], at[done], se[done] = stay, last[done] - 1, 127
                    ended += len(done)
                    if ended > len(pos) >> 5 or ended == len(pos):
                        live = table != stay
                        pos, at, last, al, k, ss, se, table, limit = (x[live] for x in (pos, at, last, al, k, ss, se, table, limit))
                        ended = 0

    def _ac_other(self, i, words, pos, at, k, al, table, limit, flat) -> None:
        """Lanes ``i`` of a first AC scan whose next symbol needs more than 16 bits, or is a run of ended blocks."""
        peek = lambda p: words[np.minimum(p >> 3, len(words) - 1)] << (p & 7) & 0xFFFFFFFF
        code = self.luts[table[i] + (peek(pos[i]) >> 16)].astype(np.int64)
        if (code == 0).any() or (pos[i] > limit[i]).any():
            raise ValueError("damaged scan")
        pos[i] += code >> 8
        run, size = code >> 4 & 15, code & 15
        bits = peek(pos[i])
        v = self._extend(bits >> (32 - size), size)
        some = size > 0
        flat[(self.order[at[i]][some] << 6) + np.minimum(k[i] + run, 63)[some]] = (v << al[i])[some]
        pos[i] += np.where(some, size, run)
        at[i] += np.where(some, 0, (1 << run) + (bits >> (32 - run)) * (run > 0) - 1)
        k[i] = np.where(some, k[i] + run + 1, 128)

    def _ac_refine(self) -> None:
        """
        One symbol of each lane a step. Zeros and others are known before the scan, so a symbol's run leads to its place at once; the bits of the
        coefficients that it goes over follow it in their order, and are only noted: they are read together at the end.
        """
        flat = self.coefficients.reshape(-1)
        lane = np.repeat(np.arange(len(self.first)), self.last - self.first)
        held, places = self.coefficients[self.order] != 0, np.arange(64)
        band = (places >= self.ss[lane, None]) & (places <= self.se[lane, None])
        old, zero = held & band, ~held & band
        # by block: zeros before each place, the place of each zero (64: none), others before each place, and others in all blocks before
        zeros, others = np.zeros((len(lane), 65), np.uint8), np.zeros((len(lane), 65), np.uint8)
        np.cumsum(zero, axis=1, out=zeros[:, 1:])
        np.cumsum(old, axis=1, out=others[:, 1:])
        b, c = np.nonzero(zero)
        nth = np.full((len(lane), 65), 64, np.uint8)
        nth[b, zeros[b, c]] = c
        zeros, others, nth = zeros.ravel(), others.ravel(), nth.ravel()
        before = np.r_[0, np.cumsum(others[64::65], dtype=np.int64)]
        b, c = np.nonzero(old)
        cells, shift = (self.order[b] << 6) + c, self.al[lane[b]]
        noted = []  # (first of the coefficients gone over, their number, place of their bits)
        pos, at, k, last, ss, se, al, table, limit = self.pos.copy(), self.first.copy(), self.ss.copy(), self.last, self.ss, self.se, self.al, self.tables_of[:, 0], self.limit
        while len(pos):
            code = self.luts[table + (self._peek(pos) >> 16 & 0xFFFF)].astype(np.int64)
            if (code == 0).any() or (pos > limit).any():
                raise ValueError("damaged scan")
            pos += code >> 8
            run, size = code >> 4 & 15, code & 15
            peek = self._peek(pos) & 0xFFFFFFFF
            new, ends = size > 0, (size == 0) & (run < 15)
            i = at * 65 + k
            place = nth[at * 65 + np.minimum(zeros[i] + run, 64)].astype(np.int64)
            inside = ~ends & (place <= se)
            to = np.where(inside, place, se + 1)
            start = before[at] + others[i]
            next_at = np.where(ends, np.minimum(at + (1 << run) + (peek >> (32 - run)) * (run > 0), last), at)
            pos += np.where(ends, run, new)
            count = np.where(ends, before[next_at] - start, others[at * 65 + to].astype(np.int64) - others[i])
            some = np.flatnonzero(count)
            noted.append((start[some], count[some], pos[some]))
            pos += count
            put = np.flatnonzero(new & inside)
            flat[(self.order[at[put]] << 6) + place[put]] = np.where(peek[put] >> 31 > 0, 1, -1) << al[put]
            over = ~ends & (to >= se)
            at = next_at + over
            k = np.where(over | ends, ss, to + 1)
            live = at < last
            if not live.all():
                if (pos > limit).any():
                    raise ValueError("damaged scan")
                pos, at, k, last, ss, se, al, table, limit = (x[live] for x in (pos, at, k, last, ss, se, al, table, limit))
        start, count, pos = (np.concatenate(x) for x in zip(*noted, strict=True))
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        which, bits = np.repeat(start, count) + within, self._peek(np.repeat(pos, count) + within) >> 31 & 1
        cell = cells[which]
        flat[cell] += (np.sign(flat[cell]) * (bits << shift[which])).astype(np.int32)

    def stored(self, k: int) -> np.ndarray:
        """(blocks, 64): the coefficients of image k, component by component, row by row."""
        parts = list(self.images[k].components.values())
        return self.coefficients[parts[0].base : parts[-1].base + parts[-1].across * parts[-1].down]

    @cached_property
    def sampled(self) -> np.ndarray:
        """(blocks, 64) samples of all images' blocks."""
        parts = [(c, image.quants[c.quant]) for image in self.images for c in image.components.values()]
        kinds: dict[bytes, int] = {}
        kind = np.repeat([kinds.setdefault(q.tobytes(), len(kinds)) for _, q in parts], [c.across * c.down for c, _ in parts])
        tables = np.stack([np.frombuffer(q, np.int64) for q in kinds]).astype(np.int32)
        out = np.empty((self.blocks, 64), np.uint8)
        for lo in range(0, self.blocks, 4096):
            some = slice(lo, lo + 4096)
            out[some] = samples(self.coefficients[some] * (tables if len(tables) == 1 else tables[kind[some]]))
        return out

    def rgb(self, k: int) -> np.ndarray:
        """(height, width, 3) uint8 of image k."""
        return np.stack(self.channels(k), -1)

    def channels(self, k: int) -> tuple[np.ndarray, ...]:
        """R, G and B of image k: inverse transform, upsampling by repetition, colour conversion."""
        image = self.images[k]
        h, v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
        planes = []
        for c in image.components.values():
            s = self.sampled[c.base : c.base + c.across * c.down].reshape(c.down, c.across, 8, 8).swapaxes(1, 2).reshape(c.down * 8, c.across * 8)
            planes.append(upsampled(s, h // c.h, v // c.v)[: image.height, : image.width])
        if len(planes) == 1:
            return (planes[0],) * 3
        return to_rgb(*planes[:3])


def samples(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) dequantised coefficients in zigzag order -> (n, 64) samples, uint8."""
    s = blocks.astype(np.float64) @ _IDCT
    s *= 1 / _SCALE
    s += 128.5
    return np.clip(s, 0, 255, out=s).astype(np.uint8)


def upsampled(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """Each sample repeated, ``across`` times in its row, and each row ``down`` times."""
    if across == down == 1:
        return plane
    h, w = plane.shape
    return np.broadcast_to(plane[:, None, :, None], (h, down, w, across)).reshape(h * down, w * across)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Constants with 16 bits after the point, so that results do not depend on the order of sums."""
    y, cb, cr = (y.astype(np.int32) << 16) + (1 << 15), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128

    def fix(x: np.ndarray) -> np.ndarray:
        x >>= 16
        return np.clip(x, 0, 255, out=x).astype(np.uint8)

    return fix(y + 91881 * cr), fix(y - 22554 * cb - 46802 * cr), fix(y + 116130 * cb)

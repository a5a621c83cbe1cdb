"""Operator 10: media columns as progressive JPEG, coded and decoded with arrays.

Bytes are stored losslessly in the format's own unit: each 8x8 block carries 64 bytes as its 64 quantised
coefficients (in zigzag order, quantisers of 1), bytes that are common in text as the smallest ones. Every MCU is a restart interval, so all
intervals of a scan are byte-aligned and are decoded side by side: one array step handles the next symbol of every block. Images
are written to the shared folder and read back before anything is told of them.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import settle, slices, table, trimmed

# The zigzag order of an 8x8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)))
#: Scans of the encoder: (components, first and last coefficient, high and low bit position).
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 63, 0, 0), ((1,), 1, 5, 0, 1), ((2,), 1, 5, 0, 1),
    ((1,), 6, 63, 0, 0), ((2,), 6, 63, 0, 0),
    ((1,), 1, 5, 1, 0), ((2,), 1, 5, 1, 0),
    ((0, 1, 2), 0, 0, 1, 0),
)
#: Sampling factors of the encoder: four luma blocks and one of each chroma make an MCU.
SAMPLING = ((2, 2), (1, 1), (1, 1))


#: Fixed value: bytes that are common in prose, commonest first.
COMMON = b" enthairosudlcgbmfpwyvkzq\xc3.,!-\n\x00" + b"ETSANIORHDLCUMGBPFWKVY" + b"0123456789"
#: Coefficient of each byte, 0, -1, 1, -2, 2 and so on by rank: COMMON, then the others by value; and the byte of each coefficient plus 128.
COEFFICIENT = np.zeros(256, np.int64)
COEFFICIENT[[*COMMON, *(b for b in range(256) if b not in COMMON)]] = [r // 2 if r % 2 == 0 else -(r + 1) // 2 for r in range(256)]
BYTE = np.zeros(256, np.uint8)
BYTE[COEFFICIENT + 128] = np.arange(256)


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Canonical Huffman code and length by symbol, and the segment body, from code lengths by symbol."""
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    counts, order, now = [0] * 17, [], 0
    for n in range(1, 17):
        now <<= 1
        for s in sorted(s for s, m in lengths.items() if m == n):
            code[s], size[s] = now, n
            now += 1
            counts[n] += 1
            order.append(s)
    return code, size, bytes(counts[1:]) + bytes(order)


def _lengths(weights: dict[int, float]) -> dict[int, int]:
    """Huffman code lengths, with one more symbol of the least weight, so that no real one gets the all-ones code."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate([*weights.items(), (-1, 0.0)])]
    heapq.heapify(heap)
    out, made = dict.fromkeys([*weights, -1], 0), len(heap)
    while len(heap) > 1:
        (v, _, a), (w, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a, *b):
            out[s] += 1
        heapq.heappush(heap, (v + w, made, (*a, *b)))
        made += 1
    del out[-1]
    return out


#: How often a coefficient of text has so many bits; every symbol of a progressive scan has a code, whatever the bytes are.
SHARES = (0.15, 0.19, 0.25, 0.23, 0.12, 0.03, 0.02, 0.01, 0.004, 0.001, 0.001, 0.001)
DC_CODE, DC_SIZE, DC_BODY = _codes(_lengths({s: SHARES[s] + 0.03 for s in range(12)}))
AC_CODE, AC_SIZE, AC_BODY = _codes(_lengths({r << 4 | s: max(1e-4, (SHARES[s] if s else 0.02) * 0.17**r) for r in range(16) for s in range(9) if s or r in (0, 15)}))


def _bits_of(v: np.ndarray) -> np.ndarray:
    """Number of bits of |v|."""
    return np.where(v == 0, 0, np.frexp(np.abs(v).astype(np.float64))[1]).astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


class _Bits:
    """Codes gathered by interval; each interval ends on a byte, filled with ones."""

    def __init__(self, intervals: int) -> None:
        self.n = intervals
        self.length = np.zeros(intervals, np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, at: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
        """One code for each of distinct intervals."""
        before = self.length[at]
        self.length[at] = before + size
        self.rows.append((at, value, size, before))

    def stream(self, counts: np.ndarray) -> list[bytes]:
        """Entropy-coded bytes of each image; counts: intervals of each image, in order."""
        at, value, size, before = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        length = self.length
        whole = -(-length // 8)
        first = np.concatenate([[0], np.cumsum(whole)])
        pos = before + first[at] * 8
        fill = whole * 8 - length
        pos = np.concatenate([pos, first[:-1] * 8 + length])
        value = np.concatenate([value, (1 << fill) - 1])
        size = np.concatenate([size, fill])
        word = pos >> 5
        lane = value.astype(np.uint64) << np.minimum(64 - (pos & 31) - size, 63).astype(np.uint64)
        words = int(first[-1]) // 4 + 3
        high = np.bincount(word, (lane >> np.uint64(32)).astype(np.float64), words)
        low = np.bincount(word + 1, (lane & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
        data = (high + low).astype(np.uint64).astype(">u4").view(np.uint8)[: int(first[-1])]
        # a zero goes after each 0xFF, a restart marker before each interval but an image's first
        local = np.arange(self.n) - np.repeat(np.cumsum(counts) - counts, counts)
        marks = np.cumsum(local > 0)
        ff = data == 0xFF
        stuffed = np.concatenate([[0], np.cumsum(ff)])
        out = np.zeros(len(data) + int(stuffed[-1]) + 2 * int(marks[-1]), np.uint8)
        out[np.arange(len(data)) + stuffed[:-1] + 2 * np.repeat(marks, whole)] = data
        begin = first[:-1] + stuffed[first[:-1]] + 2 * marks
        mark = begin[local > 0] - 2
        out[mark] = 0xFF
        out[mark + 1] = 0xD0 + (local[local > 0] - 1) % 8
        raw, cuts = out.tobytes(), [*begin[np.cumsum(counts) - counts].tolist(), len(out)]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def _encode_scan(planes: list[np.ndarray], lo: int, hi: int, high: int, low: int, counts: np.ndarray) -> list[bytes]:
    """planes: for each component of the scan, coefficients (intervals, blocks of an interval, 64); counts: intervals of each image."""
    n = len(planes[0])
    out, rows = _Bits(n), np.arange(n)
    if lo == 0 and high == 0:
        for p in planes:
            last = np.zeros(n, np.int64)
            for j in range(p.shape[1]):
                now = p[:, j, 0] >> low
                v = now - last
                size = _bits_of(v)
                out.add(rows, DC_CODE[size] << size | _extra(v, size), DC_SIZE[size] + size)
                last = now
    elif lo == 0:
        for p in planes:
            for j in range(p.shape[1]):
                out.add(rows, p[:, j, 0] >> low & 1, np.ones(n, np.int64))
    else:
        c = planes[0][:, 0, :]
        known = np.abs(c[:, lo : hi + 1]) >> high if high else np.zeros((n, hi - lo + 1), np.int64)
        v = np.where(c < 0, -(-c >> low), c >> low)[:, lo : hi + 1]
        new = (v != 0) & (known == 0) if high else v != 0
        left = new[:, ::-1].cumsum(1)[:, ::-1]  # new ones from here on
        run = np.zeros(n, np.int64)
        held = [np.zeros(n, np.int64), np.zeros(n, np.int64)]  # correction bits that wait for the next code: value, count
        none = np.zeros(n, bool)
        for k in range(hi - lo + 1):
            # sixteen zeros before a later new one
            old = known[:, k] != 0 if high else none
            long = (run == 16) & (left[:, k] > 0)
            if long.any():
                at = rows[long]
                out.add(at, AC_CODE[0xF0] << held[1][long] | held[0][long], AC_SIZE[0xF0] + held[1][long])
                run[long] = held[0][long] = held[1][long] = 0
            if high and old.any():
                held[0][old] = held[0][old] << 1 | (np.abs(v[old, k]) & 1)
                held[1][old] += 1
            hit = new[:, k]
            if hit.any():
                x, r = v[hit, k], run[hit]
                size = np.ones(len(x), np.int64) if high else _bits_of(x)
                extra = (x > 0).astype(np.int64) if high else _extra(x, size)
                symbol = r << 4 | size
                value = (AC_CODE[symbol] << size | extra) << held[1][hit] | held[0][hit]
                out.add(rows[hit], value, AC_SIZE[symbol] + size + held[1][hit])
                run[hit] = held[0][hit] = held[1][hit] = 0
            run[~hit & ~old] += 1
        tail = (run > 0) | (held[1] > 0)
        if tail.any():
            out.add(rows[tail], AC_CODE[0] << held[1][tail] | held[0][tail], AC_SIZE[0] + held[1][tail])
    return out.stream(counts)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEGs (4:2:0) whose coefficients are the payloads, coded together; a comment tells the payload's length.

    A payload's length is a positive multiple of 64. Blocks that fill up the last MCUs are zero.
    """
    sizes = np.array([len(p) // 64 for p in payloads])
    wide = np.array([max(1, math.isqrt(-(-int(n) // 6))) for n in sizes])
    tall = -(-(-(-sizes // 6)) // wide)
    if (np.maximum(wide, tall) * 16 > 65535).any():
        raise JpegError("the payload is too long for one image")
    mcus = wide * tall
    base = np.concatenate([[0], np.cumsum(mcus)])
    blocks = np.zeros((int(base[-1]) * 6, 64), np.int64)
    luma = []
    for p, n, w, t, at in zip(payloads, sizes.tolist(), wide.tolist(), tall.tolist(), base.tolist(), strict=False):
        blocks[at * 6 : at * 6 + n] = COEFFICIENT[np.frombuffer(p, np.uint8)].reshape(-1, 64)
        y, x = np.divmod(np.arange(4 * w * t), 2 * w)
        luma.append(at * 4 + ((y >> 1) * w + (x >> 1)) * 4 + (y & 1) * 2 + (x & 1))
    blocks = blocks.reshape(-1, 6, 64)
    split = [blocks[:, :4], blocks[:, 4:5], blocks[:, 5:]]
    raster = split[0].reshape(-1, 1, 64)[np.concatenate(luma)]  # luma blocks by rows, for scans of that component alone
    tables = _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC4, b"\x00" + DC_BODY) + _segment(0xC4, b"\x10" + AC_BODY) + _segment(0xDD, b"\0\1")
    parts = []
    for p, w, t in zip(payloads, wide.tolist(), tall.tolist(), strict=True):
        frame = struct.pack(">BHHB", 8, t * 16, w * 16, 3) + b"".join(bytes((i + 1, h << 4 | v, 0)) for i, (h, v) in enumerate(SAMPLING))
        parts.append([b"\xff\xd8", _segment(0xFE, b"payload %d" % len(p)), tables[0], _segment(0xC2, frame), tables[1]])
    for comps, lo, hi, high, low in SCRIPT:
        alone = comps == (0,)
        planes = [raster] if alone else [split[c] for c in comps]
        head = _segment(0xDA, bytes([len(comps)]) + b"".join(bytes((c + 1, 0)) for c in comps) + bytes((lo, hi, high << 4 | low)))
        for part, coded in zip(parts, _encode_scan(planes, lo, hi, high, low, mcus * 4 if alone else mcus), strict=True):
            part += (head, coded)
    return [b"".join([*part, b"\xff\xd9"]) for part in parts]


class JpegError(ValueError):
    """A stream that is not a progressive JPEG this decoder knows, or a damaged one."""


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks of the padded plane, and of the plane itself
    tall: int = 0
    own_wide: int = 0
    own_tall: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Decoded:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes


class _Lanes:
    """Bit readers of many restart intervals, moved together."""

    def __init__(self, data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> None:
        d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        self.window = d[:-4] << 32 | d[1:-3] << 24 | d[2:-2] << 16 | d[3:-1] << 8 | d[4:]
        self.pos, self.stop = first * 8, stop * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        """32 bits from each lane's place; beyond the end zeros."""
        pos = self.pos[at]
        return self.window.take(pos >> 3, mode="clip") >> (8 - (pos & 7)) & 0xFFFFFFFF

    def ended(self) -> None:
        if (self.pos > self.stop).any():
            raise JpegError("an interval is too short")

    def bits(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        out = self.peek(at) >> (32 - n)
        self.pos[at] += n
        return out

    def symbol(self, at: np.ndarray, look: np.ndarray, extra: bool) -> tuple[np.ndarray, np.ndarray]:
        """The next Huffman symbol, and with extra the bits whose number its low half says."""
        word = self.peek(at)
        got = look[word >> 16]
        if (got < 0).any():
            raise JpegError("no such code")
        size, symbol = got >> 8, got & 255
        if not extra:
            self.pos[at] += size
            return symbol, symbol
        n = symbol & 15
        value = (word << size & 0xFFFFFFFF) >> (32 - n)
        self.pos[at] += size + n
        return symbol, value


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """By 16 bits: size << 8 | symbol, or -1."""
    out, code, at = np.full(1 << 16, -1, np.int64), 0, 0
    for n in range(1, 17):
        for s in symbols[at : at + counts[n - 1]]:
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
            code += 1
        at += counts[n - 1]
        code <<= 1
    return out


def _extend(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((v < (1 << np.maximum(size, 1) - 1)) & (size > 0), v - (1 << size) + 1, v)


def _decode_dc(lanes: _Lanes, units: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first: np.ndarray, count: np.ndarray, high: int, low: int) -> None:
    """units: for each block of an MCU, its component's coefficients, the block's number by MCU, the code table.

    first, count: MCUs of each interval.
    """
    last = {id(c): np.zeros(len(first), np.int64) for c, _, _ in units}
    for step in range(int(count.max())):
        at = np.nonzero(count > step)[0]
        for coef, where, look in units:
            target = where[first[at] + step]
            if high:
                coef[target, 0] |= (lanes.bits(at, 1) << low).astype(np.int32)
            else:
                size, raw = lanes.symbol(at, look, True)
                now = last[id(coef)]
                now[at] += _extend(raw, size & 15)
                coef[target, 0] = now[at] << low


def _decode_ac(lanes: _Lanes, coef: np.ndarray, where: np.ndarray, first: np.ndarray, count: np.ndarray, look: np.ndarray, lo: int, hi: int, high: int, low: int) -> None:
    skip = np.zeros(len(first), np.int64)  # blocks of an end-of-band run still to come
    for step in range(int(count.max())):
        at = np.nonzero(count > step)[0]
        (_refine if high else _first)(lanes, coef, at, where[first[at] + step], look, lo, hi, low, skip)


def _first(lanes: _Lanes, coef: np.ndarray, at: np.ndarray, block: np.ndarray, look: np.ndarray, lo: int, hi: int, low: int, skip: np.ndarray) -> None:
    idle = skip[at] > 0
    skip[at[idle]] -= 1
    at, block = at[~idle], block[~idle]
    k = np.full(len(at), lo, np.int64)
    while len(at):
        symbol, raw = lanes.symbol(at, look, True)
        run, size = symbol >> 4, symbol & 15
        band = (size == 0) & (run < 15)
        if band.any():
            more = at[band]
            skip[more] = (1 << run[band]) - 1 + lanes.bits(more, run[band])
        k += run
        hit = size > 0
        if (k[hit] > hi).any():
            raise JpegError("a run goes beyond its band")
        coef[block[hit], k[hit]] = _extend(raw[hit], size[hit]) << low
        k += 1
        on = ~band & (k <= hi)
        if not on.all():
            at, block, k = at[on], block[on], k[on]


def _refine(lanes: _Lanes, coef: np.ndarray, at: np.ndarray, block: np.ndarray, look: np.ndarray, lo: int, hi: int, low: int, skip: np.ndarray) -> None:
    """Blocks walk the band together. zeros: still to pass before the pending value is placed; -1: the next code is due."""
    n = len(at)
    ended = skip[at] > 0
    zeros, pending = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for k in range(lo, hi + 1):
        due = np.nonzero(~ended & (zeros < 0))[0]
        if len(due):
            symbol, _ = lanes.symbol(at[due], look, False)
            run, size = symbol >> 4, symbol & 15
            if (size > 1).any():
                raise JpegError("a refinement of more than one bit")
            band = (size == 0) & (run < 15)
            if band.any():
                to = due[band]
                skip[at[to]] = (1 << run[band]) + lanes.bits(at[to], run[band])
                ended[to] = True
            zeros[due] = np.where(band, -1, run)
            pending[due] = 0
            new = due[size == 1]
            if len(new):
                pending[new] = np.where(lanes.bits(at[new], 1) == 1, 1, -1) << low
        now = coef[block, k]
        old = np.nonzero(now != 0)[0]
        if len(old):
            bit = lanes.bits(at[old], 1) << low
            coef[block[old], k] = now[old] + np.where(now[old] > 0, bit, -bit)
        free = np.nonzero((now == 0) & ~ended)[0]
        if len(free):
            place = free[zeros[free] == 0]
            coef[block[place], k] = pending[place]
            zeros[free] -= 1
    skip[at[ended]] -= 1


@dataclass
class _Scan:
    key: tuple  # chosen components and tables, band, bit positions, restart interval, table bodies
    start: int
    end: int


def _parse(data: bytes, base: int, markers: list[int]) -> tuple[Decoded, list[_Scan]]:
    """Frame and scans of one image; markers: places, counted from base, where entropy-coded bytes can end."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG")
    pos, out, huff, interval, comment = 2, None, {}, 0, b""
    quants: dict[int, np.ndarray] = {}
    scans: list[_Scan] = []
    ids: list[int] = []
    while data[pos : pos + 2] != b"\xff\xd9":
        if pos + 4 > len(data) or data[pos] != 0xFF:
            raise JpegError("no marker where one is due")
        marker = data[pos + 1]
        if marker == 0xFF:
            pos += 1
            continue
        size = data[pos + 2] << 8 | data[pos + 3]
        body, pos = data[pos + 4 : pos + 2 + size], pos + 2 + size
        if marker == 0xDB:
            while body:
                step = 2 if body[0] >> 4 else 1
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * step], ">u2" if step == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * step :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                huff[body[0]] = body[1 : 17 + count]
                body = body[17 + count :]
        elif marker == 0xDD:
            interval = body[0] << 8 | body[1]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            comps = [Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            ids = [body[6 + 3 * i] for i in range(n)]
            out = Decoded(width, height, comps, quants, comment)
            hm, vm = max(c.h for c in comps), max(c.v for c in comps)
            across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
            for c in comps:
                c.wide, c.tall = across * c.h, down * c.v
                c.own_wide, c.own_tall = -(-width * c.h // (8 * hm)), -(-height * c.v // (8 * vm))
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise JpegError("not a progressive Huffman JPEG")
        elif marker == 0xDA:
            if out is None:
                raise JpegError("a scan before its frame")
            n = body[0]
            chosen = tuple((ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n))
            lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
            at = bisect_left(markers, base + pos)
            end = markers[at] - base if at < len(markers) else len(data)
            if end >= len(data):
                raise JpegError("the image ends inside a scan")
            used = tuple(huff.get(t >> 4 if lo == 0 else 16 | t & 15) for _, t in chosen)
            scans.append(_Scan((chosen, lo, hi, bits, interval, used), base + pos, base + end))
            pos = end
    if out is None:
        raise JpegError("no frame")
    out.comment = comment
    return out, scans


@lru_cache(64)
def _table(body: bytes | None) -> np.ndarray:
    return np.zeros(0) if body is None else _lookup(body[:16], body[16:])


def decode_many(images: list[bytes]) -> list[Decoded]:
    """All scans of progressive JPEGs accumulated into coefficients, blocks in zigzag order by raster of each component.

    Images of the same sampling, tables and script are decoded together, interval by interval.
    """
    raw = np.frombuffer(b"".join(images), np.uint8)
    ff = np.nonzero(raw[:-1] == 0xFF)[0]
    after = raw[ff + 1]
    inner = (after == 0) | ((after >= 0xD0) & (after <= 0xD7))  # a stuffed 0xFF or a restart
    markers = ff[~inner].tolist()
    ff, after = ff[inner], after[inner]
    base, parsed, alike = 0, [], defaultdict(list)
    for i, data in enumerate(images):
        image, scans = _parse(data, base, markers)
        base += len(data)
        parsed.append(image)
        alike[tuple((c.h, c.v) for c in image.components), tuple(s.key for s in scans)].append((image, scans))
    for group in alike.values():
        frames = [image for image, _ in group]
        coefs, starts = [], []
        for k in range(len(frames[0].components)):
            starts.append(np.concatenate([[0], np.cumsum([f.components[k].wide * f.components[k].tall for f in frames])]))
            coefs.append(np.zeros((int(starts[-1][-1]), 64), np.int32))
        for number, scan in enumerate(group[0][1]):
            chosen, lo, hi, bits, interval, used = scan.key
            # the scan's bytes of all images without stuffing and markers, and where intervals begin
            spans = [(scans[number].start, scans[number].end) for _, scans in group]
            coded, firsts = [], []
            size = 0
            for start, end in spans:
                i, j = np.searchsorted(ff, (start, end))
                drop = np.zeros(end - start, bool)
                drop[ff[i:j][after[i:j] == 0] + 1 - start] = True
                marks = ff[i:j][after[i:j] != 0] - start
                drop[marks] = drop[marks + 1] = True
                kept = ~drop
                mine = raw[start:end][kept]
                firsts.append(np.concatenate([[0], np.cumsum(kept)[marks] if len(marks) else []]).astype(np.int64) + size)
                coded.append(mine)
                size += len(mine)
            first_byte = np.concatenate(firsts)
            lanes = _Lanes(np.concatenate(coded), first_byte, np.append(first_byte[1:], size))
            places: list[list[np.ndarray]] = []
            totals = []
            for f, frame in enumerate(frames):
                mine = []
                down, across = frame.components[0].tall // frame.components[0].v, frame.components[0].wide // frame.components[0].h
                for k, _ in chosen:
                    c = frame.components[k]
                    if len(chosen) == 1:
                        mine.append((np.arange(c.own_tall)[:, None] * c.wide + np.arange(c.own_wide)).ravel() + starts[k][f])
                    else:
                        for y in range(c.v):
                            for x in range(c.h):
                                mine.append(((np.arange(down)[:, None] * c.v + y) * c.wide + np.arange(across) * c.h + x).ravel() + starts[k][f])
                places.append(mine)
                totals.append(len(mine[0]))
                if len(firsts[f]) != -(-totals[-1] // (interval or totals[-1])):
                    raise JpegError("restart markers are missing")
            where = [np.concatenate(x) for x in zip(*places, strict=True)]
            begin = np.cumsum([0, *totals[:-1]])
            first = np.concatenate([b + np.arange(0, t, interval or t) for b, t in zip(begin, totals, strict=True)])
            count = np.diff(np.append(first, sum(totals)))
            if lo == 0:
                owner = [i for i, (k, _) in enumerate(chosen) for _ in range(1 if len(chosen) == 1 else frames[0].components[k].h * frames[0].components[k].v)]
                units = [(coefs[chosen[i][0]], w, _table(used[i])) for i, w in zip(owner, where, strict=True)]
                _decode_dc(lanes, units, first, count, bits >> 4, bits & 15)
            else:
                _decode_ac(lanes, coefs[chosen[0][0]], where[0], first, count, _table(used[0]), lo, hi, bits >> 4, bits & 15)
            lanes.ended()
        for f, frame in enumerate(frames):
            for k, c in enumerate(frame.components):
                c.coef = coefs[k][starts[k][f] : starts[k][f + 1]]
    return parsed


def decode(data: bytes) -> Decoded:
    return decode_many([data])[0]


def payload_of(image: Decoded) -> bytes:
    """The bytes that encode_payload stored."""
    y, cb, cr = image.components
    wide, tall = cb.wide, cb.tall
    luma = y.coef.reshape(tall, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    blocks = np.concatenate([luma, cb.coef[:, None], cr.coef[:, None]], 1)
    return BYTE[blocks + 128].tobytes()[: int(image.comment.split()[1])]


_k = np.arange(8)
BASIS = np.where(_k[:, None] == 0, math.sqrt(0.125), 0.5) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * math.pi / 16)
#: From 64 zigzag coefficients to 64 samples.
INVERSE = np.einsum("ux,vy->uvxy", BASIS, BASIS).reshape(64, 64)[ZIGZAG].astype(np.float32)


def rgb(image: Decoded) -> np.ndarray:
    """The full-resolution RGB tensor (height, width, 3): inverse transform, chroma upsampled by repetition."""
    planes = []
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    for c in image.components:
        samples = (c.coef * image.quants[c.quant].astype(np.int32)).astype(np.float32) @ INVERSE
        samples += 128
        np.clip(samples, 0, 255, samples)
        plane = samples.reshape(c.tall, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.tall * 8, c.wide * 8)
        planes.append((plane, vm // c.v, hm // c.h))
    full = lambda x, v, h: x.repeat(v, 0).repeat(h, 1)[: image.height, : image.width] if v * h > 1 else x[: image.height, : image.width]
    out = np.empty((image.height, image.width, 3), np.uint8)
    y = full(*planes[0])
    if len(planes) == 1:
        out[:] = np.rint(y)[..., None]
        return out
    (cb, *to), (cr, _, _) = planes[1:]
    cb, cr = cb - np.float32(128), cr - np.float32(128)
    shifts = np.float32(1.402) * cr, np.float32(-0.344136) * cb - np.float32(0.714136) * cr, np.float32(1.772) * cb
    for i, shift in enumerate(shifts):
        channel = y + full(shift, *to)
        np.clip(channel, 0, 255, channel)
        out[..., i] = np.rint(channel, channel)
    return out


def feature(tensor: np.ndarray) -> str:
    """Size, and the mean of each channel to two places."""
    mean = tensor.reshape(-1, 3).sum(0, dtype=np.int64) / (tensor.shape[0] * tensor.shape[1])
    return f"{tensor.shape[1]}x{tensor.shape[0]} " + " ".join(f"{m:.2f}" for m in mean)


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(encode_payloads([padded(x) for x in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])


def _load(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in slices(batches, "media", 1 << 20):
        rows, tensors = [], []
        stored = batch.column(2).to_pylist()
        for media, image in zip(stored, decode_many(stored), strict=True):
            payload, tensor = payload_of(image), rgb(image)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(tensor)))
            if keep:
                tensors.append((tensor.shape[1], tensor.shape[0], tensor.tobytes()))
        cols = [*batch.columns[:2], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))]
        if keep:
            cols += [batch.column(2), *(pa.array(c, t) for c, t in zip(zip(*tensors, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", *names, *(["media", "width", "height", "rgb"] if keep else [])])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a JPEG, of each text: rows for a table; see media_columns."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lambda b: trimmed(_store(b)), f"doc_id {kind}, n_bytes bigint, media binary")


def load_media(media: DataFrame, keep: bool = False) -> DataFrame:
    """Figures of each row of a media table, from the stored bytes alone; with keep also the JPEG and its RGB tensor. Damaged images raise JpegError."""
    kind = dict(media.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lambda b: trimmed(_load(b, keep)), schema + ", media binary, width bigint, height bigint, rgb binary" * keep)


def media_columns(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id and figures of each text, stored as a table of JPEGs in the shared folder and read back; with keep also the JPEG and its RGB tensor.

    Null and empty texts are a payload of 64 zero bytes. Equal texts give equal values, so repeated rows do. An
    empty table gives no rows; further columns are not read. Texts are coded in slices of about a
    megabyte, one text at least; a text beyond some 6 GB has no room in one image and raises JpegError.
    """
    return load_media(settle(store_media(docs), compression="none"), keep)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))

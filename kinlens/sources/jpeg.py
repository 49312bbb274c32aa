"""JPEG pixels in numpy: baseline, extended and progressive Huffman coding with 8-bit samples.

Entropy decoding goes symbol by symbol; dequantising, the inverse transform and colours are array operations. Arithmetic coding,
lossless modes and 12-bit samples are not read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

#: The zigzag order is made by its rule, diagonals in turn.
ZIGZAG = [x[2] for x in sorted((r + c, (r if (r + c) % 2 else c), 8 * r + c) for r in range(8) for c in range(8))]
_BASIS = np.array([[np.sqrt((1 if k else 0.5) / 4) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)], np.float32)
_END = re.compile(rb"\xff+[\x01-\xcf\xd8-\xfe]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


class Component(NamedTuple):
    """A colour component: its sampling factors, quantiser, and blocks (rows and columns padded to whole MCUs, and those that it has)."""

    id: int
    h: int
    v: int
    table: int
    rows: int
    columns: int
    own_rows: int
    own_columns: int
    coefficients: np.ndarray  # int32, rows * columns * 64, in zigzag order


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """Length << 8 | symbol for all 16-bit prefixes; 0 where no code begins."""
    table = np.zeros(1 << 16, np.uint16)
    code = k = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table.tolist()


class _Bits:
    """Bits of a restart interval; ``window`` has 32 bits from every byte."""

    def __init__(self, raw: bytes) -> None:
        b = np.frombuffer(raw.replace(b"\xff\0", b"\xff") + bytes(8), np.uint8).astype(np.uint32)
        self.window = memoryview(b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:])
        self.at = 0

    def symbol(self, table: list[int]) -> int:
        x = table[self.window[self.at >> 3] >> (16 - (self.at & 7)) & 0xFFFF]
        if not x:
            raise ValueError("no such code")
        self.at += x >> 8
        return x & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.window[self.at >> 3] >> (32 - n - (self.at & 7)) & (1 << n) - 1
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _sequential(bits: _Bits, out: memoryview, base: int, dc: list[int], ac: list[int], before: int) -> int:
    """A block of all coefficients; the new DC value."""
    window, at = bits.window, bits.at
    x = dc[window[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
    at += x >> 8
    s = x & 255
    if not x or s > 16:
        raise ValueError("no such code")
    if s:
        v = window[at >> 3] >> (32 - s - (at & 7)) & (1 << s) - 1
        at += s
        before += v if v >> (s - 1) else v - (1 << s) + 1
    out[base] = before
    k, end = base + 1, base + 64
    while k < end:
        x = ac[window[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
        if not x:
            raise ValueError("no such code")
        at += x >> 8
        s = x & 15
        if s:
            k += x >> 4 & 15
            v = window[at >> 3] >> (32 - s - (at & 7)) & (1 << s) - 1
            at += s
            if k >= end:
                raise ValueError("a run beyond the block")
            out[k] = v if v >> (s - 1) else v - (1 << s) + 1
            k += 1
        elif x & 240 == 240:
            k += 16
        else:
            break
    bits.at = at
    return before


def _spectral_first(bits: _Bits, out: memoryview, base: int, ac: list[int], first: int, last: int, low: int) -> int:
    """A block's first pass over a band; the number of blocks after it whose band is empty."""
    k = first
    while k <= last:
        x = bits.symbol(ac)
        run, s = x >> 4, x & 15
        if s:
            k += run
            if k > last:
                raise ValueError("a run beyond the band")
            out[base + k] = bits.signed(s) * (1 << low)
            k += 1
        elif run == 15:
            k += 16
        else:
            return (1 << run) - 1 + bits.take(run)
    return 0


def _spectral_more(bits: _Bits, out: memoryview, base: int, ac: list[int], first: int, last: int, low: int, ended: int) -> int:
    """A further bit of a block's band; ``ended`` counts this block and those after it that get no new coefficient."""
    one = 1 << low

    def refined(k: int, zeros: int) -> int:
        """Past coefficients that are known, each with a bit of its own, and ``zeros`` unknown ones."""
        while k <= last:
            c = out[base + k]
            if c:
                if bits.take(1) and not abs(c) & one:
                    out[base + k] = c + one if c > 0 else c - one
            elif not zeros:
                break
            else:
                zeros -= 1
            k += 1
        return k

    k = first
    while not ended and k <= last:
        x = bits.symbol(ac)
        run, s = x >> 4, x & 15
        if not s and run < 15:
            ended = (1 << run) + bits.take(run)
            break
        value = (one if bits.take(1) else -one) if s else 0
        k = refined(k, run)
        if value and k <= last:
            out[base + k] = value
        k += 1
    if ended:
        refined(k, 64)
        ended -= 1
    return ended


def _places(parts: list[Component], width: int, height: int) -> tuple[list[int], list[list[int]]]:
    """The component of each block of an MCU, and the first coefficient of each block for every MCU in order."""
    if len(parts) == 1:
        c = parts[0]
        at = np.arange(c.own_rows)[:, None] * c.columns + np.arange(c.own_columns)
        return [0], (64 * at).reshape(-1, 1).tolist()
    slots, columns = [], []
    for k, c in enumerate(parts):
        for v in range(c.v):
            for h in range(c.h):
                slots.append(k)
                rows = np.arange(c.rows // c.v)[:, None] * c.v + v
                columns.append((64 * (rows * c.columns + np.arange(c.columns // c.h) * c.h + h)).ravel())
    return slots, np.stack(columns, 1).tolist()


def _scan(raw: bytes, parts: list[Component], tables: list[tuple[list[int] | None, list[int] | None]], band: tuple[int, int, int, int], progressive: bool, restart: int, places: tuple) -> None:
    """Decode the entropy-coded data of a scan into the components' coefficients."""
    first, last, high, low = band
    slots, blocks = places
    outs = [memoryview(c.coefficients) for c in parts]
    step = restart or len(blocks)
    for raw_part, start in zip(_RESTART.split(raw), range(0, len(blocks), step)):
        bits, before, ended = _Bits(raw_part), [0] * len(parts), 0
        for mcu in blocks[start : start + step]:
            for k, base in zip(slots, mcu):
                dc, ac = tables[k]
                if not progressive:
                    before[k] = _sequential(bits, outs[k], base, dc, ac, before[k])
                elif not first and not high:
                    before[k] += bits.signed(bits.symbol(dc))
                    outs[k][base] = before[k] * (1 << low)
                elif not first:
                    outs[k][base] |= bits.take(1) << low
                elif not high:
                    ended = ended - 1 if ended else _spectral_first(bits, outs[k], base, ac, first, last, low)
                else:
                    ended = _spectral_more(bits, outs[k], base, ac, first, last, low, ended)


def _plane(c: Component, quantiser: np.ndarray, height: int, width: int, top_v: int, top_h: int) -> np.ndarray:
    """Samples of a component, spread over the image by linear interpolation between the centres of its samples."""
    natural = np.zeros((c.rows * c.columns, 64), np.float32)
    natural[:, ZIGZAG] = c.coefficients.reshape(-1, 64) * quantiser
    blocks = _BASIS.T @ natural.reshape(-1, 8, 8) @ _BASIS
    plane = blocks.reshape(c.rows, c.columns, 8, 8).swapaxes(1, 2).reshape(8 * c.rows, 8 * c.columns) + 128
    plane = np.clip(np.round(plane), 0, 255)
    for axis, n, s, top in ((0, height, c.v, top_v), (1, width, c.h, top_h)):
        own = -(-n * s // top)
        at = np.clip((np.arange(n, dtype=np.float32) + 0.5) * s / top - 0.5, 0, own - 1)
        low = at.astype(int)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        below = np.take(plane, low, axis)
        plane = below if s == top else below + (np.take(plane, np.minimum(low + 1, own - 1), axis) - below) * part
    return plane


def _coloured(planes: list[np.ndarray], ids: list[int], adobe: int | None) -> np.ndarray:
    """Gray or RGB pixels of one, three (YCbCr, or RGB if marked so) or four components (CMYK or YCCK, inverted as Adobe writes them)."""
    if len(planes) == 1:
        return planes[0].astype(np.uint8)
    if (adobe if adobe is not None else 0 if ids[:3] == [82, 71, 66] or len(planes) == 4 else 1) != 0:
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        planes = [np.clip(x, 0, 255) for x in (y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b)] + planes[3:]
    if len(planes) == 4:
        black = planes[3] if adobe is not None else 255 - planes[3]
        planes = [(x if adobe is not None else 255 - x) * black / 255 for x in planes[:3]]
    return np.round(np.stack(planes[:3], 2)).astype(np.uint8)


def decode_jpeg(content: bytes) -> np.ndarray:
    """Pixels (rows, columns[, 3]) of a JPEG file; ValueError or IndexError where it can't be read whole."""
    at, quantisers, dcs, acs, parts, restart, adobe, scanned = 2, {}, {}, {}, [], 0, None, False
    width = height = 0
    progressive = False
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            raise ValueError("no marker")
        while content[at + 1] == 0xFF:
            at += 1
        marker = content[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        body, at = content[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float32)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                (acs if body[0] >> 4 else dcs)[body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            fields = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            if body[0] != 8 or not width or not height or len(fields) not in (1, 3, 4) or any(not (0 < h < 5 and 0 < v < 5) for _, h, v, _ in fields):
                raise ValueError("a form that isn't read")
            top_h, top_v = max(f[1] for f in fields), max(f[2] for f in fields)
            across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
            for i, h, v, q in fields:
                own = [-(-(-(-n * s // top)) // 8) for n, s, top in ((height, v, top_v), (width, h, top_h))]
                if len(fields) == 1:
                    h, v, across, down = 1, 1, own[1], own[0]
                parts.append(Component(i, h, v, q, down * v, across * h, *own, np.zeros(down * v * across * h * 64, np.int32)))
            if len(fields) == 1:
                top_h = top_v = 1
        elif marker in (0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("a form that isn't read")
        elif marker == 0xDA:
            chosen = [(next(c for c in parts if c.id == body[k]), body[k + 1]) for k in range(1, 1 + 2 * body[0], 2)]
            k = 1 + 2 * body[0]
            own = [c for c, _ in chosen]
            end = _END.search(content, at)
            if end is None:
                raise ValueError("the file ends within a scan")
            tables = [(dcs.get(t >> 4), acs.get(t & 15)) for _, t in chosen]
            _scan(content[at : end.start()], own, tables, (body[k], body[k + 1], body[k + 2] >> 4, body[k + 2] & 15), progressive, restart, _places(own, width, height))
            at, scanned = end.start(), True
    if not scanned:
        raise ValueError("no scan")
    return _coloured([_plane(c, quantisers[c.table], height, width, top_v, top_h) for c in parts], [c.id for c in parts], adobe)

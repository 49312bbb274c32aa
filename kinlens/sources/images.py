"""Decoding of image files with numpy alone, and their metadata: PNG (8 bits, not interlaced), PPM and PGM pixels; JPEG and PNG headers and EXIF."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from .jpeg import decode_jpeg

#: The longest edge that features are computed at.
LONGEST = 1600
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


@dataclass
class Metadata:
    """What a file's header says; ``taken`` as EXIF spells it."""

    width: int | None = None
    height: int | None = None
    is_png: bool = False
    has_camera: bool = False
    taken: str | None = None
    lat: float | None = None
    lat_ref: str | None = None
    lon: float | None = None
    lon_ref: str | None = None
    orientation: int = 1


def _ifd(tiff: bytes, at: int, end: str) -> dict[int, object]:
    """A directory's entries: text, integers or rationals as floats."""
    out: dict[int, object] = {}
    (count,) = struct.unpack_from(end + "H", tiff, at)
    for k in range(count):
        tag, kind, n = struct.unpack_from(end + "HHI", tiff, at + 2 + 12 * k)
        size = _SIZES.get(kind, 0) * n
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(end + "I", tiff, at + 10 + 12 * k)[0]
        raw = tiff[place : place + size]
        if len(raw) < size or not size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("latin-1")
        elif kind in (3, 4, 9):
            values = struct.unpack(end + {3: "H", 4: "I", 9: "i"}[kind] * n, raw)
            out[tag] = values[0] if n == 1 else values
        elif kind in (5, 10):
            v = struct.unpack(end + ("I" if kind == 5 else "i") * (2 * n), raw)
            out[tag] = [v[2 * i] / v[2 * i + 1] if v[2 * i + 1] else 0.0 for i in range(n)]
    return out


def _exif(tiff: bytes, m: Metadata) -> None:
    end = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if end is None:
        return
    try:
        main = _ifd(tiff, struct.unpack_from(end + "I", tiff, 4)[0], end)
        exif = _ifd(tiff, main[0x8769], end) if 0x8769 in main else {}
        gps = _ifd(tiff, main[0x8825], end) if 0x8825 in main else {}
    except (struct.error, TypeError):
        return
    m.orientation = main.get(0x0112, 1) or 1
    m.taken = exif.get(0x9003)
    m.has_camera = 0x010F in main or 0xA433 in exif or 0x9003 in exif
    degrees = lambda v: v[0] + v[1] / 60 + v[2] / 3600 if isinstance(v, list) and len(v) == 3 else None
    m.lat, m.lat_ref = degrees(gps.get(2)), gps.get(1)
    m.lon, m.lon_ref = degrees(gps.get(4)), gps.get(3)


def metadata(content: bytes) -> Metadata:
    """Of a JPEG, PNG, PPM or PGM; empty for anything else."""
    m = Metadata()
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        m.is_png = True
        m.width, m.height = struct.unpack_from(">II", content, 16)
        at = 8
        while at + 8 <= len(content):
            size, kind = struct.unpack_from(">I4s", content, at)
            if kind == b"eXIf":
                _exif(content[at + 8 : at + 8 + size], m)
            at += 12 + size
    elif content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF:
            marker, size = content[at + 1], struct.unpack_from(">H", content, at + 2)[0]
            if marker == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                _exif(content[at + 10 : at + 2 + size], m)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                m.height, m.width = struct.unpack_from(">HH", content, at + 5)
                break
            at += 2 + size
    elif content[:2] in (b"P5", b"P6"):
        pixels = decode(content)
        if pixels is not None:
            m.height, m.width = pixels.shape[:2]
    return m


def _png(content: bytes) -> np.ndarray | None:
    width, height, depth, color, _, _, interlaced = struct.unpack_from(">IIBBBBB", content, 16)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if depth != 8 or interlaced or channels is None:
        return None
    at, data, palette = 8, b"", None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == b"IDAT":
            data += body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, channels), 0).ravel()
        elif kind in (3, 4):
            for x in range(len(line)):
                left = line[x - channels] if x >= channels else 0
                if kind == 3:
                    line[x] = (line[x] + (left + above[x]) // 2) & 255
                else:
                    corner = above[x - channels] if x >= channels else 0
                    guess = left + above[x] - corner
                    near = min((abs(guess - left), 0, left), (abs(guess - above[x]), 1, above[x]), (abs(guess - corner), 2, corner))
                    line[x] = (line[x] + near[2]) & 255
        above = line & 255
        out[y] = above
    pixels = out.reshape(height, width, channels)
    if palette is not None and color == 3:
        pixels = palette[np.minimum(pixels[..., 0], len(palette) - 1)]
    return pixels[..., 0] if pixels.shape[2] in (1, 2) else pixels[..., :3]


def _pnm(content: bytes) -> np.ndarray | None:
    parts, at = [], 2
    while len(parts) < 3:
        while at < len(content) and content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.find(b"\n", at)
            if at < 0:
                return None
            continue
        start = at
        while at < len(content) and not content[at : at + 1].isspace():
            at += 1
        parts.append(int(content[start:at]))
    width, height, most = parts
    channels = 1 if content[:2] == b"P5" else 3
    pixels = np.frombuffer(content, np.uint8, offset=at + 1)
    if most > 255 or len(pixels) < width * height * channels:
        return None
    pixels = pixels[: width * height * channels].reshape(height, width, channels)
    return pixels[..., 0] if channels == 1 else pixels


def decode(content: bytes) -> np.ndarray | None:
    """Pixels (rows, columns[, 3]) of a file; null where it can't be decoded."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(content)
        if content[:2] in (b"P5", b"P6"):
            return _pnm(content)
        if content[:2] == b"\xff\xd8":
            return decode_jpeg(content)
    except (ValueError, struct.error, zlib.error, IndexError, KeyError, TypeError, StopIteration):  # whatever a broken file leads to
        return None
    return None


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels turned as EXIF's orientation asks."""
    if orientation in (2, 4, 5, 7):
        pixels = pixels[:, ::-1] if orientation in (2, 5, 7) else pixels[::-1]
    turns = {3: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0)
    return np.rot90(pixels, turns)


def bounded(pixels: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Pixels with the longest edge at most ``longest``, by nearest neighbours."""
    h, w = pixels.shape[:2]
    scale = min(1.0, longest / max(h, w))
    if scale == 1.0:
        return pixels
    rows, columns = np.arange(max(1, round(h * scale))) / scale, np.arange(max(1, round(w * scale))) / scale
    return pixels[np.minimum(rows.astype(int), h - 1)][:, np.minimum(columns.astype(int), w - 1)]


def to_pgm(gray: np.ndarray) -> bytes:
    """A gray image as a PGM file; for tests and samples."""
    return b"P5 %d %d 255\n" % (gray.shape[1], gray.shape[0]) + np.asarray(gray, np.uint8).tobytes()

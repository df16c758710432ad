"""Image files as relations: format, size and resolution from their heads, and the pixels of PNG files."""

from __future__ import annotations

import re
import struct
import zlib

from pyspark.sql import DataFrame

from ..functions import codecs

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # of PNG's colour types


def _chunks(data: bytes):
    at = 8
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4])
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _png(data: bytes):
    width = height = channels = bits = dpi = None
    for kind, body in _chunks(data):
        if kind == b"IHDR" and len(body) >= 13:
            width, height, bits, colour = struct.unpack(">IIBB", body[:10])
            channels = CHANNELS.get(colour)
        elif kind == b"pHYs" and len(body) >= 9 and body[8] == 1:
            dpi = tuple(round(x * 0.0254, 2) for x in struct.unpack(">II", body[:8]))
        elif kind == b"IDAT":
            break
    return ("png", width, height, channels, bits, *(dpi or (None, None))) if width else None


def _jpeg(data: bytes):
    at, dpi = 2, (None, None)
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
            continue
        n = int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + n]
        if kind == 0xE0 and body.startswith(b"JFIF\0") and len(body) >= 12 and body[7] in (1, 2):
            dpi = tuple(round(x * (1.0 if body[7] == 1 else 2.54), 2) for x in struct.unpack(">HH", body[8:12]))
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
            bits, height, width, channels = struct.unpack(">BHHB", body[:6])
            return "jpeg", width, height, channels, bits, *dpi
        at += 2 + n
    return None


def _tiff(data: bytes):
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    tags = {}
    for i in range(n):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        size = {3: 2, 4: 4, 5: 8}.get(kind)
        if size:
            raw = entry[8 : 8 + size] if size * count <= 4 else data[(o := struct.unpack(order + "I", entry[8:12])[0]) : o + size]
            one = struct.unpack(order + {3: "H", 4: "I", 5: "II"}[kind], raw)
            tags[tag] = one[0] if kind != 5 else one[0] / one[1] if one[1] else None
    unit = {2: 1.0, 3: 2.54}.get(tags.get(296, 2))
    dpi = [round(tags[t] * unit, 2) if unit and tags.get(t) else None for t in (282, 283)]
    return ("tiff", tags[256], tags[257], tags.get(277, 1), tags.get(258, 1), *dpi) if 256 in tags and 257 in tags else None


def _jp2(data: bytes):
    if m := re.search(rb"ihdr(.{12})", data[:4096], re.S):
        height, width, channels, bits = struct.unpack(">IIHB", m[1][:11])
        return "jp2", width, height, channels, (bits & 127) + 1, None, None
    return None


def header(data: bytes) -> tuple | None:
    """(format, width, height, channels, bits, x and y dots an inch) of a PNG, JPEG, TIFF or JPEG 2000 file; null for any other or broken one."""
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            return _png(data)
        if data.startswith(b"\xff\xd8"):
            return _jpeg(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
        return _jp2(data) if data[4:8] == b"jP  " else None
    except (struct.error, KeyError):
        return None


def png_pixels(data: bytes) -> bytes | None:
    """Rows of samples of a PNG file of 8 bits that isn't interlaced, palettes spelt out as RGB; null for others."""
    head = header(data)
    if not head or head[0] != "png" or head[4] != 8 or not head[3]:
        return None
    parts, palette, kind, interlaced = [], b"", 0, 0
    for name, body in _chunks(data):
        if name == b"IHDR":
            kind, interlaced = body[9], body[12]
        elif name == b"PLTE":
            palette = body
        elif name == b"IDAT":
            parts.append(body)
    if interlaced:
        return None
    try:
        raw = codecs.png_undo(zlib.decompress(b"".join(parts)), head[1], head[3])
    except (zlib.error, IndexError):
        return None
    return b"".join(palette[3 * c : 3 * c + 3] for c in raw) if kind == 3 else raw


SCHEMA = "path string, format string, width int, height int, channels int, bits int, dpi_x double, dpi_y double"


def headers(files: DataFrame) -> DataFrame:
    """A row of header() for each file (path, content), nulls for what is no image."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(path, *(header(bytes(data)) or (None,) * 7)) for path, data in zip(batch.path, batch.content)]
            yield pd.DataFrame(dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, SCHEMA)

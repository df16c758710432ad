"""Image files built by hand."""

import struct
import zlib

from quire.functions import codecs
from quire.sources import images


def png(width, height, colour, rows, extra=b"", kind=2):
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    body = codecs.png_apply(rows, len(rows) // height, kind)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + extra + chunk(b"pHYs", struct.pack(">IIB", 11811, 5906, 1)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\x01\x00\x48\x00\x60\0\0\xff\xdb\x00\x04\0\0\xff\xc2\x00\x0b\x08\x00\x10\x00\x20\x03\0\0"
TIFF = b"II*\0\x08\0\0\0" + struct.pack("<H", 4) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in ((256, 3, 30), (257, 4, 40), (277, 3, 3), (282, 5, 62))) + b"\0\0\0\0" + struct.pack("<II", 300, 2)
JP2 = b"\0\0\0\x0cjP  \r\n\x87\n" + b"\0\0\0\x16ihdr" + struct.pack(">IIHBB", 5, 6, 3, 7, 7) + b"\0\0"


def test_headers(spark):
    rows = [("png", png(3, 2, 2, bytes(range(18)))), ("jpeg", JPEG), ("tiff", TIFF), ("jp2", JP2), ("text", b"hello"), ("cut", TIFF[:12]), ("none", b"")]
    files = spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "path string, content binary")
    got = {r[0]: tuple(r[1:]) for r in images.headers(files).collect()}
    assert got == {
        "png": ("png", 3, 2, 3, 8, 300.0, 150.01), "jpeg": ("jpeg", 32, 16, 3, 8, 72.0, 96.0), "tiff": ("tiff", 30, 40, 3, 1, 150.0, None), "jp2": ("jp2", 6, 5, 3, 8, None, None),
        "text": (None,) * 7, "cut": (None,) * 7, "none": (None,) * 7,
    }


def test_pixels():
    grey = bytes((7 * i * i) % 256 for i in range(20))
    for kind in (0, 1, 2, 3, 4):
        assert images.png_pixels(png(5, 4, 0, grey, kind=kind)) == grey
    palette = struct.pack(">I", 6) + b"PLTE" + b"abcxyz" + b"\0\0\0\0"
    assert images.png_pixels(png(2, 2, 3, b"\0\1\1\0", palette)) == b"abcxyzxyzabc"
    assert images.png_pixels(JPEG) is None and images.png_pixels(b"") is None


def test_predictors_and_parameters_of_filters():
    chain = lambda raw, name, **own: codecs.decode_chain(raw, [name], [own])
    assert chain(zlib.compress(b"\x01\x02\xff\x05\x01\x01"), "FlateDecode", Predictor=2, Columns=3) == b"\x01\x03\x02\x05\x06\x07"
    assert chain(zlib.compress(bytes((1, 10, 2, 20))), "Fl", Predictor=2, Columns=2, Colors=2) == bytes((1, 10, 3, 30))
    assert chain(zlib.compress(bytes((0, 255, 0, 2))), "Fl", Predictor=2, Columns=2, BitsPerComponent=16) == bytes((0, 255, 1, 1))
    data = bytes(range(256)) * 9
    assert chain(codecs.lzw_encode(data, 0), "LZW", EarlyChange=0) == data and chain(codecs.lzw_encode(data), "LZWDecode") == data

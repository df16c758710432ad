"""Document files from objects: a whole file with its cross-reference table, and a revision put behind a file."""

from __future__ import annotations

import zlib

HEAD = b"%PDF-1.7\n"


def literal(value: str) -> bytes:
    """A string object: Latin-1 in brackets where that holds it, else UTF-16BE in hexadecimal digits behind its mark."""
    try:
        raw = value.encode("latin-1")
    except UnicodeEncodeError:
        return b"<FEFF" + value.encode("utf-16-be").hex().upper().encode() + b">"
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def stream(body: bytes, entries: bytes = b"") -> bytes:
    """A deflated stream object."""
    packed = zlib.compress(body)
    return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(packed), entries, packed)


def _revision(objects: dict[int, bytes], at: int, trailer: bytes, size: int, first: bool, previous: int | None) -> bytes:
    parts, places = [], {}
    for n, body in sorted(objects.items()):
        places[n] = at
        parts.append(b"%d 0 obj\n%s\nendobj\n" % (n, body))
        at += len(parts[-1])
    parts.append(b"xref\n" + (b"0 1\n0000000000 65535 f \n" if first else b""))
    parts += [b"%d 1\n%010d 00000 n \n" % x for x in sorted(places.items())]
    before = b"" if previous is None else b" /Prev %d" % previous
    parts.append(b"trailer\n<< /Size %d %s%s >>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer, before, at))
    return b"".join(parts)


def whole(objects: dict[int, bytes], trailer: bytes) -> bytes:
    """A file of objects (number to body), with the entries of its trailer."""
    return HEAD + _revision(objects, len(HEAD), trailer, max(objects, default=0) + 1, True, None)


def appended(data: bytes, objects: dict[int, bytes], trailer: bytes) -> bytes:
    """data with a revision behind it that has objects anew; what is in data stays as it is."""
    previous = int(data[data.rindex(b"startxref") + 9 :].split()[0])
    return data + _revision(objects, len(data), trailer, max(objects, default=0) + 1, False, previous)

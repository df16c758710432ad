"""Document files as relations: objects and positioned letters, a file at a time.

Byte decoding is sequential by nature, so a task parses one file in Python and all further work is
relational. Files that are broken or encrypted give the objects and pages that can be read, or none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import _parse_datatype_string

from ..functions import codecs
from ..operators.assembly import NUMBERS, PIECE, Letters, Source, source
from .fonts import Font

_WHITE, _DELIM = b"\0\t\n\f\r ", b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_SPACE = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj\b")
_INT, _FLOAT = re.compile(rb"[-+]?\d+"), re.compile(rb"[-+]?(\d+\.\d*|\.\d+)")
_REF = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![A-Za-z])")
_PLAIN = re.compile(rb"[^()\\]*")
_HEX, _OCTAL = re.compile(rb"#([0-9A-Fa-f]{2})"), re.compile(rb"[0-7]{1,3}")
_BODY = re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)")
#: What a file with object streams holds: their name, or an escape that may stand for it.
_PACKS = re.compile(rb"ObjStm|#[0-9A-Fa-f]{2}")
DEPTH = 64
#: Levels of a tree that are walked.
LEVELS = 256
#: Forms within forms that are drawn.
NESTED = 16


class Name(str):
    """A name, apart from strings, which are bytes."""


class Ref(tuple):
    """(number, generation) of an object elsewhere."""


class Word(str):
    """An operator or keyword."""


def tokens(data: bytes, at: int = 0, depth: int = 0):
    """(value, place after it) of the object at a place; a Word for what is none; (None, end) past the end."""
    at = _SPACE.match(data, at).end()
    if at >= len(data):
        return Word(""), at
    c = data[at : at + 1]
    if c == b"/":
        m = _REGULAR.match(data, at + 1)
        raw = m[0] if m else b""
        name = _HEX.sub(lambda x: bytes((int(x[1], 16),)), raw) if b"#" in raw else raw
        return Name(name.decode("latin-1")), at + 1 + len(raw)
    if c == b"(":
        return _literal(data, at + 1)
    if data[at : at + 2] == b"<<":
        out, at = {}, at + 2
        while depth < DEPTH:
            key, at = tokens(data, at, depth + 1)
            if not isinstance(key, Name):
                break
            out[str(key)], at = tokens(data, at, depth + 1)
        return out, at
    if c == b"<":
        end = data.find(b">", at)
        end = len(data) if end < 0 else end
        return codecs.hex_decode(re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])), end + 1
    if c == b"[":
        items, at = [], at + 1
        while depth < DEPTH:
            x, at = tokens(data, at, depth + 1)
            if isinstance(x, Word) and x in ("]", ""):
                break
            items.append(x)
        return items, at
    if c in b")]}{":
        return Word(c.decode()), at + 1
    if data[at : at + 2] == b">>":
        return Word(">>"), at + 2
    m = _REGULAR.match(data, at)
    if not m:
        return Word("?"), at + 1
    raw = m[0]
    if _INT.fullmatch(raw):
        ref = _REF.match(data, m.end())
        if ref and not raw.startswith((b"-", b"+")):
            return Ref((int(raw), int(ref[1]))), ref.end()
        return int(raw), m.end()
    if _FLOAT.fullmatch(raw):
        return float(raw), m.end()
    word = raw.decode("latin-1")
    return {"true": True, "false": False, "null": None}.get(word, Word(word)), m.end()


_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


def _literal(data: bytes, at: int):
    plain = _PLAIN.match(data, at)
    if data[plain.end() : plain.end() + 1] == b")":
        return plain[0], plain.end() + 1
    out, level = bytearray(plain[0]), 1
    at = plain.end()
    while at < len(data):
        c = data[at]
        at += 1
        if c == 92 and at < len(data):
            e = data[at]
            if octal := _OCTAL.match(data, at):
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            else:
                at += 1
                if e in b"\r\n":
                    at += data[at - 1 : at + 1] == b"\r\n"
                else:
                    out.append(_ESCAPES.get(e, e))
            continue
        level += (c == 40) - (c == 41)
        if not level:
            break
        out.append(c)
    return bytes(out), at


class File:
    """Objects of a file by number, found by a scan for their heads; of repeated ones the last counts."""

    def __init__(self, data: bytes):
        self.data, self.found = data, {}
        for m in _OBJECT.finditer(data):
            self.found[int(m[1])] = (m.end(), int(m[2]))
        self.notes: list[tuple[str, str]] = []
        self.packed: dict[int, object] = {}
        self.cache: dict[int, object] = {}
        for n in list(self.found) if _PACKS.search(data) else ():
            x = self.get(n)
            if isinstance(x, dict) and x.get("Type") == "ObjStm":
                self._unpack(x)

    def _unpack(self, stream: dict) -> None:
        body, first = self.body(stream), self.value(stream.get("First")) or 0
        head, at = [], 0
        for _ in range(2 * (self.value(stream.get("N")) or 0)):
            x, at = tokens(body, at)
            if not isinstance(x, int):
                return
            head.append(x)
        for n, offset in zip(head[::2], head[1::2]):
            if n not in self.found:
                self.packed[n] = tokens(body, first + offset)[0]

    def get(self, n: int):
        if n in self.cache:
            return self.cache[n]
        self.cache[n] = None  # a loop of references ends here
        if n in self.found:
            x, at = tokens(self.data, self.found[n][0])
            if isinstance(x, dict) and (m := _BODY.match(self.data, at)):
                x["_at"] = m.end()
            self.cache[n] = x
        else:
            self.cache[n] = self.packed.get(n)
        return self.cache[n]

    def value(self, x, hops: int = 32):
        while isinstance(x, Ref) and hops:
            x, hops = self.get(x[0]), hops - 1
        return None if isinstance(x, Ref) else x

    def body(self, stream: dict) -> bytes:
        at, n = stream["_at"], self.value(stream.get("Length"))
        raw = self.data[at : at + n] if isinstance(n, int) else b""
        if not isinstance(n, int) or not re.match(rb"[\0\t\n\f\r ]*endstream", self.data[at + n : at + n + 20]):
            end = self.data.find(b"endstream", at)
            raw = self.data[at : end if end >= 0 else None].rstrip(b"\r\n")
        filters = self.value(stream.get("Filter")) or []
        parms = self.value(stream.get("DecodeParms")) or []
        filters = [str(self.value(f)) for f in (filters if isinstance(filters, list) else [filters])]
        parms = [self.value(p) or {} for p in (parms if isinstance(parms, list) else [parms])]
        try:
            return codecs.decode_chain(raw, filters, parms)
        except (KeyError, ValueError, IndexError, zlib.error) as e:
            self.note("stream", f"at {stream['_at']}: {type(e).__name__} in {' '.join(filters)}")
            return b""  # an unknown filter, or bytes that it can't read

    def note(self, code: str, detail: str) -> None:
        """What was left out in reading the file."""
        self.notes.append((code, detail))

    def deep(self, depth: int) -> bool:
        """Whether a tree goes deeper than it is walked; that is noted."""
        if depth > LEVELS:
            self.note("depth", f"more than {LEVELS} levels")
        return depth > LEVELS

    def pages(self) -> Iterator[dict]:
        """Leaves of the page tree in order, with what they inherit; of a tree that can't be walked, all pages by number."""
        roots = [x for x in map(self.get, [*self.found, *self.packed]) if isinstance(x, dict) and x.get("Type") == "Catalog"]
        out, seen = [], set()

        def walk(ref, inherited, depth):
            node = self.value(ref)
            if not isinstance(node, dict) or id(node) in seen or self.deep(depth):
                return
            seen.add(id(node))
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox", "Rotate") if k in node}
            kids = self.value(node.get("Kids"))
            if isinstance(kids, list):
                for k in kids:
                    walk(k, own, depth + 1)
            elif node.get("Type") == "Page":
                out.append(node | own)

        for root in roots[-1:]:
            walk(root.get("Pages"), {}, 0)
        if not out:
            out = [x for x in map(self.get, sorted([*self.found, *self.packed])) if isinstance(x, dict) and x.get("Type") == "Page"]
        return iter(out)


def _times(m, n):
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _matrix(x, file: File) -> tuple:
    m = [file.value(v) for v in x] if isinstance(x, list) else []
    return tuple(map(float, m)) if len(m) == 6 and all(isinstance(v, (int, float)) for v in m) else _UNIT


_INLINE_END = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)")


class Content:
    """What a page shows, in the order of its content, with the forms that it calls.

    letters: for each shown string its values, where they stand in text space (x, y), their steps, what turns these into the page's, and its mcid; none without text.
    placements: (object or null if inline, matrix, width and height in pixels).
    """

    def __init__(self, file: File, page: dict, text: bool = True):
        self.file, self.letters, self.placements, self.text = file, [], [], text
        self.fonts: dict[int, Font] = {}
        self.marked: list = []
        self.open: set[int] = set()
        parts = file.value(page.get("Contents"))
        bodies = [file.body(x) for x in map(file.value, parts if isinstance(parts, list) else [parts]) if isinstance(x, dict) and "_at" in x]
        self.run(b"\n".join(bodies), file.value(page.get("Resources")) or {}, _UNIT, 0)

    def font(self, resources: dict, name: str) -> Font | None:
        fonts = self.file.value(resources.get("Font"))
        found = self.file.value(fonts.get(name)) if isinstance(fonts, dict) else None
        if not isinstance(found, dict):
            return None
        if id(found) not in self.fonts:
            self.fonts[id(found)] = Font(self.file, found, tokens)
        return self.fonts[id(found)]

    def call(self, resources: dict, name: str, ctm: tuple, depth: int) -> None:
        objects = self.file.value(resources.get("XObject"))
        ref = objects.get(name) if isinstance(objects, dict) else None
        x = self.file.value(ref)
        if not isinstance(x, dict) or "_at" not in x:
            return
        if x.get("Subtype") == "Image":
            self.placements.append((ref[0] if isinstance(ref, Ref) else None, ctm, self.file.value(x.get("Width")), self.file.value(x.get("Height"))))
        elif x.get("Subtype") == "Form" and depth >= NESTED:
            self.file.note("form", f"{name} is more than {NESTED} forms deep")
        elif x.get("Subtype") == "Form" and id(x) not in self.open:  # a form within itself isn't drawn
            own = self.file.value(x.get("Resources"))
            self.open.add(id(x))
            self.run(self.file.body(x), own if isinstance(own, dict) else resources, _times(_matrix(self.file.value(x.get("Matrix")), self.file), ctm), depth + 1)
            self.open.discard(id(x))

    def run(self, data: bytes, resources: dict, ctm: tuple, depth: int) -> None:
        file, marked, stack, tm, line = self.file, self.marked, [], _UNIT, _UNIT
        state = {"font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 1.0, "TL": 0.0, "Ts": 0.0}

        def show(raw: bytes):
            nonlocal tm
            size, th = state["size"], state["Tz"]
            if not isinstance(raw, bytes) or state["font"] is None:
                return
            shown = state["font"].all(raw)
            if not shown:
                return
            tc, tw = state["Tc"], state["Tw"]
            steps = [(w * size + tc + (tw if space else 0)) * th for _, w, space in shown]
            xs = list(accumulate([v * tm[0] for v in steps], initial=tm[4]))
            level = tm[1] == 0 and abs(xs[-1]) < float("inf")  # then no step moves it up or down
            ys = [tm[5]] * len(xs) if level else list(accumulate([v * tm[1] for v in steps], initial=tm[5]))
            a, b, c, d = _times(_times((size * th, 0, 0, size, 0, state["Ts"]), tm), ctm)[:4]
            whole = _times(tm, ctm)
            scale = (a**2 + b**2) ** 0.5 or 1.0
            fixed = (state["Ts"] * tm[2], state["Ts"] * tm[3], *ctm, (whole[0] ** 2 + whole[1] ** 2) ** 0.5, (c**2 + d**2) ** 0.5, a / scale, b / scale)
            if all(abs(v) < float("inf") for v in (a, b, c, d)):  # false for NaN, too: such letters move the next and aren't shown
                self.letters.append(([v for v, _, _ in shown], xs[:-1], ys[:-1], steps, fixed, next((m for m in reversed(marked) if m is not None), None)))
            tm = (*tm[:4], xs[-1], ys[-1])

        def move(x, y):
            nonlocal tm, line
            tm = line = _times((1, 0, 0, 1, x, y), line)

        at, args = 0, []
        while at < len(data):
            x, at = tokens(data, at)
            if not isinstance(x, Word):
                args.append(x)
                continue
            try:
                if x == "q":
                    stack.append((ctm, dict(state)))
                elif x == "Q" and stack:
                    ctm, state = stack.pop()
                elif x == "cm":
                    ctm = _times(tuple(map(float, args[-6:])), ctm)
                elif x == "BT":
                    tm = line = _UNIT
                elif x == "Tf":
                    state |= {"font": self.font(resources, args[-2]) if self.text else None, "size": float(args[-1])}
                elif x in ("Tc", "Tw", "TL", "Ts"):
                    state[x] = float(args[-1])
                elif x == "Tz":
                    state["Tz"] = float(args[-1]) / 100
                elif x in ("Td", "TD"):
                    if x == "TD":
                        state["TL"] = -float(args[-1])
                    move(float(args[-2]), float(args[-1]))
                elif x == "Tm":
                    tm = line = tuple(map(float, args[-6:]))
                elif x == "T*":
                    move(0, -state["TL"])
                elif x == "Tj":
                    show(args[-1])
                elif x in ("'", '"'):
                    if x == '"':
                        state |= {"Tw": float(args[-3]), "Tc": float(args[-2])}
                    move(0, -state["TL"])
                    show(args[-1])
                elif x == "TJ":
                    for part in args[-1]:
                        if isinstance(part, bytes):
                            show(part)
                        else:
                            tm = _times((1, 0, 0, 1, -float(part) / 1000 * state["size"] * state["Tz"], 0), tm)
                elif x in ("BDC", "BMC"):
                    listed = file.value(resources.get("Properties"))
                    about = args[-1] if x == "BDC" else None
                    if isinstance(about, Name) and isinstance(listed, dict):
                        about = file.value(listed.get(about))
                    marked.append(file.value(about.get("MCID")) if isinstance(about, dict) else None)
                elif x == "EMC" and marked:
                    marked.pop()
                elif x == "Do":
                    self.call(resources, args[-1], ctm, depth)
                elif x == "ID":
                    told = dict(zip(args[::2], args[1::2]))
                    self.placements.append((None, ctm, told.get("W", told.get("Width")), told.get("H", told.get("Height"))))
                    end = _INLINE_END.search(data, at)
                    at = end.end() if end else len(data)
                elif x == "BI":
                    pass
            except (IndexError, TypeError, ValueError, AttributeError):
                file.note("operator", f"{x} with wrong operands")  # it does nothing
            args = []


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files under a path or pattern, on any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: Rows that leave at a time.
ROWS = 8192


def _opened(batch) -> Iterator[tuple]:
    """(place in the batch, File) of each file of a batch."""
    for i, data in enumerate(batch.column("content")):
        yield i, File(data.as_py() or b"")


def per_file(files: DataFrame, schema: str, read) -> DataFrame:
    """The rows that read(File) gives for each file, behind its path. Some thousand rows leave at a time."""
    from pyspark.sql.pandas.types import to_arrow_type

    held = [(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(schema)]

    def batch_of(paths: list, rows: list):
        columns = [paths, *zip(*rows)] if rows else [()] * len(held)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, held)], names=[n for n, _ in held])

    def run(batches):
        paths, rows = [], []
        for batch in batches:
            names = batch.column("path")
            for i, file in _opened(batch):
                before, path = len(rows), names[i].as_py()
                for row in read(file):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield batch_of(paths + [path] * (len(rows) - before), rows)
                        before, paths, rows = 0, [], []
                paths += [path] * (len(rows) - before)
        if rows:
            yield batch_of(paths, rows)

    return files.select("path", "content").mapInArrow(run, schema)


def objects(files: DataFrame) -> DataFrame:
    """(path, obj, gen, kind, type, packed): a row for each object of each file, the last of repeated numbers."""

    def read(f: File):
        for n in [*f.found, *f.packed]:
            x = f.get(n)
            kind = "stream" if isinstance(x, dict) and "_at" in x else "dictionary" if isinstance(x, dict) else "array" if isinstance(x, list) else "other"
            yield n, f.found.get(n, (0, 0))[1], kind, str(x["Type"]) if isinstance(x, dict) and "Type" in x else None, n in f.packed

    return per_file(files, "path string, obj long, gen int, kind string, type string, packed boolean", read)


LETTERS = "path string, page int, letters array<struct<value: string, x: double, y: double, adv: double, size: double, dx: double, dy: double, mcid: int>>"


def _shown(batch):
    """(path, page, Letters) of the pages of some files at a time, and each letter's mcid."""
    paths, numbers, at, runs, many = [], [], [0], [], 0

    def made():
        count = np.array([len(r[0]) for r in runs], np.int64)
        x, y, step = (np.fromiter(chain.from_iterable(r[k] for r in runs), np.float64, many) for k in (1, 2, 3))
        ex, ey, a, b, c, d, e, f, wide, size, dx, dy = (np.repeat(v, count) for v in np.array([r[4] for r in runs], np.float64).reshape(-1, 12).T)
        with np.errstate(all="ignore"):
            x, y = ex + x, ey + y
            x, y, adv = x * a + y * c + e, x * b + y * d + f, step * wide
        sure = np.isfinite(x) & np.isfinite(y) & np.isfinite(adv)  # other letters move the next and aren't shown
        values = pa.array([v for r in runs for v in r[0]], pa.string())
        mcids = pa.array([r[5] if isinstance(r[5], int) else None for r in runs], pa.int32()).take(pa.array(np.repeat(np.arange(len(runs)), count)))
        ends = np.array(at)
        if not sure.all():
            values, mcids, ends = values.filter(pa.array(sure)), mcids.filter(pa.array(sure)), np.append(0, np.cumsum(sure))[ends]
            x, y, adv, size, dx, dy = (v[sure] for v in (x, y, adv, size, dx, dy))
        return pa.array(paths, pa.string()), pa.array(numbers, pa.int32()), Letters(ends, values, x, y, adv, size, dx, dy), mcids

    names = batch.column("path")
    for i, file in _opened(batch):
        path = names[i].as_py()
        for k, page in enumerate(file.pages()):
            found = Content(file, page).letters
            many += sum(len(r[0]) for r in found)
            runs += found
            paths.append(path)
            numbers.append(k)
            at.append(many)
            if many >= PIECE // 4:
                yield made()
                paths, numbers, at, runs, many = [], [], [0], [], 0
    if paths:
        yield made()


def shown(files: DataFrame) -> Source:
    """The source (operators.assembly) of each page of each file; doc_id is its path."""
    nested = lambda keys: letters(files).withColumnRenamed("path", "doc_id") if keys is None else source(letters(files).withColumnRenamed("path", "doc_id")).nested(keys)
    return Source(files.select("path", "content"), ("string", "int"), lambda batch: (x[:3] for x in _shown(batch)), nested)


def letters(files: DataFrame) -> DataFrame:
    """(path, page, letters): a row for each page of each file, ready for words.page_words."""

    def run(batches):
        for batch in batches:
            for path, page, found, mcids in _shown(batch):
                held = [found.values, *map(pa.array, (found.x, found.y, found.adv, found.size, found.dx, found.dy)), mcids]
                yield pa.RecordBatch.from_arrays([path, page, pa.ListArray.from_arrays(pa.array(found.at, pa.int32()), pa.StructArray.from_arrays(held, names=["value", *NUMBERS, "mcid"]))], names=["path", "page", "letters"])

    return files.select("path", "content").mapInArrow(run, LETTERS)


def diagnostics(files: DataFrame) -> DataFrame:
    """(path, page, code, detail): what letters and placements of each file leave out: streams that can't be decoded, operators with wrong operands, too deep forms and trees (page null)."""

    def read(f: File):
        pages = list(f.pages())
        yield from ((None, *x) for x in f.notes)
        for i, p in enumerate(pages):
            f.notes = []
            Content(f, p)
            yield from ((i, *x) for x in f.notes)

    return per_file(files, "path string, page int, code string, detail string", read)


def placements(files: DataFrame) -> DataFrame:
    """(path, page, seq, obj, a, b, c, d, e, f, width, height): every drawing of an image, through forms too; obj is null for an inline one."""

    def read(f: File):
        whole = lambda x: x if isinstance(x, int) and not isinstance(x, bool) else None
        for i, p in enumerate(f.pages()):
            for k, (obj, m, w, h) in enumerate(Content(f, p, False).placements):
                yield i, k, obj, *map(float, m), whole(f.value(w)), whole(f.value(h))

    return per_file(files, "path string, page int, seq int, obj long, a double, b double, c double, d double, e double, f double, width int, height int", read)

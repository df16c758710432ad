"""Parts of document files as relations: trailers and cross-references, information, annotations, fields, outlines, structure, references.

Trees come as (node, parent, pos) rows with their own values, for the operators of graph, forms and structure to walk.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from .pdf import DEPTH, File, Ref, per_file, tokens

_START = re.compile(rb"startxref[\0\t\n\f\r ]+(\d+)")
_SECTION = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]*(?=\d{10}[ ])")
_ENTRY = re.compile(rb"[\0\t\n\f\r ]*(\d{10}) (\d{5}) ([nf])")
_HEAD = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+obj\b")


def text(x) -> str | None:
    """A text string's characters: UTF-16BE or UTF-8 behind their marks, else Latin-1."""
    if isinstance(x, str):
        return str(x)
    if not isinstance(x, bytes):
        return None
    if x.startswith(b"\xfe\xff"):
        return x[2:].decode("utf-16-be", "replace")
    return x[3:].decode("utf-8", "replace") if x.startswith(b"\xef\xbb\xbf") else x.decode("latin-1")


def sections(file: File):
    """(revision, entries, trailer) of each cross-reference section, newest (0) first; entries (obj, gen, kind, offset).

    Follows the chain of earlier sections from the last startxref, each place once. The stream of a hybrid section counts in its revision, and
    comes before the table's entries. A table entry's offset is a place in the file, a packed one's its stream's number.
    """
    starts = _START.findall(file.data)
    at, seen, revision = int(starts[-1]) if starts else None, set(), 0
    while isinstance(at, int) and 0 <= at < len(file.data) and at not in seen:
        seen.add(at)
        entries, trailer = _table(file, at) if file.data[at : at + 4] == b"xref" else _stream(file, at)
        if trailer is None:
            return
        if isinstance(hybrid := trailer.get("XRefStm"), int) and 0 <= hybrid < len(file.data):
            over = _stream(file, hybrid)[0]
            entries = over + [e for e in entries if e[0] not in {o[0] for o in over}]
        yield revision, entries, trailer
        at, revision = file.value(trailer.get("Prev")), revision + 1


def _table(file: File, at: int):
    entries, at = [], at + 4
    while m := _SECTION.match(file.data, at):
        at = m.end()
        for k in range(int(m[2])):
            e = _ENTRY.match(file.data, at)
            if not e:
                break
            entries.append((int(m[1]) + k, int(e[2]), "InUse" if e[3] == b"n" else "Free", int(e[1])))
            at = e.end()
    word, at = tokens(file.data, at)
    trailer = tokens(file.data, at)[0] if word == "trailer" else {}
    return entries, trailer if isinstance(trailer, dict) else {}


def _stream(file: File, at: int):
    head = _HEAD.match(file.data, at)
    x = file.get(int(head[1])) if head else None
    if not isinstance(x, dict) or x.get("Type") != "XRef" or "_at" not in x:
        return [], None
    widths = [w if isinstance(w, int) else 0 for w in map(file.value, file.value(x.get("W")) or [])]
    if len(widths) != 3 or sum(widths) <= 0:
        return [], x
    body, size = file.body(x), sum(widths)
    index = file.value(x.get("Index")) or [0, file.value(x.get("Size")) or 0]
    numbers = [n + k for n, count in zip(index[::2], index[1::2]) for k in range(min(count, len(body) // size))]
    entries = []
    for i, n in enumerate(numbers):
        row = body[i * size : (i + 1) * size]
        if len(row) < size:
            break
        kind = int.from_bytes(row[: widths[0]]) if widths[0] else 1
        second, third = int.from_bytes(row[widths[0] : widths[0] + widths[1]]), int.from_bytes(row[widths[0] + widths[1] :])
        entries.append((n, third if kind != 2 else 0, {0: "Free", 1: "InUse", 2: "Packed"}.get(kind, "Unknown"), second))
    return entries, x


def trailer(file: File) -> dict:
    """Entries of all trailers, the newest one's first; of a file without sections, those after every word trailer, the last first."""
    found = [t for _, _, t in sections(file)]
    if not any("Root" in t for t in found):
        found += [t for m in reversed(list(re.finditer(rb"trailer", file.data))) if isinstance(t := tokens(file.data, m.end())[0], dict)]
        found += [t for n in sorted(file.found, reverse=True) if isinstance(t := file.get(n), dict) and t.get("Type") == "XRef"]
    out: dict = {}
    for t in found:
        out = t | out
    return out


def catalog(file: File) -> dict:
    root = file.value(trailer(file).get("Root"))
    if isinstance(root, dict):
        return root
    all_ = [x for x in map(file.get, sorted([*file.found, *file.packed])) if isinstance(x, dict) and x.get("Type") == "Catalog"]
    return all_[-1] if all_ else {}


def entries(files: DataFrame) -> DataFrame:
    """(path, obj, gen, kind, offset, revision): every entry of every cross-reference section, revision 0 the newest; last_wins by -revision gives the objects."""
    return per_file(files, "path string, obj long, gen int, kind string, offset long, revision int", lambda f: ((*e, r) for r, es, _ in sections(f) for e in es))


INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")


def information(files: DataFrame) -> DataFrame:
    """(path, the eight entries of the information dictionary as text, xmp): a row a file. Dates are as written; strings.document_date reads them."""

    def read(f: File):
        info = f.value(trailer(f).get("Info"))
        info = info if isinstance(info, dict) else {}
        packet = f.value(catalog(f).get("Metadata"))
        xmp = f.body(packet).decode("utf-8", "replace") if isinstance(packet, dict) and "_at" in packet else None
        yield *(text(f.value(info.get(k))) for k in INFO), xmp

    return per_file(files, "path string, " + ", ".join(f"{k.lower()} string" for k in INFO) + ", xmp string", read)


def _box(f: File, x) -> tuple:
    v = [f.value(i) for i in f.value(x) or []] if isinstance(f.value(x), list) else []
    if len(v) != 4 or not all(isinstance(i, (int, float)) for i in v):
        return (None,) * 4
    return float(min(v[0], v[2])), float(min(v[1], v[3])), float(max(v[0], v[2])), float(max(v[1], v[3]))


def _list(f: File, x) -> list:
    x = f.value(x)
    return x if isinstance(x, list) else []


def _number(ref) -> int | None:
    return ref[0] if isinstance(ref, Ref) else None


def _whole(x) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) else None


def annotations(files: DataFrame) -> DataFrame:
    """(path, page, seq, obj, subtype, l, b, r, t, flags, contents): every annotation of every page, in order. Missing flags are 0."""

    def read(f: File):
        for i, p in enumerate(f.pages()):
            for k, ref in enumerate(_list(f, p.get("Annots"))):
                if isinstance(a := f.value(ref), dict):
                    yield i, k, _number(ref), text(f.value(a.get("Subtype"))), *_box(f, a.get("Rect")), _whole(f.value(a.get("F"))) or 0, text(f.value(a.get("Contents")))

    return per_file(files, "path string, page int, seq int, obj long, subtype string, l double, b double, r double, t double, flags int, contents string", read)


def fields(files: DataFrame) -> DataFrame:
    """(path, node, parent, pos, name, ft, ff, value): form fields for forms.full_names, node numbered in the order met. Kids without a name are widgets, not fields."""

    def read(f: File):
        out, seen = [], set()

        def walk(ref, parent, pos, depth):
            x = f.value(ref)
            if not isinstance(x, dict) or id(x) in seen or f.deep(depth):
                return
            seen.add(id(x))
            if parent is not None and "T" not in x:
                return
            node, v = len(out), f.value(x.get("V"))
            v = f.value(v[0]) if isinstance(v, list) and v else v
            out.append((node, parent, pos, text(f.value(x.get("T"))), text(f.value(x.get("FT"))), _whole(f.value(x.get("Ff"))), text(v)))
            for i, k in enumerate(_list(f, x.get("Kids"))):
                walk(k, node, i, depth + 1)

        form = f.value(catalog(f).get("AcroForm"))
        for i, ref in enumerate(_list(f, form.get("Fields")) if isinstance(form, dict) else []):
            walk(ref, None, i, 0)
        return out

    return per_file(files, "path string, node long, parent long, pos int, name string, ft string, ff long, value string", read)


def outline(files: DataFrame) -> DataFrame:
    """(path, node, parent, pos, title): bookmarks, node numbered in the order of the tree; each once."""

    def read(f: File):
        out, seen = [], set()

        def walk(ref, parent, depth):
            pos = 0
            while isinstance(x := f.value(ref), dict) and id(x) not in seen and not f.deep(depth):
                seen.add(id(x))
                node = len(out)
                out.append((node, parent, pos, text(f.value(x.get("Title")))))
                walk(x.get("First"), node, depth + 1)
                ref, pos = x.get("Next"), pos + 1

        top = f.value(catalog(f).get("Outlines"))
        walk(top.get("First") if isinstance(top, dict) else None, None, 0)
        return out

    return per_file(files, "path string, node long, parent long, pos int, title string", read)


def structure(files: DataFrame) -> DataFrame:
    """(path, node, parent, pos, role, page, mcid): the structure tree in its order; marked content is a row with mcid and no role, for structure.ranks."""

    def read(f: File):
        out, seen = [], set()
        places = {id(p): i for i, p in enumerate(map(f.get, _page_numbers(f)))}

        def walk(x, parent, pos, page, depth):
            held = f.value(x)
            if isinstance(held, int) and not isinstance(held, bool):
                out.append((len(out), parent, pos, None, page, held))
            elif isinstance(held, dict) and id(held) not in seen and not f.deep(depth):
                seen.add(id(held))
                page = places.get(id(f.value(held.get("Pg"))), page)
                if _whole(f.value(held.get("MCID"))) is not None:
                    out.append((len(out), parent, pos, None, page, f.value(held["MCID"])))
                    return
                node = len(out)
                out.append((node, parent, pos, text(f.value(held.get("S"))), page, None))
                below(held, node, page, depth)

        def below(held, node, page, depth):
            kids = f.value(held.get("K"))
            for i, k in enumerate(kids if isinstance(kids, list) else [] if kids is None else [kids]):
                walk(k, node, i, page, depth + 1)

        top = f.value(catalog(f).get("StructTreeRoot"))
        if isinstance(top, dict):
            below(top, None, None, 0)
        return out

    return per_file(files, "path string, node long, parent long, pos int, role string, page int, mcid int", read)


def _page_numbers(f: File) -> list[int]:
    """Object numbers of the pages, in the order of the page tree."""
    out, seen = [], set()

    def walk(ref, depth):
        x = f.value(ref)
        if not isinstance(x, dict) or id(x) in seen or not isinstance(ref, Ref) or f.deep(depth):
            return
        seen.add(id(x))
        if "Kids" in x:
            for k in _list(f, x["Kids"]):
                walk(k, depth + 1)
        else:
            out.append(ref[0])

    walk(catalog(f).get("Pages"), 0)
    return out


def references(files: DataFrame) -> DataFrame:
    """(path, src, dst): every reference from an object to another, once; src 0 is the trailer. graph.reachable walks them."""

    def read(f: File):
        def below(x, depth=0):
            if isinstance(x, Ref):
                yield x[0]
            elif isinstance(x, (dict, list)) and depth <= DEPTH:
                for v in x.values() if isinstance(x, dict) else x:
                    yield from below(v, depth + 1)

        for n in [0, *f.found, *f.packed]:
            for dst in sorted(set(below(trailer(f) if n == 0 else f.get(n)))):
                yield n, dst

    return per_file(files, "path string, src long, dst long", read)


def signatures(files: DataFrame) -> DataFrame:
    """(path, obj, kind, filter, ranges, length): signature and timestamp dictionaries with the bytes they cover; coverage.verdict judges them."""

    def read(f: File):
        for n in sorted([*f.found, *f.packed]):
            x = f.get(n)
            if isinstance(x, dict) and (x.get("Type") in ("Sig", "DocTimeStamp") or ("ByteRange" in x and "Contents" in x)):
                ranges = [_whole(f.value(v)) for v in _list(f, x.get("ByteRange"))]
                yield n, text(x.get("Type")), text(f.value(x.get("SubFilter"))), ranges or None, len(f.data)

    return per_file(files, "path string, obj long, kind string, filter string, ranges array<long>, length long", read)




#: The namespace of the identification schema, its properties, and what an output intent's profile may be.
IDENTIFICATION, PROPERTIES = "http://www.aiim.org/pdfa/ns/id/", ("part", "conformance", "amd")
PROFILE_CLASS, PROFILE_SPACES = b"mntr", (b"RGB ", b"GRAY", b"CMYK")
_VERSION = re.compile(rb"%PDF-(\d+)\.(\d+)")


def _declared(packet: str | None) -> tuple[str | None, str | None, str | None]:
    """(part, conformance, another property) that an XMP packet declares in the identification schema under its usual prefix."""
    if not packet or not re.search(rf"xmlns:pdfaid\s*=\s*[\"']{re.escape(IDENTIFICATION)}[\"']", packet):
        return None, None, None
    start = packet.find("<x:xmpmeta")
    try:
        root = ElementTree.fromstring(packet[max(0, start) if start >= 0 else max(0, packet.find("<rdf:RDF")) :].split("<?xpacket end")[0])
    except ElementTree.ParseError:
        return None, None, None
    said: dict[str, str] = {}
    for node in root.iter():
        for name, value in [*node.attrib.items(), (node.tag, (node.text or "").strip())]:
            if name.startswith(f"{{{IDENTIFICATION}}}"):
                said.setdefault(name.partition("}")[2], value)
    return said.get("part"), said.get("conformance"), next((k for k in said if k not in PROPERTIES), None)


def _intent(f: File) -> str:
    """What is wrong with a file's output intent, or "ok"."""
    for x in map(f.value, _list(f, catalog(f).get("OutputIntents"))):
        if isinstance(x, dict) and x.get("S") == "GTS_PDFA1":
            named, profile = f.value(x.get("OutputConditionIdentifier")), f.value(x.get("DestOutputProfile"))
            if not isinstance(named, bytes) or not named:
                return "no condition"
            if not isinstance(profile, dict) or "_at" not in profile:
                return "no profile"
            head = f.body(profile)[:128]
            return "short profile" if len(head) < 128 else "profile class" if head[12:16] != PROFILE_CLASS else "profile space" if head[16:20] not in PROFILE_SPACES else "ok"
    return "none"


def _held(x):
    """References within an object."""
    todo = [x]
    while todo:
        x = todo.pop()
        if isinstance(x, Ref):
            yield x
        elif isinstance(x, dict):
            todo += [v for k, v in x.items() if k != "_at"]
        elif isinstance(x, list):
            todo += x


def conformance(files: DataFrame) -> DataFrame:
    """(path, part, conformance, other, encrypted, version, appearances, intent, lzw): what rules.document_rules judges, a row a file.

    part, conformance and other (an undefined property) are as the XMP packet declares them. intent is ok, or what is wrong with the output
    intent. lzw: whether a stream that the catalog reaches is compressed so. version is the header's, null without one.
    """

    def read(f: File):
        root, packet = catalog(f), None
        held = f.value(root.get("Metadata"))
        if isinstance(held, dict) and "_at" in held:
            packet = f.body(held).decode("utf-8", "replace")
        form = f.value(root.get("AcroForm"))
        seen, todo, lzw = set(), [root], False
        while todo and not lzw:
            x = todo.pop()
            if isinstance(x, dict) and "_at" in x:
                names = f.value(x.get("Filter"))
                lzw = "LZWDecode" in map(str, names if isinstance(names, list) else [names])
            for ref in _held(x):
                if ref[0] not in seen:
                    seen.add(ref[0])
                    todo.append(f.value(ref))
        version = _VERSION.search(f.data[:1024])
        yield *_declared(packet), "Encrypt" in trailer(f), float(f"{int(version[1])}.{int(version[2])}") if version else None, isinstance(form, dict) and form.get("NeedAppearances") is True, _intent(f), lzw

    return per_file(files, "path string, part string, conformance string, other string, encrypted boolean, version double, appearances boolean, intent string, lzw boolean", read)

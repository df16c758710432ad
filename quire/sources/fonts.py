"""Codes of shown strings as text and widths: encodings, differences, character maps, composite fonts."""

from __future__ import annotations

import re
import unicodedata

# Names of glyphs that no rule below spells, and what they stand for.
GLYPHS = dict(
    zip(
        (
            "space exclam quotedbl numbersign dollar percent ampersand quotesingle quoteright quoteleft parenleft parenright asterisk plus comma hyphen period slash "
            "zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave "
            "braceleft bar braceright asciitilde exclamdown cent sterling fraction yen florin section currency quotedblleft guillemotleft guilsinglleft guilsinglright "
            "endash dagger daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand questiondown "
            "acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron emdash AE ordfeminine Lslash Oslash OE ordmasculine "
            "ae dotlessi lslash oslash oe germandbls Euro trademark copyright registered degree plusminus multiply divide minus mu Eth eth Thorn thorn logicalnot "
            "brokenbar onehalf onequarter threequarters onesuperior twosuperior threesuperior nbspace softhyphen fi fl ff ffi ffl"
        ).split(),
        [
            *" !\"#$%&'’‘()*+,-./0123456789:;<=>?@[\\]^_`{|}~¡¢£⁄¥ƒ§¤“«‹›–†‡·¶•‚„”»…‰¿´ˆ˜¯˘˙¨˚¸˝˛ˇ—ÆªŁØŒºæıłøœß€™©®°±×÷−µÐðÞþ¬¦½¼¾¹²³ ­",
            "fi", "fl", "ff", "ffi", "ffl",
        ],
    )
)
# Combining marks of accented letters' names.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}
# The standard encoding where it isn't ASCII, from code 161 on, with a full stop for no glyph.
STANDARD = {0x27: "’", 0x60: "‘"} | {161 + i: c for i, c in enumerate("¡¢£⁄¥ƒ§¤'“«‹›  .–†‡·.¶•‚„”»…‰.¿.`´ˆ˜¯˘˙¨.˚¸.˝˛ˇ—................Æ.ª....ŁØŒº.....æ...ı..łøœß") if c not in ". "} | {174: "fi", 175: "fl"}
CODECS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}


def glyph_text(name: str) -> str | None:
    """What a glyph's name stands for; null if it can't be told. What follows a full stop is a variant's."""
    name = name.split(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1 and name.isalpha():
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else None
    if len(name) > 1 and name[0].isalpha() and name[1:] in ACCENTS:
        return unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
    return None


def base_text(encoding: str | None, code: int) -> str | None:
    if encoding in CODECS:
        text = bytes((code,)).decode(CODECS[encoding], "ignore")
        return text or ("•" if encoding == "WinAnsiEncoding" and code > 32 else None)
    return STANDARD.get(code, chr(code) if 32 <= code < 127 else None)


class CharacterMap:
    """Code spaces, and codes to text (bf) or to character ids (cid), of a map's source. Single codes come before ranges."""

    def __init__(self, data: bytes, read, used=None):
        self.spaces: list[tuple[bytes, bytes]] = list(used.spaces) if used else []
        self.single: dict[tuple[int, int], object] = dict(used.single) if used else {}
        self.ranges: list[tuple[int, int, int, object]] = list(used.ranges) if used else []  # width, low, high, first value
        args, at = [], 0
        while at < len(data):
            x, at = read(data, at)
            if not type(x).__name__ == "Word":
                args.append(x)
                continue
            if x in ("endbfchar", "endcidchar"):
                for code, to in zip(args[::2], args[1::2]):
                    if isinstance(code, bytes):
                        self.single[len(code), int.from_bytes(code)] = self._value(to)
            elif x in ("endbfrange", "endcidrange"):
                for low, high, to in zip(args[::3], args[1::3], args[2::3]):
                    if isinstance(low, bytes) and isinstance(high, bytes):
                        self.ranges.append((len(low), int.from_bytes(low), int.from_bytes(high), to if isinstance(to, list) else self._value(to)))
            elif x == "endcodespacerange":
                self.spaces += [(a, b) for a, b in zip(args[::2], args[1::2]) if isinstance(a, bytes) and isinstance(b, bytes) and len(a) == len(b)]
            args = []

    @staticmethod
    def _value(to):
        return to.decode("utf-16-be", "replace") if isinstance(to, bytes) else to

    def get(self, width: int, code: int):
        if (width, code) in self.single:
            return self.single[width, code]
        for w, low, high, to in self.ranges:
            if w == width and low <= code <= high:
                if isinstance(to, list):
                    return self._value(to[code - low]) if code - low < len(to) else None
                if isinstance(to, str):
                    return to[:-1] + chr(min(ord(to[-1]) + code - low, 0x10FFFF)) if to else to
                return to + code - low if isinstance(to, int) else None
        return None

    def cut(self, raw: bytes, at: int) -> int:
        """The length of the code at a place: the first code space that holds it, else the shortest one's."""
        for low, high in sorted(self.spaces, key=lambda s: len(s[0])):
            part = raw[at : at + len(low)]
            if len(part) == len(low) and all(a <= c <= b for a, c, b in zip(low, part, high)):
                return len(low)
        return min([len(s[0]) for s in self.spaces], default=1)


class Font:
    """decode(raw) gives (text, width in em, whether it is the one-byte code 32) for each code of a shown string."""

    def __init__(self, file, font: dict, read):
        v = self.value = file.value
        self.composite = v(font.get("Subtype")) == "Type0"
        stream = v(font.get("ToUnicode"))
        self.unicode = CharacterMap(file.body(stream), read) if isinstance(stream, dict) and "_at" in stream else None
        self.widths: dict[int, float] = {}
        self.codes: CharacterMap | None = None
        if self.composite:
            self._composite(file, font, read)
        else:
            self._simple(font)
        self.seen: dict[bytes, tuple[str, float, bool]] = {}
        self.single: dict[int, tuple[str, float, bool]] = {}

    def _number(self, x, missing: float = 0.0) -> float:
        x = self.value(x)
        return float(x) if isinstance(x, (int, float)) else missing

    def _simple(self, font: dict) -> None:
        v = self.value
        encoding, self.differences = v(font.get("Encoding")), {}
        self.base = encoding if isinstance(encoding, str) else None
        if isinstance(encoding, dict):
            self.base, at = v(encoding.get("BaseEncoding")), 0
            for x in v(encoding.get("Differences")) or []:
                x = v(x)
                if isinstance(x, int):
                    at = x
                elif isinstance(x, str):
                    self.differences[at] = str(x)
                    at += 1
        elif self.base is None and v(font.get("Subtype")) == "TrueType":
            self.base = "WinAnsiEncoding"
        first, described = v(font.get("FirstChar")), v(font.get("FontDescriptor")) or {}
        for i, w in enumerate(v(font.get("Widths")) or []):
            self.widths[(first if isinstance(first, int) else 0) + i] = self._number(w)
        fixed = 600.0 if "Courier" in str(v(font.get("BaseFont"))) else 500.0
        self.missing = self._number(described.get("MissingWidth"), fixed) if isinstance(described, dict) else fixed
        matrix = v(font.get("FontMatrix"))
        self.em = 1 / self._number(matrix[0], 0.001) if v(font.get("Subtype")) == "Type3" and isinstance(matrix, list) and matrix and self._number(matrix[0]) else 1000.0

    def _composite(self, file, font: dict, read) -> None:
        v = self.value
        below = v((v(font.get("DescendantFonts")) or [None])[0]) or {}
        encoding = v(font.get("Encoding"))
        if isinstance(encoding, dict) and "_at" in encoding:
            used = v(encoding.get("UseCMap"))
            inner = CharacterMap(file.body(used), read) if isinstance(used, dict) and "_at" in used else None
            self.codes = CharacterMap(file.body(encoding), read, inner)
        self.em, self.missing = 1000.0, self._number(below.get("DW"), 1000.0)
        row, i = v(below.get("W")) or [], 0
        while i + 1 < len(row):
            low, then = v(row[i]), v(row[i + 1])
            if isinstance(then, list):
                self.widths |= {low + k: self._number(w) for k, w in enumerate(then)}
                i += 2
            else:
                wide = self._number(row[i + 2]) if i + 2 < len(row) else 0.0
                self.widths |= dict.fromkeys(range(low, min(then, low + 65535) + 1), wide)
                i += 3

    def all(self, raw: bytes) -> list[tuple[str, float, bool]]:
        """What decode gives, by a table for codes of a byte."""
        if self.composite:
            return list(self.decode(raw))
        for c in set(raw).difference(self.single):
            self.single[c] = self._one(bytes((c,)))
        return [self.single[c] for c in raw]

    def decode(self, raw: bytes):
        at = 0
        while at < len(raw):
            n = 1 if not self.composite else self.codes.cut(raw, at) if self.codes and self.codes.spaces else 2
            code = raw[at : at + n]
            at += n
            if code not in self.seen:
                self.seen[code] = self._one(code)
            yield self.seen[code]

    def _one(self, code: bytes) -> tuple[str, float, bool]:
        n = int.from_bytes(code)
        text = self.unicode.get(len(code), n) if self.unicode else None
        if not self.composite:
            if text is None:
                text = glyph_text(self.differences[n]) if n in self.differences else base_text(self.base, n)
            text = text if text is not None else " " if n == 32 else "�"
            return text, self.widths.get(n, self.missing) / self.em, n == 32
        cid = self.codes.get(len(code), n) if self.codes else n
        return text if isinstance(text, str) else "�", self.widths.get(cid if isinstance(cid, int) else 0, self.missing) / self.em, code == b" "

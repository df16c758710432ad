"""Dates, names, permissions and runs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Permission bits that mean something, and those of annotations.
PERMISSIONS = 0xF3C
HIDDEN, PRINT, NO_VIEW = 1 << 1, 1 << 2, 1 << 5


def document_date(text: Column) -> Column:
    """A date as documents write it (D:YYYYMMDDHHmmSS+HH'mm') as a timestamp in UTC; later fields may be missing, and are clamped.

    Null if there is no year of four digits.
    """
    plain = F.regexp_replace(F.trim(text), "^D:", "")

    def part(first: int, low: int, high: int, missing: int):
        digits = F.substring(plain, first, 2)
        value = F.when(digits.rlike("^[0-9]{2}$"), digits).cast("int")
        run = F.length(F.regexp_extract(plain, "^[0-9]*", 0)) >= first + 1
        return F.least(F.greatest(F.coalesce(F.when(run, value), F.lit(missing)), F.lit(low)), F.lit(high))

    year = F.when(plain.rlike("^[0-9]{4}"), F.substring(plain, 1, 4)).cast("int")
    year = F.when(year < 1, 1).otherwise(year)
    month = part(5, 1, 12, 1)
    first = F.make_date(year, month, F.lit(1))
    day = F.least(part(7, 1, 31, 1), F.dayofmonth(F.last_day(first)))
    local = F.make_timestamp(year, month, day, part(9, 0, 23, 0), part(11, 0, 59, 0), part(13, 0, 59, 0).cast("decimal(8,6)"))
    sign = F.regexp_extract(plain, "^[0-9]+([+-])", 1)
    minutes = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(plain, "^[0-9]+[+-]([0-9]{2})", 1), F.lit("")), F.lit("99")).cast("int"), F.lit(0)) * 60
    minutes = minutes + F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(plain, "^[0-9]+[+-][0-9]{2}'?([0-9]{2})", 1), F.lit("")), F.lit("99")).cast("int"), F.lit(0))
    shift = F.when(sign == "+", -minutes).when(sign == "-", minutes).otherwise(0)
    return local + F.make_dt_interval(mins=shift)


def last_segment(name: Column) -> Column:
    """What follows the last full stop of a field's name, without an index in brackets at its end."""
    return F.regexp_replace(F.substring_index(name, ".", -1), r"\[[0-9]+\]$", "")


def permissions(raw: Column) -> Column:
    """The permission bits that are set; all of them where nothing is stated."""
    return F.coalesce(raw.bitwiseAND(F.lit(PERMISSIONS)), F.lit(PERMISSIONS))


def annotation_visible(flags: Column, printing: bool) -> Column:
    def has(bit):
        return flags.bitwiseAND(F.lit(bit)) != 0

    return ~has(HIDDEN) & (has(PRINT) if printing else ~has(NO_VIEW))


def field_kind(kind: Column, flags: Column) -> Column:
    """Text, Signature, PushButton, RadioButton, CheckBox, ComboBox, ListBox or Unknown, by /FT and bits 16 to 18 of /Ff."""

    def bit(n):
        return F.call_function("shiftright", flags, F.lit(n - 1)).bitwiseAND(F.lit(1)) == 1

    button = F.when(bit(17), "PushButton").when(bit(16), "RadioButton").otherwise("CheckBox")
    choice = F.when(bit(18), "ComboBox").otherwise("ListBox")
    return F.when(kind == "Tx", "Text").when(kind == "Sig", "Signature").when(kind == "Btn", button).when(kind == "Ch", choice).otherwise("Unknown")


#: Filters that only spell bytes as text, and the family of each other.
ASCII_FILTERS = ("ASCIIHexDecode", "AHx", "ASCII85Decode", "A85")
FAMILIES = {
    "FlateDecode": "Flate", "Fl": "Flate", "LZWDecode": "Lzw", "LZW": "Lzw", "RunLengthDecode": "RunLength", "RL": "RunLength", "DCTDecode": "Jpeg", "DCT": "Jpeg",
    "JPXDecode": "Jpeg2000", "CCITTFaxDecode": "Fax", "CCF": "Fax", "JBIG2Decode": "Jbig2",
}


def encoding_family(filters: Column) -> Column:
    """The family of the last filter that isn't ASCII: Raw if there is none, Other if it is unknown."""
    last = F.get(F.reverse(F.filter(filters, lambda f: ~f.isin(*ASCII_FILTERS))), F.lit(0))
    named = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.when(last.isNull(), "Raw").otherwise(F.coalesce(F.try_element_at(named, last), F.lit("Other")))


def text_string(raw: Column) -> Column:
    """Bytes of a text string: UTF-16BE or UTF-8 behind their byte order marks, else Latin-1."""
    mark = F.hex(F.substring(raw, 1, 3))
    wide = F.decode(F.substring(raw, 3, 2**31 - 1), "UTF-16BE")
    return F.when(mark.startswith("FEFF"), wide).when(mark == "EFBBBF", F.decode(F.substring(raw, 4, 2**31 - 1), "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))


def dictionary_digest(keys: list[str]) -> Column:
    """SHA-256 of a dictionary's entries in order of their keys; null if a value is."""
    return F.sha2(F.concat(*[x for i, k in enumerate(sorted(keys)) for x in (F.lit(f"{';' if i else ''}{k}="), F.col(k))]).cast("binary"), 256)


#: Code points by script: Latin, Greek, Cyrillic, Hebrew to Arabic, Kana and Han; all else is common.
SCRIPTS = (r"A-Za-z\x{00C0}-\x{024F}", r"\x{0370}-\x{03FF}", r"\x{0400}-\x{04FF}", r"\x{0590}-\x{08FF}", r"\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}")


def script_runs(text: Column) -> Column:
    """The maximal runs of one script, in order."""
    pattern = "|".join(f"[{s}]+" for s in SCRIPTS) + f"|[^{''.join(SCRIPTS)}]+"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))

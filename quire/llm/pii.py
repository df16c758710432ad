"""Operator 4: personal data by fixed patterns and a character-level BiLSTM-CRF over overlapping windows."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bilstm import BETWEEN, Tagger, best_path, emissions, gains, open_places
from .common import table

#: Kinds in the order in which equal starts are listed; tag i + 1 of the tagger.
KINDS = ("email", "ip", "card", "phone")

# --- fixed patterns -----------------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The same matches in linear time. A match of IP begins where a run of digits does: a match ends with a run, and one
# from within a run is one from its start too. Runs never have to be given back, so they are possessive.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Matches of EMAIL, found from each @: the pattern's first part is the longest run of its characters before it."""
    done, low, at = 0, 0, text.find("@")
    while at >= 0:
        low = max(low, done)
        start = low + len(text[low:at].rstrip(LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        low = at + 1
        at = text.find("@", max(low, done))


def _octet(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 3 or len(x) == 3 and int(x) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by the fixed patterns, in order, in time linear in the text."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- symbols ------------------------------------------------------------------------------------

_OTHER = "\n !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: 0 other, 1 digit, 2 other letter, 3 to 28 a to z, then each of _OTHER.
SYMBOLS = 29 + len(_OTHER)
_TABLE = np.zeros(0x250, np.uint8)
for _i in range(0x250):
    _c = chr(_i)
    _TABLE[_i] = (
        1 if "0" <= _c <= "9" else 3 + ord(_c.lower()) - 97 if "a" <= _c.lower() <= "z" and _i < 128 else 29 + _OTHER.index(_c) if _c in _OTHER
        else 30 if _c.isspace() else 2 if _c.isalpha() else 0
    )
_TABLE[0x24F] = 2  # all beyond stand as a letter


def symbols(text: str) -> np.ndarray:
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 0x24F)]


# --- labelled spans -----------------------------------------------------------------------------

_SYLLABLES = "the and er on an re he in ed nd ha en ou it is de la que ción os ar mente pas le eau eux oi ch sch ung keit lich ä ü é ñ".split()


class _Draws:
    """Draws of a generator, taken from it in blocks."""

    def __init__(self, rng, block: int = 256):
        self._rng, self._block, self._left = rng, block, []

    def random(self) -> float:
        if not self._left:
            self._left = self._rng.random(self._block).tolist()
        return self._left.pop()

    def integers(self, low: int, high: int, n: int | None = None):
        return low + int((high - low) * self.random()) if n is None else [low + int((high - low) * self.random()) for _ in range(n)]

    def choice(self, some):
        return some[self.integers(0, len(some))]

    def bytes(self, n: int) -> bytes:
        return bytes(self.integers(0, 256, n))


def _word(rng) -> str:
    w = "".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), rng.integers(1, 5)))
    return w.capitalize() if rng.random() < 0.12 else w.upper() if rng.random() < 0.05 else w


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng) -> str:
    d = _number(rng, int(rng.integers(13, 19)) if rng.random() < 0.3 else 15)
    return d + next(x for x in "0123456789" if luhn(d + x))


def _personal(rng, kind: int) -> str:
    """A personal datum, in a form of the fixed patterns or one that they don't have."""
    style = rng.random()
    if kind == 0:
        user = rng.choice([_word(rng).lower(), f"{_word(rng)}.{_number(rng, 2)}".lower(), f"{_word(rng)}_{_word(rng)}".lower()])
        host = f"{rng.choice(['mail', 'post', 'web', ''])}{_number(rng, 1)}.{rng.choice(['example', 'site', _word(rng).lower()])}.{rng.choice(['com', 'org', 'net', 'de'])}"
        user, host = user.encode("ascii", "ignore").decode() or "ab", host.encode("ascii", "ignore").decode()
        if style < 0.6:
            return f"{user}@{host}"
        at, dot = [(" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" @ ", ".")][rng.integers(0, 6)]
        return f"{user}{at}{host.replace('.', dot)}"
    if kind == 1:
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return (".", ".", ".", "[.]", " . ")[rng.integers(0, 5)].join(parts)
    if kind == 2:
        d = _card(rng)
        if style < 0.5:
            return d
        sep = " -./ "[rng.integers(0, 5)]
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    if style < 0.5:
        return f"+{rng.integers(1, 99)} ({a}) {b}-{c}"
    return (f"+{rng.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{rng.integers(1, 99)} {a} {b}{c}", f"{a}.{b}.{c}")[rng.integers(0, 5)]


def _plain(rng) -> str:
    """What is no personal datum though it has digits or signs."""
    x = rng.random()
    if x < 0.8:
        return _word(rng) + ("", "", "", "", ",", ".", "!!", "###", "***", "%%%", "$$$", "&&&")[rng.integers(0, 12)]
    return (
        _number(rng, 4), f"{rng.integers(1, 20)}.{rng.integers(0, 10)}", f"{rng.integers(1, 999)}.{_number(rng, 2)}", f'token = "{rng.bytes(20).hex()}"', "|", "#",
        f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}", f"{rng.integers(1, 28)}/{rng.integers(1, 12)}/{rng.integers(1900, 2100)}", f"@{_word(rng)}", f"{rng.integers(1, 99)}%",
        _number(rng, int(rng.integers(5, 9))), "at", "dot", f"http://{_word(rng).lower()}.example/{rng.integers(1, 99)}", "CC BY-NC 4.0.",
    )[rng.integers(0, 15)]


def labelled(rng, length: int) -> tuple[str, np.ndarray]:
    """A text of length characters and its tags, cut anywhere; rng is a numpy generator."""
    rng, parts, tags, size = _Draws(rng), [], [], 0
    while size < length + 40:
        kind = int(rng.integers(0, 4)) if rng.random() < 0.08 else -1
        s = _personal(rng, kind) if kind >= 0 else _plain(rng)
        gap = "\n" if rng.random() < 0.08 else " "
        parts += [s, gap]
        tags += [kind + 1] * len(s) + [0]
        size += len(s) + 1
    cut = int(rng.integers(0, 40))
    return "".join(parts)[cut : cut + length], np.array(tags[cut : cut + length])


@cache
def tagger(steps: int = 260, batch: int = 96, length: int = 64, hidden: int = 8, seed: int = 7) -> Tagger:
    """The tagger, trained on the driver from labelled spans that a seeded generator writes; the same in every run."""
    rng = np.random.default_rng(seed)
    model = Tagger(SYMBOLS, 1 + len(KINDS), hidden, seed)

    def batches(n):
        for _ in range(n):
            rows = [labelled(rng, length) for _ in range(batch)]
            yield np.stack([symbols(t) for t, _ in rows], axis=1), np.stack([y for _, y in rows], axis=1)

    model.fit(batches(steps * 3 // 4), 0.03)
    model.fit(batches(steps - steps * 3 // 4), 0.008)
    return model


# --- windows ------------------------------------------------------------------------------------

#: Symbols of a window, of which the outer ones (but at a text's ends) are context alone; windows at once.
LENGTH, MARGIN, AT_ONCE = 512, 32, 1024
#: Characters that are tagged together.
CHARACTERS = 2_000_000


def tag(weights: dict, texts: list[str]) -> list[np.ndarray | None]:
    """The tags of each text, None where all are 0: those of the best path through the whole text.

    Each text has its own windows, which overlap by two margins; a place takes its emissions from the window in
    whose middle it lies, and the emissions of all windows of a text are decoded as one sequence. Windows go together by
    length. Four bytes a place are kept until all windows are done; they tell where a tag other than 0 can win at
    all. Emissions are kept too if the texts are short together, else windows around such places are run again.
    """
    step = LENGTH - 2 * MARGIN
    codes = [symbols(t) for t in texts]
    base = np.cumsum([0, *[len(c) + 1 for c in codes]])  # texts lie side by side, with a place between them
    spots = []
    for i, c in enumerate(codes):
        n = len(c)
        for a in range(0, max(1, n - 2 * MARGIN), step) if n else ():
            spots.append((min(n, a + LENGTH) - a, i, a))
    spots.sort()
    size, of, at = (np.array(v, np.int64) for v in zip(*spots)) if spots else [np.zeros(0, np.int64)] * 3
    low = np.where(at > 0, MARGIN, 0)  # the window's middle
    high = np.where(base[of + 1] - base[of] - 1 > at + size, size - MARGIN, size)

    def windows(some):
        for s in range(0, len(some), AT_ONCE):
            js = some[s : s + AT_ONCE]
            x = np.full((size[js[-1]], len(js)), SYMBOLS, np.uint8)
            for c, j in enumerate(js.tolist()):
                x[: size[j], c] = codes[of[j]][at[j] : at[j] + size[j]]
            yield js, emissions(weights, x)

    gain, kept = np.full(base[-1], BETWEEN, np.float32), []
    for js, e in windows(np.arange(len(spots))):
        if len(gain) <= 2 * CHARACTERS:
            kept.append((js, e))
        led = np.ascontiguousarray(gains(e).T)
        for c, j in enumerate(js.tolist()):
            gain[base[of[j]] + at[j] + low[j] : base[of[j]] + at[j] + high[j]] = led[c, low[j] : high[j]]
    full = np.flatnonzero(np.diff(base) > 1)
    places = open_places(weights, gain, base[full], base[full + 1] - 2)
    first, last = (np.searchsorted(places, base[of] + at + edge) for edge in (low, high))
    scores = np.empty((len(places), weights["k"]), np.float32)
    for js, e in kept or windows(np.flatnonzero(last > first)):
        for c, j in enumerate(js.tolist()):
            mine = slice(first[j], last[j])
            scores[mine] = e[places[mine] - base[of[j]] - at[j], :, c]
    tags = best_path(weights, places, scores, np.isin(places, base[:-1]), np.isin(places, base[1:] - 2))
    out: list[np.ndarray | None] = [None] * len(texts)
    found = np.flatnonzero(tags)
    text = np.searchsorted(base, places[found], side="right") - 1
    for i in np.unique(text).tolist():
        mine = found[np.searchsorted(text, i) : np.searchsorted(text, i, side="right")]
        out[i] = np.zeros(len(codes[i]), np.int8)
        out[i][places[mine] - base[i]] = tags[mine]
    return out


_AT, _DOT = re.compile(r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+|\s*@\s*", re.I), re.compile(r"\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+", re.I)


#: Characters of the longest run that can be one datum of a kind, separators included.
LONGEST = (320, 40, 60, 40)


def _plausible(kind: int, s: str) -> bool:
    """Whether a tagged run, once its separators are normal, passes the check of its kind."""
    if len(s) > LONGEST[kind]:
        return False
    if kind == 0:
        return bool(EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", s))))
    if kind == 1:
        parts = re.split(r"\s*\[?\.\]?\s*", s)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", x) and int(x) <= 255 for x in parts)
    d = _digits(s)
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9 ./ -]|[ ./ -]{2}", s)
    return 10 <= len(d) <= 15 and not d == s and not re.search(r"[^0-9 +().-]", s)


def _digit_runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each place the start of the run of digits that ends before it, and the end of the run that starts at it (the place itself for none)."""
    digit = symbols(text) == 1
    place = np.arange(len(digit) + 1)
    before = np.maximum.accumulate(np.where(np.append(False, digit), 0, place))
    after = np.minimum.accumulate(np.where(np.append(digit, False), len(digit), place)[::-1])[::-1]
    return before, after


def spans(weights: dict, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, as (start, kind's number, end).

    The tagger adds a run that touches no base span and no run added before it and passes the check of its kind; base spans stay.
    """
    out = []
    for text, tags in zip(texts, tag(weights, texts)):
        base = base_spans(text)
        every = list(base)
        if tags is not None:
            edge = np.flatnonzero(np.diff(tags, prepend=0, append=0))
            before, after = _digit_runs(text)
            starts = [a for a, _, _ in base]
            reach = np.maximum.accumulate([b for _, _, b in base]) if base else ()  # the furthest end of the base spans so far
            done = 0
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                kind = int(tags[a]) - 1
                if kind < 0:
                    continue
                while a < b and not (text[a].isalnum() or text[a] in "+("):
                    a += 1
                while a < b and not text[b - 1].isalnum():
                    b -= 1
                if kind:  # a run of digits is whole or not at all
                    a, b = int(before[a]), int(after[b])
                k = bisect_right(starts, b - 1)  # base spans that start before b
                if done <= a < b and not (k and reach[k - 1] > a) and _plausible(kind, text[a:b]):
                    every.append((a, kind, b))
                    done = b
            every.sort()
        out.append((base, every))
    return out


def listed(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found) -> str:
    """text with each span (of spans that overlap, their union) replaced by its first kind in brackets."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in found:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def _pieces(texts):
    """Runs of rows with about CHARACTERS characters; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHARACTERS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


FOUND = "doc_id long, base string, spans string, n_email long, n_ip long, n_card long, n_phone long, redacted string"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans, n_email, n_ip, n_card, n_phone, redacted): a row for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. base has those of the
    fixed patterns, which the counts n_ count; spans has these and the tagger's. redacted is the text with
    spans replaced by their kind. A null text counts as empty (and its redacted text is empty): no
    spans. Null ids stay. Repeated rows stay. No rows give no rows. Only doc_id and text are read.
    """
    weights = tagger().ready()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _pieces(texts):
                found = spans(weights, texts[a:b])
                counts = [[sum(x[1] == k for x in base) for base, _ in found] for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array([listed(x) for x, _ in found], pa.string()),
                        pa.array([listed(x) for _, x in found], pa.string()),
                        *[pa.array(c, pa.int64()) for c in counts],
                        pa.array([redacted(t, x) for t, (_, x) in zip(texts[a:b], found)], pa.string()),
                    ],
                    names=[x.split()[0] for x in FOUND.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def redact(docs: DataFrame) -> DataFrame:
    """docs with the text redacted and n_chars (if there is such a column) recounted; null texts stay null.

    Rows stay as they are but for these columns, in their order.
    """
    weights = tagger().ready()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            plain = [t or "" for t in texts]
            new: list = []
            for a, b in _pieces(plain):
                new += [redacted(t, x) for t, (_, x) in zip(plain[a:b], spans(weights, plain[a:b]))]
            new = [None if t is None else x for t, x in zip(texts, new)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")

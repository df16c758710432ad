"""Operator 7: main text of HTML pages from flat text blocks, classified by a decision tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import tree
from .common import table
from .extract_labels import PAGES, made_pages

# Fixed values of HTML: elements whose content is raw, that stand for nothing, that end a block, and that imply an end of <p>.
RAW = frozenset("script style textarea title noscript template iframe object svg math noembed noframes xmp select".split())
#: Of these, those that a tag cannot close by itself and that reach to the end of the page if no end tag comes.
ENDLESS = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements and words in class, id or role that mark a part of a page which is no article.
CHROME_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
CHROME_WORDS = re.compile(
    r"(?:^|(?<=[^a-z]))(?<!with-)(?<!has-)(?<!no-)(nav|navbar|navigation|menu|breadcrumbs?|header|masthead|banner|footer|sidebar|side|aside|rail|widget|related|recommended|promo|promoted|sponsor(?:ed)?"
    r"|ads?|advert|adverts|advertisement|advertising|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|toolbar|pagination|pager"
    r"|comments?|respond|replies|reply|discussion|disqus|form|search|skip|copyright|legal|complementary|contentinfo)(?=$|[^a-z])"
)
#: Of these words, those that a frame around the article may have too ("with-sidebar"): an article or main element within sets them aside.
FRAME_WORDS = frozenset("nav navbar navigation menu header masthead banner footer sidebar side aside rail social share sharing toolbar form search skip".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|main|post|entry|story|content|body|text)(?:$|[^a-z])")

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: A value without quotes may end in a slash, which then is no mark of an element without content.
_BARE_END = re.compile(r"=\s*[^\s\"'>]+/$")
#: Tags with a quote that nothing closes, each of which is looked through to the page's end; after so many, quotes count for nothing.
BROKEN = 100
PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|(<)", re.S)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|(<)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"^(?:[^\"']|\"[^\"]*\"|'[^']*')*?\shidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SPACE = re.compile(r"\s+")
#: The block's own, its neighbours', and which kinds of element are open around it.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "chrome", "article", "main", "list_item", "heading")


#: Depth of the tree, and the fewest labelled blocks of a leaf.
DEPTH, LEAST = 8, 3


def blocks(page: str) -> Iterator[tuple[str, int, int, int, int, int, int, int]]:
    """(text, words, linked words, chrome, article, main, list item, heading) of each block of text that isn't empty, in page order.

    A block ends where an element starts or ends that is not inline. Comments, scripts, styles and other
    raw elements give no text. A tag that is not closed reaches to the end of the element around it, or of
    the page; a stray end tag is skipped. chrome, article (article and main elements) and main (classes and ids that name
    such a part, too) count open elements.
    """
    stack: list[tuple[str, int, int, int, int]] = []  # name, chrome, article, main, frame words around it
    opened: Counter = Counter()
    unclosed: set[str] = set()
    token, broken = TOKEN, 0
    frame = chrome = article = main = linked = items = headings = 0
    parts: list[str] = []
    in_links: list[str] = []

    def flush():
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        n_linked = len(html.unescape(" ".join(in_links)).split()) if in_links else 0
        parts.clear()
        in_links.clear()
        if text:
            n = len(text.split())
            return (text, n, min(n, n_linked), chrome + frame, article, main, items, headings)
        return None

    at, end = 0, len(page)
    while at < end:
        m = token.search(page, at)
        if m is None:
            parts.append(page[at:])
            if linked:
                in_links.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if linked:
                in_links.append(page[at : m.start()])
        at = m.end()
        if m[4]:
            cut = _NAME.match(page, at)
            if not cut:  # a bare "<" is text
                parts.append("<")
                continue
            at = page.find(">", at) + 1 or end  # a tag with an open quote ends at the next ">"; one cut off ends the page
            name, closing, rest = cut[2].lower(), cut[1], ""
            broken += 1
            token = PLAIN_TOKEN if broken >= BROKEN else TOKEN
        elif not m[2]:
            continue
        else:
            name, closing, rest = m[2].lower(), m[1], m[3]
        if name not in INLINE and (block := flush()):
            yield block
        if closing:
            if opened[name]:
                while True:
                    top, c, i, a, frame = stack.pop()
                    chrome, article, main = chrome - c, article - i, main - a
                    opened[top] -= 1
                    linked -= top == "a"
                    items -= top in ("li", "option", "dt", "dd")
                    headings -= top in ("h1", "h2", "h3", "h4", "h5", "h6")
                    if top == name:
                        break
            continue
        whole = rest.endswith("/") and not _BARE_END.search(rest)
        if name in RAW and not (whole and name not in ENDLESS):
            close = None if name in unclosed else re.compile(rf"</{name}\s*>?", re.I).search(page, at)
            if close:
                at = close.end()
            else:
                unclosed.add(name)
                at = end if name in ENDLESS else at
            continue
        if name in VOID or whole:
            continue
        if name == "p" or name == "li":  # these end one of their kind that is open in the same element
            if stack and stack[-1][0] == name:
                _, c, i, a, frame = stack.pop()
                chrome, article, main = chrome - c, article - i, main - a
                opened[name] -= 1
                items -= name == "li"
        around, c, i = frame, int(name in CHROME_TAGS and not (name == "header" and main)), int(name in MAIN_TAGS)
        a = i
        if rest and name not in ("body", "html"):
            marks = " ".join(x[1] or x[2] or x[3] or "" for x in ATTRIBUTE.findall(rest)).lower()
            if marks and (words := set(CHROME_WORDS.findall(marks))) and not (a and words <= FRAME_WORDS):
                if words <= FRAME_WORDS and not main:
                    frame += 1
                else:
                    c = 1
            elif marks:
                a |= bool(MAIN_WORDS.search(marks))
            c |= bool(HIDDEN.search(rest))
        if name in MAIN_TAGS and not c:
            frame = 0
        stack.append((name, c, i, a, around))
        opened[name] += 1
        chrome, article, main = chrome + c, article + i, main + a
        linked += name == "a"
        items += name in ("li", "option", "dt", "dd")
        headings += name in ("h1", "h2", "h3", "h4", "h5", "h6")
    if block := flush():
        yield block


def features(found: list) -> list[tuple]:
    """A row of FEATURES for each block; beyond the first and last block, neighbours have 0 words and density 0."""
    own = [(n, k / n) for _, n, k, *_ in found]
    around = [(0, 0.0), *own, (0, 0.0)]
    return [(*around[i + 1], *around[i], *around[i + 2], *(min(1, x) for x in b[3:])) for i, b in enumerate(found)]


@cache
def model():
    """The tree, trained on the blocks of the labelled pages (extract_labels), some eleven thousand rows of 510 pages."""
    x, y = [], []
    for page, kept in PAGES:
        found = list(blocks(page))
        x += features(found)
        y += [int(any(t in b[0] for t in kept)) for b in found]
    for page, labels in made_pages():
        x += features(list(blocks(page)))
        y += labels
    return tree.train(np.array(x, float), np.array(y, float), depth=DEPTH, least=LEAST)


def main_text(page: str | None, trained=None) -> str:
    """The main text of a page; empty for null, an empty page, or one without text of an article."""
    if not page:
        return ""
    found = list(blocks(page))
    chosen = trained or model()
    return " ".join(b[0] for b, row in zip(found, features(found)) if tree.predict(chosen, row) >= 0.5)


OUT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of pages, repeated ones too, from the whole html.

    Null html: empty text. Null ids and urls stay null. No rows give no rows. Other columns of pages are not
    read. A page is parsed alone, in one pass; nothing is shuffled.
    """
    trained = model()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x, trained) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, OUT)


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""The small labelled table of operator 7: pages written for it, each with the texts of its article, and pages made by rule."""

from __future__ import annotations

import random

_LONG = "The harbour was quiet when the boats came back, and for an hour nobody on the pier spoke of the weather or of the catch at all."
_MID = "A second survey of the valley found fewer birds than the year before."
_SHORT = "Rain fell."
_LINKED = 'See <a href="/x">the survey of last year</a> and <a href="/y">its long appendix</a> for the figures in full.'
_LINKED_TEXT = "See the survey of last year and its long appendix for the figures in full."
_MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "sport", "about", "contact"))
_NAV = f"<nav><ul>{_MENU}</ul></nav>"
_FOOT = "<footer>&copy; example.org &middot; All the rights of this site are kept by its owners, who answer letters.</footer>"
_AD = '<div class="ad">Buy three of our lamps now and get the fourth lamp for nothing at all, this week only.</div>'
_SIDE = f"<aside><h3>Most read</h3><p>{'Ten gardens that you should see before the summer ends, and how to get there.'}</p><ul>{_MENU}</ul></aside>"
_COOKIE = '<div id="cookie-notice" class="notice"><p>We use cookies to make this site work and to learn how it is used by you.</p><button>Accept</button></div>'
_FORM = '<form action="/s"><label>Your address</label><input name="q"><p>Write to us with the form below and we will answer within two days.</p><button>Send</button></form>'
_COMMENTS = '<section class="comments"><h2>Comments</h2><div class="comment"><p>I was there that day and I can tell you that the sea was rough and nobody went out.</p></div><div class="comment"><p>Nonsense.</p></div></section>'
_HEADER = '<header><a href="/">The Daily Example</a><p>News from the coast for all who live along it and for their friends.</p></header>'
_SCRIPT = '<script>var t="</p><p>not a text at all";</script><style>p{margin:0}</style><!-- ad 7 <p>no text</p> -->'


def _page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>Quiet harbour</title>{_SCRIPT}</head><body>{body}</body></html>"


#: (page, texts of the article's blocks)
PAGES = (
    (_page(f"{_NAV}{_AD}<article><h1>Quiet harbour</h1><p><b>{_LONG}<br><p>{_MID}</p><p>{_SHORT}</p></article>{_FOOT}"), ("Quiet harbour", _LONG, _MID, _SHORT)),
    (_page(f"{_HEADER}{_NAV}<main><article><h1>The valley</h1><p>{_MID}</p><p>{_LINKED}</p><ul><li>Owls</li><li>Larks and wrens</li></ul><p>{_LONG}</p></article>{_SIDE}</main>{_COMMENTS}{_FOOT}"), ("The valley", _MID, _LINKED_TEXT, "Owls", "Larks and wrens", _LONG)),
    (_page(f'{_COOKIE}<div class="header">{_MENU}</div><div class="content"><h2>Rain</h2><p>{_LONG}</p>{_AD}<blockquote>{_MID}</blockquote><p>{_SHORT}</p></div>{_FORM}<div class="footer"><p>Printed on the coast, in the year of the long rain, by its owners.</p></div>'), ("Rain", _LONG, _MID, _SHORT)),
    (_page(f'<div id="sidebar"><p>Other stories of this week that our readers liked the best of all.</p><ul>{_MENU}</ul></div><div id="main"><h1>Boats</h1><p>{_SHORT}</p><p>{_LINKED}</p><p>{_LONG}</p><div class="comments"><p>The boats were late, as they have been in every year that I remember.</p></div></div>'), ("Boats", _SHORT, _LINKED_TEXT, _LONG)),
    (_page(f"<div><ul>{_MENU}</ul></div><h1>Plain page</h1><p>{_LONG}</p><p>{_MID}</p><p>{_LONG}</p><p><a href='/1'>one</a> <a href='/2'>two</a> <a href='/3'>three</a></p>"), ("Plain page", _LONG, _MID)),
    (_page(f"<table><tr><td>{_MENU}</td><td><p>{_LONG}</p><p>{_LINKED}</p><p>{_LONG}</p></td></tr></table>{_FOOT}"), (_LONG, _LINKED_TEXT)),
    (_page(f"{_NAV}{_AD}<article><h1>{_MID}</h1><p><b>{_SHORT}<br><p>{_LONG}</p><p>Be.</p><p><b>{_SHORT}<br></article>{_FOOT}"), (_MID, _SHORT, _LONG, "Be.")),
    (_page(f"{_NAV}<article><h1>Lists</h1>{_FORM}<p>{_MID}</p><ol><li>First, {_MID}</li><li>{_LONG}</li><li><a href='/z'>A third thing</a></li></ol>{_COOKIE}{_COMMENTS}<footer><p>Filed under boats and rain by the one who wrote it.</p></footer></article>"), ("Lists", _MID, _LONG, "A third thing")),
    (_page(f"{_COMMENTS}{_SIDE}{_HEADER}{_FORM}{_FOOT}"), ()),
    (_page(f"<article><p>{_SHORT}</p></article>{_SIDE}"), (_SHORT,)),
)


# --- pages whose elements tell nothing ---------------------------------------------------------------

_WORDS = (
    "harbour boat morning pier weather catch survey valley bird year winter field road bridge letter council meeting vote house garden market price farmer "
    "river bank stone school teacher lesson train station engine report figure number result study reader paper story line the a of and to in it was for on"
).split()


def _text(rng: random.Random, low: int, high: int) -> str:
    return " ".join(rng.choice(_WORDS) for _ in range(rng.randint(low, high))).capitalize() + rng.choice((".", ".", ""))


def _link(rng: random.Random, low: int = 1, high: int = 3) -> str:
    return f'<a href="/{rng.randint(1, 999)}">{_text(rng, low, high)}</a>'


def _prose(rng: random.Random, low: int, high: int) -> str:
    """Text of an article, now and then with a link in it."""
    return _text(rng, low, high) if rng.random() < 0.75 else f"{_text(rng, low, high)} {_link(rng, 1, 5)} {_text(rng, low, high)}"


def _plain_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page of div, td, section or p elements whose names, if any, tell nothing or mislead; and the label of each block."""
    own, rows = rng.choice((("div", "div"), ("table", "tr"), ("section", "section"), ("center", "div"))), []
    tag = "td" if own[0] == "table" else "div"

    def put(label, body, name=None):
        kind = name or rng.choice((tag, tag, "p" if tag == "div" else tag))
        mark = rng.choice(("", "", f' class="c{rng.randint(1, 99)}"', f' id="x{rng.randint(1, 9)}"'))
        rows.append((label, f"<{kind}{mark}>{body}</{kind}>"))

    def links(n, low=1, high=3):
        if rng.random() < 0.5:
            put(0, " | ".join(_link(rng, low, high) for _ in range(n)))
        else:
            for _ in range(n):
                put(0, _link(rng, low, high), "li")

    put(0, _text(rng, 1, 4) if rng.random() < 0.6 else _link(rng, 1, 4))
    if rng.random() < 0.6:
        put(0, _text(rng, 3, 9))
    links(rng.randint(3, 8))
    if rng.random() < 0.4:
        put(0, " &gt; ".join([_link(rng), _link(rng), _text(rng, 1, 3)]))
    if rng.random() < 0.5:
        put(0, _text(rng, 4, 14))
    if rng.random() < 0.75:
        put(1, _text(rng, 3, 10), rng.choice(("h1", "h1", "h2", tag)))
    for i in range(rng.randint(3, 10)):
        kind = rng.random()
        if kind < 0.12 and i:
            put(1, _text(rng, 2, 5), "h2")
        if kind > 0.9:
            for _ in range(rng.randint(2, 4)):
                put(1, _text(rng, 6, 18), "li")
        elif kind > 0.82 and i:
            put(1, _text(rng, 1, 6))
        else:
            put(1, _prose(rng, 18, 70))
    put(1, _prose(rng, 18, 50))
    if rng.random() < 0.6:
        put(0, _text(rng, 1, 3), rng.choice(("h3", tag)))
        links(rng.randint(3, 6), 3, 9)
    if rng.random() < 0.4:
        put(0, _text(rng, 3, 12))
    links(rng.randint(2, 5))
    for _ in range(rng.randint(1, 2)):
        put(0, rng.choice(("&copy; ", "")) + _text(rng, 3, 12))
    around = rng.choice(("", "", ' class="content"', ' id="main"'))
    return f"<html><body><{own[0]}{around}><{own[1]}>{''.join(x for _, x in rows)}</{own[1]}></{own[0]}></body></html>", [k for k, _ in rows]


def _marked_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page whose elements and names tell what is no article, with texts of any length in both."""
    rows: list[tuple[int, str]] = []

    def put(*texts):  # each: label, text of one block
        rows.extend(texts)
        return "".join(x for _, x in texts)

    def some(label, name, low, high, least=1, most=3):
        return put(*[(label, f"<{name}>{_prose(rng, low, high) if label else _text(rng, low, high)}</{name}>") for _ in range(rng.randint(least, most))])

    def menu():
        return put(*[(0, f"<li>{_link(rng)}</li>") for _ in range(rng.randint(2, 6))])

    def aside(open_, close, body):
        return f"<{open_}>{body()}</{close}>"

    chrome = [
        lambda: aside("nav", "nav", lambda: f"<ul>{menu()}</ul>"),
        lambda: aside('div class="ad"', "div", lambda: put((0, _text(rng, 1, 30)))),
        lambda: aside('div class="advert"', "div", lambda: some(0, "p", 5, 40)),
        lambda: aside("aside", "aside", lambda: some(0, "p", 2, 40) + menu()),
        lambda: aside('div id="sidebar"', "div", lambda: some(0, "p", 2, 30) + menu()),
        lambda: aside('section class="comments"', "section", lambda: some(0, "p", 1, 60, 2, 5)),
        lambda: aside('div class="cookie-notice"', "div", lambda: some(0, "p", 6, 40)),
        lambda: aside("form", "form", lambda: some(0, "p", 2, 20)),
    ]
    kind = rng.choice(("article", "article", "article", "main", 'div class="post"', 'div class="entry-content"', 'div id="story"', ""))
    head = "".join(rng.choice(chrome)() for _ in range(rng.randint(0, 3))) + (aside("header", "header", lambda: some(0, "p", 1, 12)) if rng.random() < 0.5 else "")
    tiny = bool(kind) and rng.random() < 0.15  # a sentence or two are an article too
    body = some(1, "p", 1, 6, 1, 2) if tiny else some(1, "h1", 1, 12, 1, 1) if rng.random() < 0.7 else ""
    for _ in range(0 if tiny else rng.randint(1, 7)):
        x = rng.random()
        body += some(1, "p", 1, 6) if x < 0.5 else some(1, "p", 15, 70) if x < 0.75 else some(1, "li", 1, 15) if x < 0.9 else some(1, "h2", 1, 5, 1, 1)
        if rng.random() < 0.15:
            body += rng.choice(chrome)()
    body = f"<{kind}>{body}</{kind.split()[0]}>" if kind else body
    tail = "".join(rng.choice(chrome)() for _ in range(rng.randint(0, 2)))
    if rng.random() < 0.7:
        tail += aside("footer", "footer", lambda: some(0, "p", 1, 25) + menu())
    return f"<html><body>{head}{body}{tail}</body></html>", [k for k, _ in rows]


def made_pages(plain: int = 100, marked: int = 400, seed: int = 5) -> list[tuple[str, list[int]]]:
    """(page, label of each block) of so many pages of either kind, the same in every run."""
    rng = random.Random(seed)
    return [_plain_page(rng) for _ in range(plain)] + [_marked_page(rng) for _ in range(marked)]

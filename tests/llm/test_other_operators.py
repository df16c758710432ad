"""Operators 1, 3, 5, 6 and 7 on small tables, with the odd cases of each."""

import gzip
import hashlib
import math
import time
import zlib

import numpy as np
import pytest

from quire.llm import embeddings, extract, licences, mixture, warc
from quire.llm.common import Scratch
from quire.llm.components import components


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()))
    low = {}
    for a, b in edges:
        if a is not None and a != b:
            low.setdefault(a, a), low.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    assert got == low
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).collect() == []


PAGES = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", "long " * 50_000), (None, "n", "<p>x</p>"), (6, "u", "é" * 3), (2, None, "<p>x</p>")]


@pytest.mark.parametrize("size", [1, 1 << 24])
def test_warc_round_trip(spark, size):
    pages = spark.createDataFrame([(*r, "k") for r in PAGES], "page_id long, url string, html string, record_type string").repartition(2)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages, archive_bytes=size).collect()), key=str)
    high = {}
    for i, _, h in PAGES:
        k = h or ""
        high[k] = max(high.get(k, -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        data, first = (h or "").encode(), high[h or ""]
        own = i == first
        want.append((i, len(data), warc.digest(data), "response" if own else "revisit", None if own else first))
    assert got == sorted(want, key=str)
    assert warc.warc_round_trip(pages.limit(0)).collect() == []


def test_normaliser_streams(tmp_path):
    raws = [warc.record(i, "u", b"z" * i, i, warc.digest(b"z" * i), "response", None) for i in range(0, 3000, 7)]
    whole = gzip.compress(b"".join(raws[:100])) + gzip.compress(b"".join(raws[100:]))
    index: list = []
    out = b"".join(warc.normalise((whole[i : i + 37] for i in range(0, len(whole), 37)), index))
    assert [zlib.decompress(out[x["offset"] : x["offset"] + x["length"]], 31) for x in index] == raws
    with pytest.raises(EOFError):
        list(warc.normalise([whole[:-20]], []))
    with pytest.raises(EOFError):
        list(warc.normalise([gzip.compress(raws[5][:-10])], []))


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append([c % 2, (centre + rng.normal(size=16) * 0.08).tolist()])
    rows += [[0, rows[0][1]], [0, [2 * x for x in rows[1][1]]], [None, rows[0][1]], [0, None], [0, []], [0, [0.0] * 16], [1, [math.nan] + [1.0] * 15], [1, [None] + [1.0] * 15], [1, [math.inf] + [1.0] * 15], [1, [1.0, 2.0]], [1, [1.0, 2.0]]]
    data = [(i, v, label, "x", 3) for i, (label, v) in enumerate(rows)] + [(None, rows[0][1], 0, "x", 3)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, key string, node int").repartition(3)
    units = {}
    for i, v, label, *_ in data:
        if i is not None and label is not None and v and None not in v:
            x = np.array(v, np.float32).astype(float)
            if np.isfinite(x).all() and x.any():
                units[i] = (label, x / np.linalg.norm(x))
    near = {i: {j for j in units if j != i and units[i][0] == units[j][0] and len(units[i][1]) == len(units[j][1]) and units[i][1] @ units[j][1] >= 0.98} for i in units}
    low = {i: i for i, *_ in data if i is not None}
    for _ in data:
        for i in near:
            for j in near[i]:
                low[i] = low[j] = min(low[i], low[j])
    for cell, chunk in ((2_000, 4_096), (10, 4_096), (40, 8)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame, cell=cell, chunk=chunk).collect()}
        assert got.pop(None) == (0, None, False)
        assert got == {i: (len(near.get(i, ())), low[i], low[i] == i) for i in low}, (cell, chunk)
    assert max(map(len, near.values())) > 5
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []


def test_embeddings_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 1.0], 0)]
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False)]


def test_licences(spark):
    names = licences.known(spark)
    noisy = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + licences._MIT.upper().replace(",", " ,").replace("SUBLICENSE", "SUB-LICENCE")
    rows = [(1, licences._MIT), (2, noisy), (3, licences._MIT + " and more"), (4, None), (5, ""), (6, "!!!"), (7, "x " * 100_000), (1, licences._MIT), (None, licences._ISC), (8, "Some prose.\nLicensed under CC BY-NC 4.0.\nMore.")]
    docs = spark.createDataFrame([(*r, "old", 1) for r in rows], "doc_id long, text string, licence string, digest int")
    got = licences.scan(docs, names).collect()
    assert sorted((str(r.doc_id), r.licence) for r in got if r.licence) == [("1", "MIT"), ("1", "MIT"), ("2", "MIT"), ("None", "ISC")] and len(got) == len(rows)
    assert [tuple(r) for r in licences.scan_lines(docs, names).collect() if r.doc_id == 8] == [(8, 1, "CC-BY-NC-4.0")]
    assert licences.scan(docs.limit(0), names).collect() == []


def test_licences_keep_columns_of_any_name_and_lines_of_any_end(spark, tmp_path):
    rows = [(1, "Copyright 2020 x\rLicensed under CC BY 4.0."), (2, "a\u2028Copyright 2020\nLicensed under CC BY 4.0."), (3, licences._MIT0), (4, "// SPDX-License-Identifier: MIT"), (5, licences._0BSD.upper())]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, _digest string, _licence string, _p string")
    names = licences.known(spark)
    got = {r.doc_id: r for r in licences.scan(docs, names).collect()}
    assert all((r._digest, r._licence, r._p) == ("x", "y", "z") for r in got.values())
    assert [got[i].licence for i in range(1, 6)] == [None, None, "MIT-0", "MIT", "0BSD"]
    import duckdb

    docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(licences.OP5_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet' AS documents")).fetchall()
    assert sorted(map(str, map(tuple, licences.scan_both(docs, names).collect()))) == sorted(map(str, want))
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "Own-1.0.txt").write_text("Do what you like,\nbut ask.")
    own = licences.known_files(spark, f"{tmp_path}/texts")
    assert [r.licence for r in licences.scan(spark.createDataFrame([(1, "do what you LIKE but ask")], "doc_id long, text string"), own).collect()] == ["Own-1.0"]


def test_no_column_of_documents_is_lost(spark):
    from quire.llm import decontaminate

    names = "mix_size mix_pass mix_position _mix_key _mix_s row _x _d _t text_key item_id size MIX_WORDS".split()
    docs = spark.createDataFrame([(i, f"w{i} a b", "s", *[f"{n}{i}" for n in names]) for i in range(5)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    mixed = mixture.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_pass_", "mix_words_", "mix_position_"]
    assert all(r[n] == f"{n}{r.doc_id}" for r in mixed.collect() for n in names) and mixed.count() >= 5
    leaks = spark.createDataFrame([(3, 1)], "doc_id long, k long").join(docs, "doc_id").selectExpr("doc_id", "xxhash64(text) AS text_key")
    kept = decontaminate.remove(docs, leaks)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 4]


def _fill(sizes, weights, budget):
    target, open_ = {}, set(sizes)
    while True:
        left = budget - sum(target.values())
        share = {s: weights[s] * left / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
        open_ -= over


def test_mixture_targets_and_takes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s, n in (("a", 3), ("b", 200), ("c", 40), ("é", 5), (None, 10)):
        rows += [(len(rows) + i, "w " * int(rng.integers(0, 30)), s) for i in range(n)]
    rows += [(0, "w w", "a"), (None, "w w w", "b"), (None, None, "c"), (900, "  x\t\x0by", "c")]
    docs = spark.createDataFrame([(*r, 9, "t") for r in rows], "doc_id long, text string, source string, target int, size string").repartition(4)
    scratch = Scratch(spark)
    sizes = mixture.measured(docs, scratch)
    got = {r.source: (r.source_size, r.target) for r in mixture.targets(sizes).collect()}
    per: dict = {}
    for r in sizes.collect():
        per[r.source] = per.get(r.source, 0) + r["size"]
    order = sorted((x for x in per if x is not None)) + [None]
    want = _fill(per, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(per.values()))
    assert all(got[s][0] == per[s] and abs(got[s][1] - want[s]) < 1e-6 for s in per)
    mixed = mixture.mix(docs)
    out = mixed.collect()
    assert mixed.columns == [*docs.columns, "mix_pass", "mix_words", "mix_position"]
    taken: dict = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.mix_words
    assert all(abs(taken.get(s, 0) - want[s]) <= 1 for s in per)
    positions = [r.mix_position for r in out]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert out == mixture.mix(docs.repartition(2)).collect()
    assert mixture.mix(docs.limit(0)).collect() == []
    assert mixture.mix(docs.where("text is null")).collect() == []


def test_extract_on_odd_pages(spark):
    body = "The river rose all night and by the morning it stood at the doors of the lower town, where nobody slept."
    cases = [
        (f"<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{body}<p>A&nbsp;b\n c<script>var x='</p>'</script></article><footer>f</footer>", f"T & U {body} A b c"),
        (None, ""), ("", ""), ("<p", ""), ("<<<", "<<<" if extract.main_text("<<<") else ""),
        (f'<body class="has-sidebar"><div class="layout sidebar-left"><aside>menu of the week</aside><article><p>{body}</p><div class="comments"><p>Me too, I was there.</p></div></article></div>', body),
        (f"<article><p>{body}</p><!-- <p>no</p> --><p hidden>secret text that is not shown</p><form><p>Write to us now please</p></form></article>", body),
        (f"<article><p title='open>{body}</p></article>", None),
    ]
    pages = spark.createDataFrame([(i, "u", h, "t") for i, (h, _) in enumerate(cases)] + [(None, None, cases[0][0], "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract.extract(pages).collect()}
    for i, (_, want) in enumerate(cases):
        if want is not None:
            assert got[i] == (want, len(want)), i
    assert got[None] == got[0]
    assert extract.extract(pages.limit(0)).collect() == []


def test_tree_on_its_labelled_table():
    for page, kept in extract.PAGES:
        text = extract.main_text(page)
        found = [b[0] for b in extract.blocks(page)]
        assert text == " ".join(b for b in found if any(t in b for t in kept))


def _splits(t):
    return {extract.FEATURES[t[0]]} | _splits(t[2]) | _splits(t[3]) if isinstance(t, list) else set()


def test_tree_decides_by_neighbours():
    assert {"words", "link_density"} <= _splits(extract.model()) and {"words_before", "words_after", "link_density_before", "link_density_after"} & _splits(extract.model())
    long = "a plain sentence of the text goes on " * 6
    page = f"<div><div>Short words here</div><div>{long}</div><div>Short words here</div><div>{long}</div></div>"
    menu = '<div><a href="/a">One two</a> <a href="/b">three four</a></div>'
    assert extract.main_text(page).count("Short words here") >= 1  # between long blocks
    assert "Short words here" not in extract.main_text(f"<div>{menu}<div>Short words here</div>{menu}<div>{long}</div></div>")


_SEA = "Far out on the grey water two trawlers turned for home while the wind went round to the north and the light failed."
_LAW = "Judges sat late on Friday to hear the last of the appeals, which had been put off twice since the spring."
_MAP = "Old maps give the lane another name, and nobody in the parish could say when or why it had been changed."
_TIN = "Miners left the valley"
#: Pages that the tree was not trained on: (label, block) in order, in layouts of several kinds.
HELD_OUT = (
    ("<div>{}</div>", [(0, "<a href=/>Coast Times</a>"), (0, "<a href=/n>News</a> <a href=/s>Sport</a> <a href=/w>Weather forecast</a>"), (1, "Two trawlers home"), (1, _SEA), (1, _LAW), (1, _SEA), (0, "<a href=/1>More about boats</a> <a href=/2>More about wind</a>"), (0, "Coast Times, since 1902")]),
    ("<table><tr>{}</tr></table>", [(0, "<a href=/>Start</a>"), (0, "<a href=/x>Archive of the paper</a>"), (1, _LAW), (1, f"{_MAP} <a href=/q>The parish map</a> shows it."), (1, _TIN), (1, _SEA), (0, "<a href=/p>Imprint</a>"), (0, "All rights kept")]),
    ('<div id="content">{}</div>', [(0, "Welcome"), (0, "<a href=/a>Lanes</a> | <a href=/b>Maps</a> | <a href=/c>Names</a>"), (1, "Lanes and their names"), (1, _MAP), (1, _MAP), (1, _LAW), (0, "See also"), (0, "<a href=/k>Ten lanes to walk in autumn</a>"), (0, "<a href=/l>Nine lanes to walk in spring</a>"), (0, "Made in the parish")]),
    ("<article>{}</article><footer><p>Printed by the sea for those who asked for a paper of their own in the year of the flood.</p></footer>", [(1, "Rain"), (1, "Be."), (1, _SEA), (1, "No."), (1, _TIN)]),
    ('<section class="post">{}</section><section class="comments"><p>I never saw so many boats come home at once, and I have lived here for sixty years.</p></section>', [(1, "Boats"), (1, _SEA), (1, _TIN), (1, _LAW)]),
)


def test_extraction_of_held_out_pages():
    kept = right = wanted = 0
    for frame, parts in HELD_OUT:
        tag = "td" if "table" in frame else "div"
        page = "<html><body>" + frame.format("".join(f"<{tag}>{x}</{tag}>" for _, x in parts)) + "</body></html>"
        found = list(extract.blocks(page))
        labels = [k for k, _ in parts] + [0] * (len(found) - len(parts))
        for y, row in zip(labels, extract.features(found)):
            yes = extract.tree.predict(extract.model(), row) >= 0.5
            kept, right, wanted = kept + yes, right + (yes and y), wanted + y
    assert right / kept >= 0.9 and right / wanted >= 0.9, (kept, right, wanted)
    kept = right = wanted = 0
    for page, labels in extract.made_pages(100, 100, seed=99):
        found = list(extract.blocks(page))
        assert len(found) == len(labels)
        for y, row in zip(labels, extract.features(found)):
            yes = extract.tree.predict(extract.model(), row) >= 0.5
            kept, right, wanted = kept + yes, right + (yes and y), wanted + y
    assert right / kept >= 0.97 and right / wanted >= 0.97, (kept, right, wanted)


def test_extraction_against_all_articles_of_the_pages():
    """The pages of the test tables hold their article in one element and nothing else in it."""
    import re

    import pandas as pd

    for page in pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        plain = extract.html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", ""))
        assert extract.main_text(page) == " ".join(plain.split())


def test_tags_that_close_themselves_or_never():
    body = "The river rose all night and by the morning it stood at the doors of the lower town, where nobody slept."
    for odd in ("<svg width=1/>", "<math/>", "<select><option>", "<object data=x>", "<noscript>", "<svg><path/></svg>"):
        assert extract.main_text(f"<article><p>{body}</p>{odd}<p>{body}</p></article>").count(body) == 2, odd
    (block,) = extract.blocks("<p>see <a href=http://x.org/>the linked words</a> here</p>")
    assert block[1:3] == (5, 3)
    for hostile in ('<a ">"' * 30_000, "<svg>" * 50_000, "<div>" * 20_000 + "</p>" * 20_000, "<" * 100_000, "<a '" * 20_000):
        began = time.process_time()
        extract.main_text(hostile)
        assert time.process_time() - began < 5, hostile[:10]


def test_digest_is_base32_of_sha1():
    assert len(warc.digest(b"")) == 32 and hashlib.sha1(b"").hexdigest().startswith("da39")

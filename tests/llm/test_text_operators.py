"""Operators 4, 8, 9 and 10 and 2 on small tables against brute force, with the odd cases of each."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest
import xxhash

from quire.llm import bilstm, decontaminate, passages, pii, simhash, toxicity

LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
DOCS = [
    (1, PASSAGE + " tail of the first"),
    (2, "before it " + PASSAGE),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, LONG),
    (7, LONG),
    (7, LONG),
    (None, PASSAGE),
    (8, "the " * 60),
    (9, "the " * 60 + "end"),
    (10, "café bar " + PASSAGE.upper()),
    (11, "short"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", 1, "x", 2, "y") for r in DOCS], SCHEMA + ", lang string, marks int, copy string, fp int, node string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_masks_hit_every_pair_of_substitutions():
    for gone in itertools.combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.EQUAL):
        assert any(
            not any(x - o in mask for x in gone) for mask in decontaminate.MASKS for o in range(decontaminate.WINDOW - max(mask))
        ), gone


def test_masks_of_short_items_hit_what_may_differ():
    assert [decontaminate.need(n) for n in range(1, 15)] == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 11, 11, 11]
    for n in range(1, decontaminate.WINDOW):
        for gone in itertools.combinations(range(n), n - decontaminate.need(n)):
            assert any(not any(x in mask for x in gone) for mask in decontaminate.masks(n)), (n, gone)


def test_items_of_any_length_against_brute_force(spark, tmp_path):
    import duckdb

    rng, words, rows, items = np.random.default_rng(4), [f"v{i}" for i in range(400)], [], []
    for n in range(1, 21):
        for copy in range(3):
            item = [f"i{n}c{copy}x{k}" for k in range(n)]
            items.append((100 * n + copy, " ".join(item)))
            for changed in range(4):
                text = list(item)
                for at in rng.choice(n, min(n, changed), replace=False):
                    text[at] = "other"
                pad = [list(rng.choice(words, 15)) for _ in range(2)]
                rows.append((len(rows), " ".join([*(pad[0] if changed % 2 else []), *text, *(pad[1] if copy else [])])))
    items += [(7, items[-1][1].upper()), (8, items[3][1] + "!"), (9, None)]
    docs, bench = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for name, frame in (("documents", docs), ("benchmark", bench)):
        frame.toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    sql = decontaminate.OP2_SQL
    for name in ("documents", "benchmark"):
        sql = sql.replace(f"FROM {name}", f"FROM '{tmp_path}/{name}.parquet'")
    want = duckdb.sql(sql).fetchall()
    got = decontaminate.op2_decontaminate(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r[4] for r in want}) == 13
    assert {r.item_ids for r in got if r.item_id == 7} == {"7,2002"} and {r.item_ids for r in got if r.item_id == 8} == {"8,200"}
    found = {r.doc_id for r in got}
    for i, (_, text) in enumerate(rows):
        changed, n = i % 4, 1 + i // 12
        assert (i in found) == (min(n, changed) <= min(n, 13) - decontaminate.need(n)) or n > 13, (i, n, changed)


def test_passages_against_brute_force(docs, empty):
    got = sorted(map(tuple, passages.remove_repeats(docs).collect()), key=str)
    starts = {}
    for d, t in DOCS:
        w = words(t)
        if d is not None:
            for i in range(len(w) - 12):
                k = tuple(w[i : i + 13])
                starts[k] = min(starts.get(k, d), d)
    want = []
    for d, t in DOCS:
        w = words(t)
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and starts[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want, key=str)
    assert passages.remove_repeats(empty).collect() == []


def test_longest_repeats_doubles_until_none_is_left(spark, empty):
    base = " ".join(f"a{i}" for i in range(60))
    rows = [(1, base), (2, "x " + base), (3, base[: base.index("a30")]), (4, "nothing here"), (5, None)]
    got = dict(map(tuple, passages.longest_repeats(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == {1: 52, 2: 52, 3: 26}
    assert passages.longest_repeats(empty).collect() == []


def _fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(docs, empty):
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    fps = [(d, _fingerprint(t)) for d, t in DOCS]
    low = {}
    for d, f in fps:
        if d is None:
            continue
        group, grown = {f}, True
        while grown:
            more = {g for e, g in fps if e is not None and any((g ^ x).bit_count() <= 2 for x in group)}
            grown, group = not more <= group, group | more
        low[d] = min(e for e, g in fps if e is not None and g in group)
    assert got == sorted([(d, f"{f:016x}", low.get(d)) for d, f in fps], key=str)
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 8])
def test_plan_of_groups_finds_every_pair(radius):
    rng = np.random.default_rng(radius)
    sample = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for n in (1_000, 10**7, 10**10):
        plan = simhash.allocate(sample, max(1, radius), n)
        assert sum(t + 1 for _, t in plan) == max(1, radius) + 1 and all(t >= 0 for _, t in plan)
        assert len({b for bits, _ in plan for b in bits}) == sum(len(bits) for bits, _ in plan)
        for _ in range(300):
            flip = rng.choice(64, radius, replace=False)
            assert any(sum(b in bits for b in flip) <= t for bits, t in plan)


def test_links_in_chunks_equal_links_at_once(spark):
    from quire.llm.common import Scratch
    from quire.llm.components import components

    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2))})
    rows = [(f, b"", i) for i, f in enumerate(fps)]
    frame = spark.createDataFrame(rows, "fp long, sig binary, node long")
    scratch = Scratch(spark)
    got = {
        chunk: sorted(map(tuple, components(simhash.links(scratch.keep(frame), 2, scratch, chunk=chunk), scratch).collect()))
        for chunk in (4096, 7)
    }
    assert got[4096] == got[7] and len(got[7]) > 10


def test_groups_of_thousands_of_fingerprints_against_brute_force(spark):
    from quire.llm.common import Scratch

    rng = np.random.default_rng(21)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 900).astype(np.uint64)
    fps = [base]
    for bits in range(1, 5):  # flips planted over all places, alone and as chains
        for at in range(64):
            flip = np.uint64(sum(1 << int((at + k * 17) % 64) for k in range(bits)))
            fps.append(rng.choice(base, 8) ^ flip)
    fps = np.unique(np.concatenate(fps))
    rng.shuffle(fps)
    near = [np.flatnonzero(np.bitwise_count(fps ^ x) <= 2) for x in fps]
    low = np.arange(len(fps))
    while True:
        then = np.array([low[n].min() for n in near])
        then = np.minimum(then, low)
        if (then == low).all():
            break
        low = then
    rows = [(i, int(x), b"") for i, x in enumerate(fps.view(np.int64))]
    got = {r.fp: r.component for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long, sig binary").repartition(5), 2, Scratch(spark)).collect()}
    assert len(fps) > 2500 and (low != np.arange(len(fps))).sum() > 800
    assert [got[r[1]] for r in rows] == low.tolist()


def test_keep_one_of_each_group(spark, empty):
    near = PASSAGE + " " + LONG[:3000]
    rows = [(1, near), (2, near.replace("seven", "sieben")), (2, near.replace("seven", "sieben")), (3, LONG[9000:12000]), (None, near), (4, None), (5, "")]
    frame = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", component int")
    got = simhash.keep_one(frame)
    assert got.columns == frame.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "4", "None"]
    assert simhash.keep_one(empty).collect() == []


def test_decontaminate(spark, empty):
    items = spark.createDataFrame([(1, PASSAGE, 0), (2, PASSAGE.upper() + "!", 0), (3, "alpha beta gamma delta epsilon zeta eta theta", 0), (4, "too short", 0), (5, None, 0), (6, "", 0)], "item_id long, text string, doc_id int")
    w = PASSAGE.split()
    two = [*w[:3], "X", *w[4:9], "Y", *w[10:]]
    three = [*w[:3], "X", *w[4:7], "Z", w[8], "Y", *w[10:12], "V", *w[13:]]
    rows = [
        (1, "start " + " ".join(two) + " end"), (2, " ".join(three)), (3, "so alpha, beta-gamma delta epsilon zeta eta THETA."), (4, "alpha beta gamma X epsilon zeta eta theta"),
        (5, None), (6, ""), (None, PASSAGE), (7, LONG + " " + PASSAGE), (8, "clean words only"), (9, "start " + PASSAGE[:30]),
    ]
    rows += [(1, "start " + " ".join(two) + " end")]
    docs = spark.createDataFrame([(*r, "z", 3) for r in rows], SCHEMA + ", tokens string, item_id int")
    found = decontaminate.contaminated(docs, items)
    got = sorted((str(r.doc_id), r.item_id, r.n_equal, r.window) for r in found.collect())
    assert got == [("1", 1, 11, 13), ("3", 3, 8, 8), ("4", 3, 7, 8), ("7", 1, 13, 13), ("None", 1, 13, 13)]
    assert all(r.item_ids == ([1, 2] if r.item_id == 1 else [3]) for r in found.collect())
    kept = decontaminate.remove(docs, found)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 8, 9]
    assert decontaminate.contaminated(empty, items).collect() == []
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []


def test_base_spans_against_plain_patterns():
    text = "a.b+c@x.y.org, @no.where me@h 1.2.3.4 1.2.3.256 1.2.3.4.5 x 4111 1111-1111 1111 x 4111111111111112 x +1 (017) 555-7713 +12 +1234567890123456 z@a.b"
    want = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(text)]
    want += [(m.start(), 1, m.end()) for m in pii.IP.finditer(text) if all(int(x) < 256 for x in m[0].split("."))]
    for m in pii.CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            want.append((m.start(), 2, m.end()))
    want += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    assert pii.base_spans(text) == sorted(want) and {k for _, k, _ in want} == {0, 1, 2, 3}


def _plain_spans(text):
    """The fixed patterns, run as they stand."""
    want = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(text)]
    want += [(m.start(), 1, m.end()) for m in pii.IP.finditer(text) if all(int(x) < 256 for x in m[0].split("."))]
    for m in pii.CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            want.append((m.start(), 2, m.end()))
    return sorted(want + [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_base_spans_equal_the_patterns_on_random_texts():
    rng, alphabet, found = np.random.default_rng(0), list("0123456789..--  @@ab+()%2 5"), 0
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet, rng.integers(1, 40)))
        found += len(_plain_spans(text))
        assert pii.base_spans(text) == _plain_spans(text), text
    assert found > 500
    assert pii.base_spans("0" * 5000 + "1.1.1.1") == [(0, 1, 5007)]


@pytest.mark.parametrize("text", ["7" * 5000 + ".1.1.1", "7" * 10**6, "+1 " * 333_333, "1." * 500_000, "a@" * 500_000, "a" * 10**6, "1-" * 500_000, "1.2.3.4 " * 100_000], ids=lambda t: t[:6])
def test_base_spans_take_linear_time(text):
    began = time.process_time()
    pii.base_spans(text)
    assert time.process_time() - began < 3


def test_spans_of_hostile_texts():
    w = pii.tagger().ready()
    for text in ("7" * 5000 + ".1.1.1", "7" * 60_000, "+1 " * 20_000, " at " * 20_000, "1 . " * 20_000):
        (base, every), = pii.spans(w, [text])
        assert base == _plain_spans(text[:4000]) == [] and all(b - a <= max(pii.LONGEST) for a, _, b in every)


PII_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT doc_id, 'email' AS kind, 0 AS ord, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS g FROM d
  UNION ALL SELECT doc_id, 'ip', 1, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), regexp_split_to_array(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
  UNION ALL SELECT doc_id, 'card', 2, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), regexp_split_to_array(t, '[0-9]([\x20-]?[0-9])+') FROM d
  UNION ALL SELECT doc_id, 'phone', 3, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
), u AS (SELECT doc_id, kind, ord, unnest(m) AS x, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM s
), q AS (
  SELECT doc_id, kind, ord, x, regexp_replace(x, '[^0-9]', '', 'g') AS n,
    CAST(sum(length(gap) + length(x)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM u
), f AS (
  SELECT * FROM q WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN list_max(list_transform(string_split(x, '.'), lambda v: CAST(v AS HUGEINT))) <= 255
    WHEN 'phone' THEN length(n) BETWEEN 10 AND 15
    ELSE length(n) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(n)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(n[length(n) - k] AS INT)
      ELSE CAST(n[length(n) - k] AS INT) * 2 - CASE WHEN CAST(n[length(n) - k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END
)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
  count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || (stop - length(x)) || ':' || stop, ',' ORDER BY stop - length(x), ord), '')) AS base_sha256
FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""


def test_base_columns_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    want = duckdb.sql(PII_SQL.replace("FROM documents", f"FROM '{folder}/documents.parquet'")).fetchall()
    got = pii.op4_pii(spark, folder).drop("spans").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(sum(r[1:5]) for r in want) > 20


def test_best_path_of_long_runs_against_one_search(monkeypatch):
    rng = np.random.default_rng(2)
    model = bilstm.Tagger(5, 4, hidden=3, seed=6)
    model.p["trans"] = rng.normal(0, 2, (4, 4))
    w = model.ready()
    for length, cols in ((1, 4), (2, 9), (700, 6), (3000, 2)):
        x = rng.integers(0, 5, (length, cols))
        e, tr = bilstm.emissions(w, x).astype(float), w["trans"].astype(float)
        for summed in (1 << 20, 97):
            monkeypatch.setattr(bilstm, "SUMMED", summed)
            found = bilstm.decode(w, x)
            for j in range(cols):
                best = w["start"] + e[0, :, j]
                for s in range(1, length):
                    best = (best[:, None] + tr).max(axis=0) + e[s, :, j]
                path = found.get(j, np.zeros(length, int))
                value = w["start"][path[0]] + e[np.arange(length), path, j].sum() + tr[path[:-1], path[1:]].sum()
                assert abs(value - best.max()) < 1e-3, (length, j)


def test_windows_give_the_tags_of_one_window_a_text(monkeypatch):
    rng = np.random.default_rng(77)
    texts = [pii.labelled(rng, n)[0] for n in (30, 500, 512, 513, 900, 2000, 6000)] + ["", "x"]
    w = pii.tagger().ready()
    cut = pii.tag(w, texts)
    monkeypatch.setattr(pii, "CHARACTERS", 10)
    again = pii.tag(w, texts)
    monkeypatch.setattr(pii, "LENGTH", 10**6)
    for a, b, c in zip(cut, again, pii.tag(w, texts)):
        assert (a is None and b is None and c is None) or ((a == b).all() and (a == c).mean() > 0.999)
    assert sum(x is not None for x in cut) >= 5


def test_gradient_of_the_tagger():
    model = bilstm.Tagger(7, 3, hidden=3, seed=1)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 7, (6, 4)), rng.integers(0, 3, (6, 4))
    _, grad = model.loss(x, y)
    for name, g in grad.items():
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        old = model.p[name][at]
        sides = []
        for step in (1e-5, -1e-5):
            model.p[name][at] = old + step
            sides.append(model.loss(x, y)[0])
        model.p[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-5 - g[at]) < 1e-4, name


def test_decode_against_all_paths():
    model = bilstm.Tagger(5, 3, hidden=2, seed=4)
    w = model.ready()
    x = np.random.default_rng(1).integers(0, 5, (5, 20))
    e, found = bilstm.emissions(w, x), bilstm.decode(w, x)
    for j in range(20):
        def value(path, j=j):
            return w["start"][path[0]] + sum(e[t, k, j] for t, k in enumerate(path)) + sum(w["trans"][a, b] for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(3), repeat=5), key=value)
        assert abs(value(best) - value(tuple(found.get(j, np.zeros(5, int))))) < 1e-4


def test_tagger_on_held_out_spans_and_windows():
    model = pii.tagger()
    rng = np.random.default_rng(12345)
    rows = [pii.labelled(rng, 64) for _ in range(200)]
    x, y = np.stack([pii.symbols(t) for t, _ in rows], 1), np.stack([t for _, t in rows], 1)
    p = np.zeros_like(y)
    for c, tags in bilstm.decode(model.ready(), x).items():
        p[:, c] = tags
    assert (p == y).mean() > 0.97 and (p[y > 0] == y[y > 0]).mean() > 0.88
    w = model.ready()
    long = "plain words here " * 100 + "write to jo at mail dot example dot com please " + "and more words " * 100
    assert all((a is None and b is None) or (a == b).all() for a, b in zip(pii.tag(w, [long, "x", ""]), [pii.tag(w, [t])[0] for t in (long, "x", "")]))


def test_find_and_redact(spark, empty):
    mail, card = "bo@mail3.example.com", "4111 1111 1111 1111"
    rows = [(1, f"write {mail} or {card}."), (2, None), (3, ""), (None, f"\U0001F600 {mail}"), (4, LONG + " +1 (017) 555-7713"), (1, f"write {mail} or {card}.")]
    docs = spark.createDataFrame([(*r, 5, "b") for r in rows], SCHEMA + ", n_chars long, base string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in pii.find(docs).collect()}
    n = len(LONG) + 1
    assert got == {(1, 1, 0, 1, 0, "email:6:26,card:30:49"), (2, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, ""), (None, 1, 0, 0, 0, "email:2:22"), (4, 0, 0, 0, 1, f"phone:{n}:{n + 17}")}
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[1] == ("write <EMAIL> or <CARD>.", 24) and texts[2] == (None, 5) and texts[3] == ("", 0)
    assert pii.find(empty).collect() == [] and pii.redact(empty).collect() == []


def test_grammar_marks():
    s = toxicity.Scorer({"idiot": 1.0, "rotz*": 1.0}, toxicity.PRIOR)
    f = lambda t: dict(zip(toxicity.NAMES, s.features(t)))
    assert f("what an idiot")["I"] == 1 and f("you utter idiot.")["I+target"] == 1 and f("this is not an idiot")["I+not"] == 1
    assert f('he said "what an idiot" again')["I+said"] == 1 and f("i will kill you")["T"] == 1 and f("you i will kill")["T+target"] == 1
    assert f("rotzig idiotic. clean")["I"] == 1 and sum(f("a clean clause; another").values()) == 0
    assert s.score(None) == s.score("") < 0.1 < 0.5 < s.score("you idiot")


def _plain_features(kinds):
    """The grammar read off a clause, word by word: what of the three marks each insult and threat has, the first of said, not and target that holds."""
    out = dict.fromkeys(toxicity.NAMES, 0.0)
    for i, k in enumerate(kinds):
        if k in "IT":
            mark = "said" if "R" in kinds[:i] else "not" if "N" in kinds[max(0, i - 3) : i] else "target" if "Y" in kinds[max(0, i - 3) : i] else ""
            name = f"{k}+{mark}" if mark else k
            if name in out:
                out[name] += 1.0
    return out


def test_grammar_against_a_plain_reading():
    rng = np.random.default_rng(8)
    words = {"I": ["idiot", "moron", "rotzig"], "T": ["kill", "hurt"], "Y": ["you", "they"], "N": ["not", "never"], "R": ["said", "wrote"], "o": ["and", "table", "green", "of"]}
    s = toxicity.Scorer({"idiot": 1.0, "moron": 1.0, "rotz*": 1.0}, toxicity.PRIOR)
    seen = set()
    for _ in range(4_000):
        clauses = [rng.choice(list("ITYNRooo"), rng.integers(1, 12)).tolist() for _ in range(rng.integers(1, 4))]
        text = "; ".join(" ".join(str(rng.choice(words[k])) for k in c) for c in clauses)
        want = dict.fromkeys(toxicity.NAMES, 0.0)
        for c in clauses:
            for name, x in _plain_features(c).items():
                want[name] += x
        assert dict(zip(toxicity.NAMES, s.features(text))) == want, text
        seen |= {n for n, x in want.items() if x}
    assert seen == set(toxicity.NAMES)


def test_scores_of_held_out_documents_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in toxicity.op8_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows)
    toxic = [r for r in rows if labels[r.doc_id]]
    assert len(rows) > 50 and right / len(rows) >= 0.95 and sum(r.predicted for r in toxic) / len(toxic) >= 0.8


def test_toxicity_learns_and_handles_odd_rows(spark, empty):
    rng = np.random.default_rng(0)
    fill = lambda: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in rng.integers(0, 500, 30))
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, f"{fill()} {'quagblat ' if bad else ''}{fill()}."))
        labels.append((i, int(bad)))
    labels += [(None, 1), (5, None), (0, 0), (9999, 1)]
    rows += [(None, "quagblat here"), (1000, None), (1001, ""), (1002, LONG), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "z", 1.0) for r in rows], SCHEMA + ", toxic string, toxic_score double")
    found = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert len(found) == len(rows)
    assert all(r.toxic == int("quagblat" in (r.text or "")) == int(r.toxic_score >= 0.5) for r in found)
    prior = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert prior.weights == toxicity.PRIOR and toxicity.score(empty, prior).collect() == []


def test_kept_text_of_a_copy_is_empty(spark):
    rows = [(1, PASSAGE), (2, PASSAGE), (3, "two words"), (4, "two words")]
    got = {r.doc_id: hashlib.sha256(r.kept_text.encode()).hexdigest() for r in passages.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2] == hashlib.sha256(b"").hexdigest() and got[3] == got[4] == hashlib.sha256(b"two words").hexdigest()


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for n, share in ((40, 0.8), (400, 0.8), (400, 0.5), (20000, 0.8)):
        both = rng.integers(0, 2**64, round(n * share), dtype=np.uint64)
        own = [rng.integers(0, 2**64, (n - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
        x, y = (np.frombuffer(simhash.sketch(np.concatenate([both, o, both[:3]])), np.uint8)[None] for o in own)
        assert abs(simhash.similarity(x, y)[0] - len(both) / (len(both) + sum(map(len, own)))) < 0.06, (n, share)
    none = np.frombuffer(simhash.sketch(np.zeros(0, np.uint64)), np.uint8)[None]
    assert simhash.similarity(none, none)[0] == 1.0 and simhash.similarity(none, x)[0] == 0.0


def test_near_copies_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = []
    for base in range(12):
        words = [f"w{base}x{i}" for i in rng.integers(0, 10**6, 120)]
        texts.append(" ".join(words))
        for changed in (1, 2, 12):
            other = list(words)
            for at in rng.choice(np.arange(5, 115), changed, replace=False):
                other[at] = f"new{at}"
            texts.append(" ".join(other))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    labels = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((labels[i], labels[j]))
                labels = [low if x == high else x for x in labels]
    want = sorted(set(labels))
    assert 12 <= len(want) < len(texts)
    for chunk in (32768, 2):
        monkeypatch.setattr(simhash, "SKETCHES", chunk)
        assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == want, chunk


def test_texts_that_share_what_is_repeated_most_stay(spark):
    def text(k, n):
        return " ".join(f"d{k}n{i * i % 977}x{i}" for i in range(n))

    line = "all rights reserved by the named owner "
    texts = [f"{text(100 * i + k, 80)} {tail}" for i, tail in enumerate((line * 40, line * 100, "| " * 120)) for k in range(20)]
    texts += [texts[3], texts[3] + " " + line]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    want = [i for i, x in enumerate(sets) if not any(len(x & y) >= 0.8 * len(x | y) for y in sets[:i])]
    assert len(want) == 60
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == want


def test_blocks_cut_off_put_on_or_repeated_are_near_copies(spark):
    def words(k, n):
        return [f"e{k}n{i * i % 977}x{i}" for i in range(n)]

    docs = []
    for k in range(40):
        own, n = words(k, 300), 300
        other = [own[: n * 82 // 100], own + words(100 + k, n * 22 // 100), own + own[n // 2 :] * 5, words(200 + k, n * 22 // 100) + own][k % 4]
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in docs}
    assert all(len(sets[i] & sets[i + 1]) >= 0.81 * len(sets[i] | sets[i + 1]) for i in range(0, 80, 2))
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, SCHEMA)).collect())
    assert got == list(range(0, 80, 2))


def test_bands_find_sets_of_the_least_similarity():
    rng = np.random.default_rng(8)
    for n in (4, 16, 400, 4000):
        for _ in range(50):
            whole = rng.integers(0, 2**64, n * 5 // 4, dtype=np.uint64)
            x, y = (np.frombuffer(simhash.lows(s), np.int64) for s in (whole, whole[:n]))
            assert len(x) == len(y) == simhash.BANDS and (x == y).any(), n
    assert simhash.lows(rng.integers(0, 2**64, 3, dtype=np.uint64)) == b""


def test_similarity_close_to_the_threshold_is_settled_by_the_sets(spark):
    docs, over = [], []
    for k in range(120):  # a of 400 shingles, b its first so many words: similarity from 0.79 to 0.81
        words = [f"f{k}n{i * i % 977}x{i}" for i in range(404)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 320 + k % 9]))]
        over.append(316 + k % 9 >= 320)
    want = sorted([2 * k for k in range(120)] + [2 * k + 1 for k, near in enumerate(over) if not near])
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, SCHEMA)).collect()) == want


def test_near_copies_that_share_no_band(spark):
    docs = []
    for at, k in enumerate((131456, 280762, 535064)):  # of 45 and 36 shingles
        words = [f"m{k}n{i}" for i in range(49)]
        docs += [(2 * at, " ".join(words)), (2 * at + 1, " ".join(words[:40]))]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for _, t in docs]
    for x, y in zip(sets[::2], sets[1::2]):
        assert simhash.jaccard(x, y) == 0.8
        assert (simhash.majority(x) ^ simhash.majority(y)).bit_count() <= 8
        assert not (np.frombuffer(simhash.lows(x), np.int64) == np.frombuffer(simhash.lows(y), np.int64)).any()
    docs += [(6, None), (7, "a"), (8, "a b c d e f"), (9, "a b c d e f g")]  # no word, and sets of one, two and three shingles
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, SCHEMA)).collect()) == [0, 2, 4, 6, 7, 8, 9]


def test_probes_of_fingerprints_alone_find_all_near_copies_within_their_radius(spark, monkeypatch):
    rng = np.random.default_rng(12)
    texts = []
    for base in range(60):
        words = [f"p{base}x{i}" for i in rng.integers(0, 10**6, 120)]
        texts += [" ".join(words), " ".join(words[: 119 - 2 * (base % 10)])]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    far = [(simhash.majority(x) ^ simhash.majority(y)).bit_count() > 8 for x, y in zip(sets[::2], sets[1::2])]
    assert 40 <= far.count(False) < 60
    monkeypatch.setattr(simhash, "candidates", lambda classes, sig_bits, scratch: spark.createDataFrame([], "a long, b long"))
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)).collect())
    assert got == sorted([*range(0, 120, 2), *(2 * i + 1 for i, x in enumerate(far) if x)])

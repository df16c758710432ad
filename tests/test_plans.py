"""The compression plan against the same rules in plain Python, on small random documents."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.plans import images

MOST = 100.0


def _up(x):
    return math.floor(x + 0.5)


def _merge(a, b):
    if "NotPlaced" in (a["kind"], b["kind"]):
        drawn = [x for x in (a, b) if x["kind"] != "NotPlaced"]
        return drawn[0] if drawn else {**a, "page": min(a["page"], b["page"])}
    if a["kind"] == b["kind"] == "Measured":
        page = min((min(x["x"], x["y"]), x["page"]) for x in (a, b))[1]
        return {"kind": "Measured", "x": min(a["x"], b["x"]), "y": min(a["y"], b["y"]), "page": page}
    both = a["kind"] == b["kind"] == "TilingPatternOnly"
    return {"kind": "TilingPatternOnly" if both else "Unmeasured", "x": None, "y": None, "page": min(a["page"], b["page"])}


def _image(im, s):
    out = {"w": im["w"], "h": im["h"], "to_w": im["w"], "to_h": im["h"], "action": "Keep", "page": s["page"], "x": s["x"], "y": s["y"], "mask": im["mask"], "soft": False}
    if s["kind"] == "NotPlaced":
        return {**out, "skip": "NoPlacement", "page": None, "x": None, "y": None}
    if im["skip"] or s["kind"] != "Measured":
        return {**out, "skip": im["skip"] or {"TilingPatternOnly": "TilingPatternOnly", "Unmeasured": "UnmeasuredPlacement"}[s["kind"]]}
    if min(s["x"], s["y"]) > MOST * 1.5:
        for n, d in (("w", "x"), ("h", "y")):
            out[f"to_{n}"] = max(1, min(im[n], _up(im[n] * MOST / s[d]))) if s[d] > MOST else im[n]
    less = out["to_w"] < im["w"] or out["to_h"] < im["h"]
    return {**out, "skip": "None", "action": "Downsample" if less else "Keep"}


def _mask(m, users):
    users = [u for u in users if u["skip"] != "NoPlacement"]
    out = {"w": m["w"], "h": m["h"], "to_w": m["w"], "to_h": m["h"], "action": "Keep", "page": users[0]["page"] if users else None, "x": None, "y": None, "mask": None, "soft": True}
    if not users or m["skip"]:
        return {**out, "skip": m["skip"] if users else "NoPlacement"}
    sizes, best = {"w": 0, "h": 0}, None
    for u in users:
        for n in "wh":
            follow = max(1, min(m[n], _up(m[n] * u[f"to_{n}"] / u[n]))) if u["action"] == "Downsample" else m[n]
            sizes[n] = max(sizes[n], follow)
        if u["x"] is not None:
            x, y = u["x"] * m["w"] / u["w"], u["y"] * m["h"] / u["h"]
            if best is None or min(x, y) < min(best):
                out["page"] = u["page"]
            best = (x, y) if best is None else (min(x, best[0]), min(y, best[1]))
    out |= {"to_w": sizes["w"], "to_h": sizes["h"], "skip": "None"}
    if best:
        out |= {"x": best[0], "y": best[1]}
    return {**out, "action": "Downsample" if sizes["w"] < m["w"] or sizes["h"] < m["h"] else "Keep"}


def _plan(ims, masks, summaries, aliases):
    held, dropped = dict(aliases), 0
    while True:
        folded = {}
        for i in sorted(summaries):
            to = held.get(i, i)
            folded[to] = _merge(folded[to], summaries[i]) if to in folded else summaries[i]
        plans = {i: _image(ims[i], folded[i]) for i in sorted(folded) if i in ims}
        soft = {m: _mask(v, [plans[i] for i in sorted(plans) if plans[i]["mask"] == m]) for m, v in masks.items()}
        every, bad = plans | soft, []
        for a, c in held.items():
            one, other = every.get(a), every.get(c)
            if one is None and a in summaries:
                continue
            kept = [p is None or p["action"] == "Keep" for p in (one, other)]
            if any(kept) and all(kept):
                continue
            if any(kept) or any(one[k] != other[k] for k in ("action", "to_w", "to_h", "soft")):
                bad.append(a)
        if not bad:
            return {i: {**p, "mask": held.get(p["mask"], p["mask"])} for i, p in every.items() if i not in held}, held, dropped
        dropped += len(bad)
        held = {a: c for a, c in held.items() if a not in bad}


@pytest.mark.parametrize("seed", range(3))
def test_plan_against_plain_python(spark, seed):
    r = random.Random(seed)
    kinds = ("Measured", "Measured", "Measured", "TilingPatternOnly", "Unmeasured", "NotPlaced")
    masks = {100 + i: {"w": r.randint(20, 90), "h": r.randint(20, 90), "skip": r.choice((None, None, "DecodeFailed"))} for i in range(10)}
    for m in range(105, 110):
        masks[m] = {**masks[m - 5]}
    masks[100] = masks[105] = {"w": 80, "h": 80, "skip": None}  # copies that their images reduce differently: no copies in the end
    ims = {i: {"w": r.randint(1, 400), "h": r.randint(1, 400), "skip": r.choice((None,) * 4 + ("ImageMask",)), "mask": r.choice((None, 101, 102, 103, 104, 106, 107, 108, 109))} for i in range(60)}
    summaries = {}
    for i in ims:
        kind = r.choice(kinds)
        x, y = (r.choice((72.0, 150.0, 151.0, 200.0, 300.0, 450.0)) for _ in "xy")
        summaries[i] = {"kind": kind, "x": x if kind == "Measured" else None, "y": y if kind == "Measured" else None, "page": r.randint(0, 9)}
    for i, m, d in ((200, 100, 72.0), (201, 105, 450.0)):
        ims[i], summaries[i] = {"w": 300, "h": 300, "skip": None, "mask": m}, {"kind": "Measured", "x": d, "y": d, "page": 0}
    aliases = {}
    for i in range(30, 60):
        if r.random() < 0.5:
            aliases[i] = i - 30
            ims[i] = {**ims[i - 30]}
    aliases |= {m: m - 5 for m in range(105, 110) if masks[m] == masks[m - 5]}
    want, held, dropped = _plan(ims, masks, summaries, aliases)
    frames = (
        spark.createDataFrame([(i, v["w"], v["h"], v["skip"], v["mask"]) for i, v in ims.items()], "image long, w int, h int, skip string, mask long"),
        spark.createDataFrame([(i, v["w"], v["h"], v["skip"]) for i, v in masks.items()], "image long, w int, h int, skip string"),
        spark.createDataFrame([(i, v["x"], v["y"], v["page"], v["kind"]) for i, v in summaries.items()], "image long, dpi_x double, dpi_y double, page int, kind string"),
        spark.createDataFrame(list(aliases.items()), "image long, canonical long"),
    )
    plans, left = images.plan(*frames, MOST)
    got = {x.image: x for x in plans.collect()}
    assert {x.image: x.canonical for x in left.collect()} == held
    assert set(got) == set(want)
    for i, p in want.items():
        x = got[i]
        assert (x.action, x.skip, x.to_w, x.to_h, x.soft, x.mask, x.page) == (p["action"], p["skip"], p["to_w"], p["to_h"], p["soft"], p["mask"], p["page"]), (i, p, x)
        assert (x.dpi_x is None) == (p["x"] is None) and (p["x"] is None or (abs(x.dpi_x - p["x"]) < 1e-9 and abs(x.dpi_y - p["y"]) < 1e-9))
    assert dropped


def test_borrowed_ratio_prefers_the_same_kind_then_encoding_then_outcome(spark):
    have = [(True, "Jpeg", "Reencoded", "Jpeg", 1, 1.0), (False, "Flate", "Reencoded", "Jpeg", 2, 2.0), (False, "Flate", "Downsampled", "Flate", 3, 3.0), (False, "Lzw", "Reencoded", "Jpeg", 4, 4.0)]
    wanted = [(False, "Jpeg", "Reencoded", "Jpeg"), (True, "Lzw", "Downsampled", "Jpeg"), (False, "Flate", "Downsampled", "Jpeg"), (False, "Raw", "Reencoded", "Jpeg2000")]
    found = spark.createDataFrame(have, "soft boolean, before_encoding string, outcome string, after_encoding string, place int, ratio double")
    groups = spark.createDataFrame(wanted, "soft boolean, before_encoding string, outcome string, after_encoding string")
    got = {(r.soft, r.before_encoding, r.outcome): r.ratio for r in images.borrowed(groups, found).collect()}
    assert got == {(False, "Jpeg", "Reencoded"): 2.0, (True, "Lzw", "Downsampled"): 1.0, (False, "Flate", "Downsampled"): 3.0, (False, "Raw", "Reencoded"): None}


def test_a_wide_range_costs_two_rows(spark):
    from quire.operators import layout

    ranges = spark.createDataFrame([(0, 10**12, 7), (5, 5, 1), (9, 3, 0)], "low long, high long, base long")
    codes = spark.createDataFrame([(5,), (10**12,), (-1,)], "code long")
    got = sorted(map(tuple, layout.range_lookup(codes, ranges, "code").select("code", "low", "value").collect()))
    assert got == [(5, 0, 12), (5, 5, 1), (10**12, 0, 10**12 + 7)]
    assert layout.range_lookup(codes, ranges.where(F.lit(False)), "code").collect() == []


def test_headers_are_repeated_and_tall_items_are_errors(spark):
    from quire.operators import layout

    def pages(items, page=50.0):
        frame = spark.createDataFrame([([float(h) for h, *_ in items], [x for _, x, _ in items], [t for *_, t in items])], "h array<double>, x array<boolean>, t array<int>")
        return [tuple(r) for r in frame.select(layout.paginate_rows(F.col("h"), F.col("x"), F.col("t"), page, 2.0).alias("p")).first().p]

    rows = [(10, True, 1), (20, False, 1), (20, False, 1), (5, True, 2), (30, False, 2), (30, False, None), (1, False, None)]
    assert pages(rows) == [(0, 0.0), (0, 0.0), (1, 10.0), (1, 0.0), (2, 5.0), (3, 0.0), (3, 0.0)]
    for bad in ([(60, False, None)], [(30, True, 1), (10, False, 1), (30, False, 1)]):
        with pytest.raises(Exception, match="doesn't fit"):
            pages(bad)

"""The pipeline on a small corpus: every stage's decisions hold in what is left."""

import re

import numpy as np

import __spark_entry__


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    def text(k, n=60):
        return " ".join(f"t{k}w{i * i % 97}x{i}" for i in range(n))

    item = " ".join(f"leak{i}" for i in range(20))
    docs = [(i, text(i), "en", "abc"[i % 3], 1) for i in range(40)]
    docs += [(100, text(1), "en", "a", 1), (101, text(2).replace("x30", "changed"), "en", "a", 1), (102, text(50) + " " + item, "en", "b", 1)]
    docs += [(103, text(60) + " you idiot moron", "en", "c", 1), (104, text(70) + " mail bo@mail3.example.com", "en", "c", 1), (105, None, "en", None, 0), (None, text(80), None, "a", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "redact_pii", "mix"]
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = {"toxicity": {103}, "near_dedup": {100, 101}, "decontaminate": {102}, "redact_pii": set()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        before, after = {r.doc_id for r in frame.collect()}, {r.doc_id for r in out.collect()}
        assert before - after == gone[name], name
        frame = spark.createDataFrame(out.collect(), frame.schema)
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} <= {r[0] for r in docs} - {100, 101, 102, 103}
    assert all("<EMAIL>" in r.text for r in mixed if r.doc_id == 104)
    assert [r.mix_position for r in mixed] == sorted(r.mix_position for r in mixed)


def _shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _leaks(text, items):
    """Whether 11 of 13 tokens (or that share of a shorter item) stand in one line, by trying every place."""
    w = re.findall(r"[^\W_]+", text.lower())
    for item in items:
        for a in range(len(item) - min(13, len(item)) + 1):
            run = item[a : a + 13]
            least = -(-len(run) * 11 // 13)
            if any(sum(0 <= p + k < len(w) and w[p + k] == x for k, x in enumerate(run)) >= least for p in range(-2, len(w))):
                return True
    return False


def test_run_against_brute_force(spark, tmp_path):
    """Every stage done again in plain Python (the mixture in SQL) on what the stage before left, against what run() returns."""
    import duckdb

    import corpus_pipeline
    from quire.llm import mixture, pii, toxicity

    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(900)]
    item = [f"leak{i}" for i in range(30)]
    texts = []
    for i in range(260):
        w = [str(x) for x in rng.choice(vocabulary, rng.integers(20, 90))]
        kind = i % 13
        if kind == 1 and texts:
            w = texts[int(rng.integers(0, len(texts)))].split()
        if kind == 2 and texts:
            w = texts[int(rng.integers(0, len(texts)))].split()
            w[len(w) // 2] = "changed"
        if kind == 3:
            w += ["you", "idiot", "moron"]
        if kind == 4:
            w += item[5 : 5 + int(rng.integers(9, 20))]
        if kind == 5:
            part = item[3:16]
            part[4] = part[9] = "other"
            w = [*w, *part, "end"]
        if kind == 6:
            w += ["call", "+1", "(017)", "555-7713", "or", f"bo{i}@mail.example.com"]
        texts.append(" ".join(w))
    docs = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(texts)] + [(1000, None, "en", None, 0), (1001, "", "en", "a", 0), (7, texts[7], "en", "b", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item).upper()), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 13 == 3)) for i in range(0, 260, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    scorer = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    left = [d for d in docs if scorer.score(d[1]) < 0.5]
    assert 15 <= len(docs) - len(left) <= 25
    sets, group = [_shingles(d[1] or "") for d in left], list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if group[i] != group[j] and (left[i][0] == left[j][0] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                low, high = sorted((group[i], group[j]))
                group = [low if x == high else x for x in group]
    kept: dict = {}
    for d, g in zip(left, group):
        if g not in kept or d[0] < kept[g][0]:
            kept[g] = d
    assert 20 <= len(left) - len(kept) <= 60
    clean = [d for d in kept.values() if not _leaks(d[1] or "", [item])]
    assert 15 <= len(kept) - len(clean) <= 45
    weights = pii.tagger().ready()
    final = [(d[0], None if d[1] is None else pii.redacted(d[1], pii.spans(weights, [d[1]])[0][1]), d[2], d[3]) for d in clean]
    assert sum("<EMAIL>" in (t or "") for _, t, *_ in final) >= 10
    frame = spark.createDataFrame(final, "doc_id long, text string, lang string, source string").toPandas()
    frame.to_parquet(f"{tmp_path}/final.parquet")
    want = {r[0]: r[4] for r in duckdb.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixture.OP6_SQL.replace('FROM documents', f"FROM '{tmp_path}/final.parquet'")})").fetchall()}
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    taken: dict = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.mix_words
    assert taken == {k: v for k, v in want.items() if v}
    by_id = {d[0]: d for d in final}
    assert all((r.text, r.lang, r.source) == by_id[r.doc_id][1:] for r in mixed)
    assert [r.mix_position for r in mixed] == sorted(r.mix_position for r in mixed)


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)}

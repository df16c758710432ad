"""Operator 8: toxicity by a weighted finite-state grammar of insult, threat, target, negation and reported speech."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table
from .transducers import within

# The grammar's words in English, German, French and Spanish. A word ending in * stands for all that begin so.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid loser losers scum scumbag trash worthless pathetic disgusting clown clowns imbecile imbeciles dumb fool fools "
    "jerk creep freak vermin filth filthy pig pigs garbage retard ugly "
    "idioten dumm dumme dummkopf trottel depp abschaum versager widerlich erbärmlich wertlos arschloch "
    "imbécile imbéciles crétin crétins abruti stupide ordure minable dégoûtant salaud connard "
    "idiota idiotas estúpido estúpida imbécil basura asqueroso patético escoria payaso inútil cabrón"
).split()
THREATS = "kill hurt destroy beat stab shoot strangle crush punish murder töten umbringen vernichten schlagen tuer frapper détruire écraser matar golpear destruir aplastar".split()
TARGETS = "you your yours yourself u he she they him her them these those people du dich dir ihr euch sie er ihn tu toi vous il elle ils elles tú usted ustedes él ella ellos ellas".split()
NEGATIONS = "not never isn't aren't wasn't don't doesn't nobody kein keine nicht nie niemals pas jamais nunca jamás".split()
REPORTS = "said says say quoted quote quotes called wrote reported reportedly allegedly sagte sagt nannte schrieb zitierte dit disait appelé écrit dijo dice llamó escribió".split()
#: Kinds that give a score, and what is known of a match before any label is seen.
SCORED = frozenset("IT")
PRIOR = {"bias": -3.0, "I": 5.0, "I+target": 6.0, "I+not": 1.0, "I+said": 1.5, "T+target": 4.0, "T": 0.5}
#: Each feature is of scored matches: their number by kind and marks, weighed by the word's strength.
NAMES = ("I", "I+target", "I+not", "I+said", "T", "T+target")
CLAUSE = re.compile(r"[.!?;:\n\"“”«»()|]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

#: Labelled documents, least by hash of their id, from which words and weights are learned; texts are whole.
TRAIN_DOCS = 20_000
#: Contexts in which a learned word must stand in toxic documents, and its least share of toxic contexts.
LEAST, SHARE = 8, 0.9
#: Different words that a stem must stand for.
STEM_WORDS = 5
#: Lengths of the beginnings of words that are tried as patterns.
STEMS = (3, 4, 5, 6, 7)


def grammar():
    """Composition of reported speech, negation (three words) and target (three words): marks on insults and threats."""
    machine = within("R", 0, "said", SCORED) @ within("N", 3, "not", SCORED) @ within("Y", 3, "target", SCORED)
    return machine.compiled([(k, frozenset()) for k in "ITYNRo"])


class Scorer:
    """patterns: word or stem* to strength (0 to 1 and above); weights: by feature name, and bias."""

    def __init__(self, patterns: dict[str, float], weights: dict[str, float]):
        self.patterns, self.weights = patterns, weights
        self._ready = None

    def __getstate__(self):
        return {"patterns": self.patterns, "weights": self.weights, "_ready": None}

    def _set_up(self):
        import ahocorasick

        kinds = {w: "Y" for w in TARGETS} | {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS} | {w: "T" for w in THREATS}
        search = ahocorasick.Automaton()
        for w in self.patterns:
            search.add_word(w.rstrip("*"), 1)
        for w in THREATS:
            search.add_word(w, 1)
        search.make_automaton()
        stems = sorted({len(w) - 1 for w in self.patterns if w.endswith("*")})
        self._ready = kinds, search, stems, *grammar()

    def kind(self, word: str, kinds, stems) -> tuple[str, float]:
        best = self.patterns.get(word, 0.0)
        for n in stems:
            best = max(best, self.patterns.get(word[:n] + "*", 0.0) if len(word) >= n else 0.0)
        return ("I", best) if best else (kinds.get(word, "o"), 1.0)

    def features(self, text: str | None) -> list[float]:
        """Strengths of matched insults and threats by kind and marks; clauses without a scored word give nothing."""
        if self._ready is None:
            self._set_up()
        kinds, search, stems, go, put = self._ready
        out = dict.fromkeys(NAMES, 0.0)
        low = (text or "").lower()
        done = -1
        for end, _ in search.iter(low):
            if end < done:
                continue
            start = _clause_start(low, end)
            stop = CLAUSE.search(low, end)
            done = stop.start() if stop else len(low)
            quoted = start > 0 and low[start - 1] in "\"“«"
            state = 0
            if quoted and _reported(low, start - 1):
                state = go[state]["R", frozenset()]
            for m in TOKEN.finditer(low, start, done):
                kind, strength = self.kind(m[0], kinds, stems)
                symbol = (kind, frozenset())
                state, (kind, marks) = go[state][symbol], put[state][symbol]
                if kind in SCORED:
                    name = "said" if "said" in marks else "not" if "not" in marks else "target" if "target" in marks else ""
                    name = f"{kind}+{name}" if name else kind
                    if name in out:
                        out[name] += strength
        return [out[n] for n in NAMES]

    def score(self, text: str | None) -> float:
        return logistic(self.weights["bias"] + sum(self.weights[n] * squash(x) for n, x in zip(NAMES, self.features(text))))


def squash(x):
    """Strengths count in full up to 1, and less and less above."""
    return np.minimum(x, 1 + np.log(np.maximum(x, 1)))


def logistic(x):
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _clause_start(low: str, end: int) -> int:
    """Where the clause that holds place end begins."""
    at = end
    while at > 0:
        piece = max(0, at - 200)
        cuts = [m.end() for m in CLAUSE.finditer(low, piece, at)]
        if cuts:
            return cuts[-1]
        at = piece
    return 0


def _reported(low: str, quote: int) -> bool:
    """Whether the clause before a quotation mark ends in a word of reporting (within its last three words)."""
    words = TOKEN.findall(low[max(0, quote - 60) : quote])
    return any(w in REPORTS for w in words[-3:])


# --- learning -----------------------------------------------------------------------------------


def held_out(doc_id):
    """A fifth of all documents, by the CRC-32 of their id as text. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = TRAIN_DOCS) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled documents that are not held out, as a written table; equal texts once.

    A document with several labels is toxic if one of them says so; null ids and labels are left out.
    The ids, a bounded number, are broadcast.
    """
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = ids.where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(scratch.keep(ids)), "doc_id")
    return scratch.keep(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))


def learned_patterns(train: DataFrame) -> dict[str, float]:
    """Words and stems that stand almost only in toxic texts, with their strength.

    Counts are of distinct contexts (the word before and the word after), so that copies of a passage
    count once. A stem stands for the words that begin with it, where no shorter stem is found. The words of at most TRAIN_DOCS texts are
    counted, and each found takes LEAST contexts, so that what is gathered here is bounded.
    """
    words = train.select("toxic", F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}']+", " ")), " ").alias("w"))
    spots = F.expr("transform(w, (x, i) -> struct(x AS word, xxhash64(get(w, i - 1), get(w, i + 1)) AS context))")
    spots = words.select("toxic", F.explode(spots).alias("s")).select("toxic", "s.word", "s.context").distinct()
    counts = spots.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = counts.where("length(word) > 2")
    stems = F.concat(*[F.when(F.length("word") > n, F.array(F.substring("word", 1, n))).otherwise(F.array()) for n in STEMS])
    stems = counts.select(F.explode(stems).alias("word"), "t", "c").groupBy("word")
    stems = stems.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("n"))
    good = (F.col("t") >= LEAST) & (F.col("t") >= SHARE * (F.col("t") + F.col("c")))
    words = counts.where(good).select("word", "t", "c", F.lit(False).alias("stem"))
    found = stems.where(good & (F.col("n") >= STEM_WORDS)).select("word", "t", "c", F.lit(True).alias("stem")).union(words)
    rows = found.collect()
    out: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (not r["stem"], len(r["word"]), r["word"])):
        word = r["word"]
        if not any(word[:n] + "*" in out for n in STEMS if n <= len(word)):
            out[word + "*" * r["stem"]] = (r["t"] - 0.5) / (r["t"] + r["c"] + 1)
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 2.0) -> dict[str, float]:
    """Weights of a logistic regression, drawn towards PRIOR; without labels the prior itself."""
    prior = np.array([PRIOR["bias"], *[PRIOR[n] for n in NAMES]])
    w = prior.copy()
    if len(y):
        a = np.column_stack([np.ones(len(y)), squash(x)])

        def loss(w):
            z = a @ w
            return (np.logaddexp(0, z) - y * z).sum() + strength / 2 * ((w - prior) ** 2).sum()

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
            g = a.T @ (p - y) + strength * (w - prior)
            h = (a * (p * (1 - p))[:, None]).T @ a + strength * np.eye(len(w))
            step, now, size = np.linalg.solve(h, g), loss(w), 1.0
            while loss(w - size * step) > now and size > 1e-6:  # Newton's step, halved until the loss falls
                size /= 2
            w = w - size * step
    return dict(zip(["bias", *NAMES], w.tolist()))


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, most: int = TRAIN_DOCS) -> Scorer:
    """A scorer from the labelled documents that are not held out. Without any, the fixed words and weights hold."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = training_rows(docs, labels, scratch, most)
    patterns = dict.fromkeys(INSULTS, 1.0) | learned_patterns(rows)
    scorer = Scorer(patterns, PRIOR)

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            found = [scorer.features(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], names=["toxic", *[f"f{i}" for i in range(len(NAMES))]])

    schema = "toxic int, " + ", ".join(f"f{i} double" for i in range(len(NAMES)))
    got = rows.select("toxic", "text").mapInArrow(measure, schema).groupBy(*[f"f{i}" for i in range(len(NAMES))], "toxic").count().toPandas()
    got = got.sort_values(list(got.columns)).reset_index(drop=True)
    x = got[[f"f{i}" for i in range(len(NAMES))]].to_numpy(float)
    n = got["count"].to_numpy(int) if len(got) else np.zeros(0, int)
    return Scorer(patterns, fit_weights(np.repeat(x, n, axis=0), np.repeat(got["toxic"].to_numpy(float), n)))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic (1 if the score is 0.5 or more), from the whole text alone.

    Null and empty texts have the score of no match. Every row stays, with its columns; columns of these two names
    are replaced. No rows give no rows. A text is searched once for the lexicon's words; only clauses that hold one
    go through the grammar.
    """
    keep = [c for c in docs.columns if c not in ("toxic_score", "toxic")]
    docs = docs.select(*keep)
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [scorer.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=[*batch.schema.names, "toxic_score", "toxic"],
            )

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, scorer).select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").alias("predicted")
    )

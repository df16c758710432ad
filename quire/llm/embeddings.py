"""Operator 3: embedding near-dedup by an exact metric range join around pivots."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forest, table
from .components import components

#: Least cosine of a link.
COSINE = 0.98
#: Vectors a cell is meant to have, the most pivots of a label, and of all; a cell with more than CHUNK vectors is joined in blocks.
CELL, PIVOTS, ALL_PIVOTS, CHUNK = 2_000, 512, 8_192, 4_096
#: Slack, in radians, for the rounding of angles when a vector's cells are chosen.
SLACK = 1e-6

UNIT = "vec_id long, label string, key binary, unit binary"


def _units(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, key, unit): unit is the vector over its norm, key a digest of the vector and label; null where it can't link."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            rows: list[tuple] = []
            ids, labels = batch.column("vec_id").cast(pa.int64()).to_pylist(), batch.column("label").to_pylist()
            for i, label, v in zip(ids, labels, batch.column("embedding").to_pylist()):
                fit = i is not None and label is not None and v and None not in v
                x = np.array(v if fit else [0.0], np.float64) + 0.0  # -0.0 is 0.0
                scale = np.abs(x).max()
                if not (np.isfinite(x).all() and scale):
                    rows.append((i, label, None, None))
                    continue
                y = x / scale
                y /= math.sqrt(float(y @ y))
                rows.append((i, label, hashlib.blake2b(x.tobytes() + label.encode(), digest_size=16).digest(), y.tobytes()))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                names=["vec_id", "label", "key", "unit"],
            )

    return vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label")).mapInArrow(run, UNIT)


def pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k of the sample's unit vectors, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        i = int(near.argmin())
        chosen.append(i)
        near = np.maximum(near, sample @ sample[i])
    return sample[chosen]


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


PLACED = "label string, cell long, home boolean, node long, key binary, weight long, unit binary"


def _chosen(classes: DataFrame, cell: int, most: int) -> dict[tuple[str, int], np.ndarray]:
    """Pivots by (label, dimension), for labels of more classes than a cell is meant to have: one for each so many, up to most.

    Only equal labels meet, so a label's pivots are taken from its own vectors: of those with the least hashes, four for each pivot. At most
    ALL_PIVOTS labels (the largest) get pivots, and at most so many pivots stand in all, whatever the number of vectors.
    """
    counts = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).orderBy(F.desc("n"), "label").limit(ALL_PIVOTS)
    wanted = {r.label: min(most, math.ceil(r.n / cell)) for r in counts.collect()}
    if not wanted:
        return {}
    over = max(1.0, sum(wanted.values()) / ALL_PIVOTS)
    wanted = {label: max(1, int(k / over)) for label, k in wanted.items()}
    sizes = {r.label: r.n for r in counts.collect()}
    shares = classes.sparkSession.createDataFrame([(x, min(1.0, 8 * k / sizes[x])) for x, k in wanted.items()], "label string, share double")
    h = F.xxhash64("key")
    drawn = classes.join(F.broadcast(shares), "label").where((F.shiftrightunsigned(h, 11) / float(1 << 53)) < F.col("share"))
    by: dict[tuple[str, int], list] = {}
    for r in drawn.select("label", "unit", h.alias("h"), "key").collect():
        by.setdefault((r.label, len(r.unit) // 8), []).append((r.h, bytes(r.key), bytes(r.unit)))
    return {at: pivots(_matrix([u for _, _, u in sorted(rows)[: 4 * wanted[at[0]]]]), wanted[at[0]]) for at, rows in by.items()}


def _cells(classes: DataFrame, chosen: dict[tuple[str, int], np.ndarray], angle: float) -> DataFrame:
    """A row of each class in its home cell (the nearest pivot's) and in every cell where a link may need it.

    If p and q are within the angle, p's angle to q's pivot is by the triangle inequality at most that to its own pivot
    plus twice the angle; a cell further than that needs no copy of p. The bisecting plane between the two
    pivots gives a nearer bound of the same kind (q lies beyond it, so p is within the angle of it).
    Vectors of a label and dimension without pivots share one cell.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = np.array([len(x) // 8 for x in batch.column("unit").to_pylist()], np.int64)
            labels = np.array(batch.column("label").to_pylist(), object)
            alone = np.ones(len(dims), bool)
            rows, cells, homes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for label, dim in {x for x in zip(labels.tolist(), dims.tolist()) if x in chosen}:
                mine = (labels == label) & (dims == dim)
                alone &= ~mine
                at, p = np.flatnonzero(mine), chosen[label, dim]
                x = _matrix(batch.column("unit").take(pa.array(at)).to_pylist())
                cos = np.clip(x @ p.T, -1, 1)
                own = cos.argmax(axis=1)
                best = cos[np.arange(len(at)), own][:, None]
                gap = np.sqrt(np.maximum(2 - 2 * np.clip(p @ p.T, -1, 1), 0))[own]  # between the pivots
                beyond = (best - cos) / np.maximum(gap, 1e-12)  # distance from the bisecting plane
                near = (np.arccos(cos) <= np.arccos(best) + 2 * angle + SLACK) & (beyond <= math.sin(angle) + SLACK)
                near[np.arange(len(at)), own] = True
                row, cell = np.nonzero(near)
                rows.append(at[row]), cells.append(cell), homes.append(cell == own[row])
            at = np.flatnonzero(alone)
            rows.append(at), cells.append(np.zeros(len(at), np.int64)), homes.append(np.ones(len(at), bool))
            row, cell, home = np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)
            take = batch.take(pa.array(row))
            cell = cell + PIVOTS * 2 * dims[row]  # vectors of unequal dimension never meet
            yield pa.RecordBatch.from_arrays(
                [take.column("label"), pa.array(cell), pa.array(home), *[take.column(c) for c in ("node", "key", "weight", "unit")]],
                names=[c.split()[0] for c in PLACED.split(", ")],
            )

    return classes.select("label", "node", "key", "weight", "unit").mapInArrow(run, PLACED)


FOUND = "key binary, node long, links long, other long"


def _join(cosine: float):
    """One block of home vectors against one block of a cell: links of each home vector, and a spanning forest."""

    def run(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        left, right = t.filter(t.column("side")), t.filter(pc.invert(t.column("side")))
        names = ["key", "node", "links", "other"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.binary()), *[pa.array([], pa.int64())] * 3], names=names)
        x, y = _matrix(left.column("unit").to_pylist()), _matrix(right.column("unit").to_pylist())
        a, b = left.column("node").to_numpy(), right.column("node").to_numpy()
        weight = right.column("weight").to_numpy()
        kx, ky = np.array(left.column("key").to_pylist(), object), np.array(right.column("key").to_pylist(), object)
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        pa_, pb_ = places[: len(a)], places[len(a) :]
        labels, links = np.arange(len(nodes)), np.zeros(len(a), np.int64)
        for s in range(0, len(x), 256):
            near = x[s : s + 256] @ y.T >= cosine
            p, q = np.nonzero(near)
            same = kx[p + s] == ky[q]
            p, q = p[~same] + s, q[~same]
            np.add.at(links, p, weight[q])
            forest(labels, pa_[p], pb_[q])
        root = labels != np.arange(len(nodes))
        count = links > 0
        return pa.table(
            [
                pa.array([*kx[count], *[None] * int(root.sum())], pa.binary()),
                pa.array(np.concatenate([a[count], nodes[root]])),
                pa.array([*links[count].tolist(), *[None] * int(root.sum())], pa.int64()),
                pa.array([*[None] * int(count.sum()), *nodes[labels[root]].tolist()], pa.int64()),
            ],
            names=names,
        )

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, most: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of vectors (vec_id, embedding, label).

    Two vectors of equal label that isn't null link if their cosine, in double precision, is cosine or more.
    Vectors that are null, empty, zero, or hold a null or a non-finite component, and rows without an id link with
    nothing: 0 links, their own component (null without an id), kept (false without an id). Vectors of unequal
    dimension don't link. Rows that repeat an id are vectors of their own in n_links but one in component_id. No rows
    give no rows. Equal vectors of a label meet first as one class with a weight, so a third of all rows that are
    copies costs one row; links between classes are counted, not listed, and leave a task as a forest.

    Pivots are picked on the driver, a label's from its own vectors (a documented, bounded sample, which decides
    the cells' shape, not the result).
    """
    scratch = Scratch(vectors.sparkSession)
    angle = math.acos(cosine)
    units = scratch.keep(_units(vectors))
    classes = scratch.keep(
        units.where("key IS NOT NULL").groupBy("label", "key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.any_value("unit").alias("unit"))
    )
    placed = scratch.keep(_cells(classes, _chosen(classes, cell, most), angle))
    sizes = placed.groupBy("label", "cell").agg(
        F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("blocks"), F.ceil(F.count_if("home") / chunk).cast("int").alias("homes")
    )
    sized = placed.join(scratch.keep(sizes), ["label", "cell"])
    columns = ["label", "cell", "node", "key", "weight", "unit"]
    homes = sized.where("home").select(
        *columns, F.pmod(F.xxhash64("key"), F.col("homes")).cast("int").alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"), F.lit(True).alias("side")
    )
    all_ = sized.where("homes > 0").select(
        *columns, F.explode(F.expr("sequence(0, homes - 1)")).alias("i"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int").alias("j"), F.lit(False).alias("side")
    )
    found = scratch.keep(homes.union(all_).groupBy("label", "cell", "i", "j").applyInArrow(_join(cosine), FOUND))
    links = found.where("links IS NOT NULL").groupBy("key").agg(F.sum("links").alias("links"))
    edges = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    again = units.where("key IS NOT NULL").groupBy("vec_id").count().where("count > 1").select("vec_id")
    again = units.join(again, "vec_id").join(classes.select("key", "node"), "key").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    joined = components(edges.union(again), scratch)
    classes = classes.select("label", "key", "node", "weight").join(links, "key", "left").join(joined, "node", "left")
    classes = scratch.keep(classes.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "node").alias("c")))
    return units.join(classes, "key", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("c", "vec_id"), F.lit(False)).alias("kept"),
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs of a label, then what links reach.
OP3_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e FROM embeddings
), u AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(n)) AS e FROM (SELECT *, list_sum(list_transform(e, lambda x: x * x)) AS n FROM v WHERE e IS NOT NULL) WHERE n > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""

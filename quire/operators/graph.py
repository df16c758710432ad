"""Trees and reference graphs: flattening with inheritance, names, reachability, promotion, pruning, dedup to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import kept

#: Levels of a tree that are walked; a deeper one is an error.
DEPTH = 256


def flatten(nodes: DataFrame, inherit: list[str], depth: int = DEPTH) -> DataFrame:
    """nodes (node, parent, pos, inherited columns) with level, path (sort key: positions from the root), and ancestors' values where a node's own is null.

    Walks level by level from the roots (parent null); each level is one equi-join. A node that no root reaches (a cycle, a missing parent) has no row.
    A tree of more than depth levels is an error.
    """
    cols = ["node", "parent", "pos", *inherit]
    level = nodes.where("parent IS NULL").select(*cols, F.lit(0).alias("level"), F.array(F.col("pos").cast("long")).alias("path"))
    out = level
    rest = nodes.where("parent IS NOT NULL").select(*cols)
    for k in range(1, depth + 1):
        up = level.select(F.col("node").alias("_n"), F.col("path").alias("_p"), *[F.col(c).alias(f"_{c}") for c in inherit])
        level = rest.join(up, F.col("parent") == F.col("_n")).select(
            "node", "parent", "pos", *[F.coalesce(c, f"_{c}").alias(c) for c in inherit], F.lit(k).alias("level"), F.concat("_p", F.array(F.col("pos").cast("long"))).alias("path")
        )
        level = kept(level)
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError(f"more than {depth} levels")


def reachable(roots: DataFrame, edges: DataFrame, most: int = 1_000) -> DataFrame:
    """(node): all that edges (src, dst) reach from roots (node), with the roots. Frontier by frontier; most rounds."""
    seen = roots.select("node").distinct()
    frontier = seen
    for _ in range(most):
        step = edges.join(frontier, edges["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).where("node IS NOT NULL").distinct()
        frontier = kept(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = kept(seen.union(frontier))
    raise RuntimeError("more rounds than allowed")


def promote(nodes: DataFrame, keep: str, depth: int = DEPTH) -> DataFrame:
    """(node, parent, path): kept nodes under their nearest kept ancestor (null at the top), in the order of the tree before.

    Children of a dropped node thus stand where it stood. nodes: (node, parent, pos, keep flag).
    """
    marked = nodes.withColumn("_anchor", F.when(F.col(keep), F.col("node")))
    flat = flatten(marked, ["_anchor"], depth)
    up = flat.select(F.col("node").alias("_u"), F.col("_anchor").alias("_above"))
    kept = flat.join(nodes.where(keep).select("node"), "node", "left_semi")
    return kept.join(up, kept["parent"] == up["_u"], "left").select("node", F.col("_above").alias("parent"), "path")


def prune(nodes: DataFrame, removed: str, depth: int = DEPTH) -> DataFrame:
    """(node): nodes that stay when a leaf flagged removed goes, and a node all of whose children go goes too, from the leaves up."""
    flat = flatten(nodes.withColumn("_f", F.col(removed)), ["_none"] if "_none" in nodes.columns else [], depth)
    flat = flat.join(nodes.select("node", F.col(removed).alias("_gone")), "node")
    leaves = flat.join(nodes.select(F.col("parent").alias("_p")).distinct(), F.col("node") == F.col("_p"), "left_anti").where("NOT _gone")
    parents = flat.select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    return reachable(leaves.select("node"), parents, depth)


def dedup_fixpoint(objects: DataFrame, refs: DataFrame, rounds: int = 50) -> DataFrame:
    """(obj, canonical): objects that are equal once equal children count as one, under the smallest number.

    objects (obj, payload); refs (src, pos, dst). Each round hashes an object's payload with the canonical numbers of what it refers to;
    rounds go on until none merges, so that parents of merged children merge next. More rounds than allowed are an error.
    """
    alias = objects.select("obj", F.col("obj").alias("canonical"))
    classes = -1
    for _ in range(rounds):
        to = alias.select(F.col("obj").alias("dst"), F.col("canonical").alias("_c"))
        kids = refs.join(to, "dst", "left").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "_c"))).alias("_kids"))
        keyed = objects.join(kids, objects["obj"] == kids["src"], "left").select("obj", F.sha2(F.to_json(F.struct("payload", "_kids")), 256).alias("_key"))
        lows = keyed.groupBy("_key").agg(F.min("obj").alias("canonical"))
        alias = kept(keyed.join(lows, "_key").select("obj", "canonical"))
        now = alias.select("canonical").distinct().count()
        if now == classes:
            return alias
        classes = now
    raise RuntimeError(f"not settled in {rounds} rounds")

"""References between objects: lookup, bounded chains, destinations, scored and interval lookups, copies of closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import kept
from .graph import reachable

#: Links of a chain that are followed: a power of two, as each round doubles the reach.
HOPS = 32


def lookup(rows: DataFrame, ref: str, objects: DataFrame, key: str) -> DataFrame:
    """rows with the columns of the object that ref names; they are null where there is none."""
    return rows.join(objects, rows[ref] == objects[key], "left")


def chase(objects: DataFrame, hops: int = HOPS) -> DataFrame:
    """(obj, target): the object at the end of the references from obj, or null if a chain breaks or takes more than hops.

    objects (obj, ref), ref null for what is no reference. Each round replaces a pointer by its pointer's pointer, so that
    log2(hops) equi-joins follow all chains, cycles too.
    """
    at = kept(objects.select("obj", F.coalesce("ref", "obj").alias("to")))
    reach = 1
    while reach < hops:
        then = at.select(F.col("obj").alias("_o"), F.col("to").alias("_t"))
        at = kept(at.join(then, F.col("to") == F.col("_o"), "left").select("obj", F.col("_t").alias("to")))
        reach *= 2
    ends = objects.where("ref IS NULL").select(F.col("obj").alias("_e"))
    return at.join(ends, F.col("to") == F.col("_e"), "left").select("obj", F.col("_e").alias("target"))


def interval(x: Column, bounds: list[float]) -> Column:
    """The place of the first bound above x; the number of bounds if there is none. Bounds needn't ascend."""
    out = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        out = F.when(x < bounds[i], i).otherwise(out)
    return out


def destinations(links: DataFrame, explicit: str, name: str, names: DataFrame, tree: DataFrame) -> DataFrame:
    """links with page and how: an explicit page, else that of the name in names (name, page), else in tree (name, page); of repeated names the smallest page."""
    one = lambda d, c: d.groupBy(F.col("name").alias(f"_{c}")).agg(F.min("page").alias(f"_{c}p"))
    rows = links.join(one(names, "d"), F.col(name) == F.col("_d"), "left").join(one(tree, "t"), F.col(name) == F.col("_t"), "left")
    how = F.when(F.col(explicit).isNotNull(), "explicit").when(F.col("_dp").isNotNull(), "dictionary").when(F.col("_tp").isNotNull(), "tree").otherwise("missing")
    return rows.select(*links.columns, F.coalesce(explicit, "_dp", "_tp").alias("page"), how.alias("how"))


def copy_closure(roots: DataFrame, edges: DataFrame, first: int) -> DataFrame:
    """(node, copy): all that roots reach, with new numbers from first on in order of node."""
    found = reachable(roots, edges)
    return numbered(found, "node", "copy", first)


def numbered(rows: DataFrame, key: str, name: str, first: int = 0) -> DataFrame:
    """rows with name, running numbers by key (long), which must be total: places in a range-partitioned order plus the sizes of the partitions before.

    Two passes over sorted partitions, so that no task sees all rows; only a count a partition is gathered, in a window over as many rows as partitions.
    """
    parts = kept(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).alias("_before"))
    at = F.row_number().over(W.partitionBy("_part").orderBy(key))
    return parts.join(F.broadcast(before), "_part").select(*rows.columns, (at - 1 + F.coalesce("_before", F.lit(0)) + first).cast("long").alias(name))


def union_renamed(resources: DataFrame, group: str, order: str) -> DataFrame:
    """(group, order, name, value, merged): distinct (name, value) pairs of a group in order of first appearance; a name that a group has with another value before becomes name_2, name_3."""
    first = resources.groupBy(group, "name", "value").agg(F.min(order).alias(order))
    k = F.row_number().over(W.partitionBy(group, "name").orderBy(order))
    return first.select(group, order, "name", "value", F.when(k == 1, F.col("name")).otherwise(F.concat_ws("_", "name", k.cast("string"))).alias("merged"))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is smallest by order: later entries don't overwrite."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def prune_names(entries: DataFrame, leaf: str, name: str, removed: Column) -> DataFrame:
    """(leaf, first, last, entries): limits of the leaves of a name tree once removed entries are gone; empty leaves go."""
    return entries.where(~F.coalesce(removed, F.lit(False))).groupBy(leaf).agg(F.min(name).alias("first"), F.max(name).alias("last"), F.count(F.lit(1)).alias("entries"))

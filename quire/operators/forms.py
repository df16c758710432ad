"""Form fields: names, kinds, lookups, unique names on merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.strings import last_segment
from ..scratch import kept
from .graph import DEPTH


def full_names(fields: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node, full_name, ft, ff): names joined by full stops from the root, with type and flags inherited. A missing name is Field and the node's number. More than depth levels are an error."""
    own = F.coalesce("name", F.concat(F.lit("Field"), F.col("node").cast("string")))
    level = fields.where("parent IS NULL").select("node", own.alias("full_name"), "ft", "ff")
    out, rest = level, fields.where("parent IS NOT NULL").select("node", "parent", own.alias("name"), "ft", "ff")
    for _ in range(1, depth + 1):
        up = level.select(F.col("node").alias("_n"), F.col("full_name").alias("_f"), F.col("ft").alias("_t"), F.col("ff").alias("_g"))
        level = kept(
            rest.join(up, F.col("parent") == F.col("_n")).select(
                "node", F.concat_ws(".", "_f", "name").alias("full_name"), F.coalesce("ft", "_t").alias("ft"), F.coalesce("ff", "_g").alias("ff")
            )
        )
        if level.isEmpty():
            return out
        out = out.union(level)
    raise RuntimeError(f"more than {depth} levels")


def lookup(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """(want, node, status): the field of that full name (of repeated ones the last), else the only one whose last segment it is.

    status: found, missing, or ambiguous (node null).
    """
    exact = fields.groupBy(F.col("full_name").alias("_f")).agg(F.max("node").alias("_exact"))
    tail = fields.select("node", last_segment(F.col("full_name")).alias("_s")).groupBy("_s").agg(F.min("node").alias("_one"), F.count(F.lit(1)).alias("_n"))
    rows = wanted.join(exact, F.col("want") == F.col("_f"), "left").join(tail, F.col("want") == F.col("_s"), "left")
    one = F.when(F.col("_n") == 1, F.col("_one"))
    node = F.coalesce("_exact", one)
    return rows.select("want", node.alias("node"), F.when(node.isNotNull(), "found").when(F.col("_n") > 1, "ambiguous").otherwise("missing").alias("status"))


def unique_names(names: DataFrame, group: str, order: str) -> DataFrame:
    """(group, order, name, unique): a name taken before becomes name~2, name~3 and so on, the first that is free; rows equal in order go by name.

    A made name can only meet a literal one that ends in ~ and digits. Groups without such a name are numbered by a window over
    (group, name), whatever their size; the others, which are rare, are dealt in order by a fold.
    """
    rows = names.select(group, order, "name")
    odd = rows.where(F.col("name").rlike("~[0-9]+$")).select(group).distinct()
    plain = rows.join(odd, group, "left_anti")

    def deal(pdf):
        taken, next_, out = set(), {}, []
        pdf = pdf.sort_values([order, "name"])
        for name in pdf["name"]:
            new, k = name, next_.get(name, 1)
            while new in taken:
                k += 1
                new = f"{name}~{k}"
            next_[name] = k
            taken.add(new)
            out.append(new)
        pdf["unique"] = out
        return pdf[[group, order, "name", "unique"]]

    kinds = dict(names.dtypes)
    folded = rows.join(odd, group, "left_semi").groupBy(group).applyInPandas(deal, f"{group} {kinds[group]}, {order} {kinds[order]}, name string, unique string")
    return rows_by_name(plain, group, order).union(folded)


def rows_by_name(names: DataFrame, group: str, order: str) -> DataFrame:
    """As unique_names where no made name meets a literal one (names without ~): a window, no fold."""
    k = F.row_number().over(W.partitionBy(group, "name").orderBy(order))
    return names.select(group, order, "name", F.when(k == 1, F.col("name")).otherwise(F.concat("name", F.lit("~"), k.cast("string"))).alias("unique"))

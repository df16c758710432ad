"""Page algebra: merge, split, move, remove, insert, packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def renumber(pages: DataFrame, doc: str, key: Column, name: str = "place") -> DataFrame:
    """pages with name, the place of each page in its document (from 0) by key, which must be total."""
    return pages.withColumn(name, (F.row_number().over(W.partitionBy(doc).orderBy(key)) - 1).cast("long"))


def merge(documents: list[DataFrame], page: str) -> DataFrame:
    """All pages of the documents, in their order, with doc_ord; (doc_ord, page) is the order of the result, without a global sort."""
    return reduce(DataFrame.unionByName, [d.withColumn("doc_ord", F.lit(i)) for i, d in enumerate(documents)])


def merge_by(pages: DataFrame, doc: str, page: str, into: Column) -> DataFrame:
    """pages with target (the document that each document goes into) and place: documents of a target by id, pages in their order."""
    return renumber(pages.withColumn("target", into), "target", F.struct(doc, page))


def split(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """One document for each page, named (doc, page)."""
    return pages.withColumn("new_doc", F.concat_ws("-", doc, page))


def move(pages: DataFrame, doc: str, page: str, source: int, target: int) -> DataFrame:
    """Every document with its page at place source moved to place target; documents without such places are as before."""
    n = F.count(F.lit(1)).over(W.partitionBy(doc))
    p = F.col("_p")
    within = (F.lit(max(source, target)) < n)
    if source < target:
        moved = F.when(p == source, target).when((p > source) & (p <= target), p - 1).otherwise(p)
    else:
        moved = F.when(p == source, target).when((p >= target) & (p < source), p + 1).otherwise(p)
    return renumber(pages, doc, F.col(page), "_p").withColumn("place", F.when(within, moved).otherwise(p).cast("long")).drop("_p")


def remove(pages: DataFrame, doc: str, page: str, condition: Column) -> DataFrame:
    """The pages that don't meet the condition, renumbered. A null condition keeps the page."""
    return renumber(pages.where(~F.coalesce(condition, F.lit(False))), doc, F.col(page))


def insert(pages: DataFrame, new: DataFrame, doc: str, page: str, at: int) -> DataFrame:
    """pages with the pages of new (same columns, one document's pages in their order) before place at of the document of equal id; past the end they follow it."""
    old = renumber(pages, doc, F.col(page), "_p").select(*pages.columns, F.when(F.col("_p") >= at, 2).otherwise(0).alias("_part"))
    both = old.unionByName(new.select(*pages.columns, F.lit(1).alias("_part")))
    return renumber(both, doc, F.struct("_part", page)).drop("_part")


def pack(objects: DataFrame, key: Column, size: int = 100, group: str | None = None) -> DataFrame:
    """objects with batch: runs of size objects by key. Numbers come per group (a document), so that no global order is needed."""
    over = W.partitionBy(group).orderBy(key) if group else W.orderBy(key)
    return objects.withColumn("batch", F.floor((F.row_number().over(over) - 1) / size).cast("long"))

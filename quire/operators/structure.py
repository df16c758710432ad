"""Tagged structure: ranks of words by marked content, lookups of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ranks(words: DataFrame, order: DataFrame, page: list[str]) -> DataFrame:
    """words (page keys, mcid) with rank_ and structured.

    order (page keys, mcid, pos) lists a page's marked content; of repeated ones the first counts. A word whose content isn't listed
    gets the list's length plus its own place, so it comes after all listed ones. structured is false on a page that has no list: its words go by geometry.
    """
    first = order.groupBy(*page, "mcid").agg(F.min("pos").alias("pos"))
    by_page = W.partitionBy(*page)
    first = first.select(*page, "mcid", (F.row_number().over(by_page.orderBy("pos", "mcid")) - 1).alias("_rank"))
    sizes = first.groupBy(*page).agg(F.count(F.lit(1)).alias("_n"))
    own = words.select(*page, "mcid", (F.row_number().over(by_page.orderBy("mcid")) - 1).alias("_i"))
    joined = own.join(first, [*page, "mcid"], "left").join(sizes, page, "left")
    rank = F.coalesce("_rank", F.coalesce("_n", F.lit(0)) + F.col("_i")).cast("long")
    return joined.select(*page, "mcid", rank.alias("rank_"), F.col("_n").isNotNull().alias("structured"))

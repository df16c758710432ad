"""Conformance rules as findings, and their roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The highest header version of each part.
CEILING = {1: "1.4", 2: "1.7", 3: "1.7"}


def rule(documents: DataFrame, key: str, name: str, passes: Column, checked: Column | None = None) -> DataFrame:
    """(key, rule, status): Pass, Fail, or NotChecked where checked is false or the outcome is null."""
    status = F.when(passes, "Pass").when(~passes, "Fail").otherwise("NotChecked")
    if checked is not None:
        status = F.when(F.coalesce(checked, F.lit(False)), status).otherwise("NotChecked")
    return documents.select(key, F.lit(name).alias("rule"), status.alias("status"))


def findings(documents: DataFrame, key: str, rules: dict[str, tuple]) -> DataFrame:
    """All rules over documents, in one pass: a row for each document and rule."""
    columns = []
    for name, (passes, *checked) in rules.items():
        status = F.when(passes, "Pass").when(~passes, "Fail").otherwise("NotChecked")
        if checked:
            status = F.when(F.coalesce(checked[0], F.lit(False)), status).otherwise("NotChecked")
        columns.append(F.struct(F.lit(name).alias("rule"), status.alias("status")))
    return documents.select(key, F.inline(F.array(*columns)))


def rollup(found: DataFrame, key: str) -> DataFrame:
    """(key, conformant, failures, not_checked): conformant if nothing fails."""
    failed = F.col("status") == "Fail"
    return found.groupBy(key).agg(
        (~F.bool_or(failed)).alias("conformant"), F.count_if(failed).alias("failures"), F.count_if(F.col("status") == "NotChecked").alias("not_checked")
    )


def version_within(part: Column, version: Column) -> Column:
    """Whether a header's version (major.minor) is at most that of its part; null for an unknown part."""
    ceiling = reduce(lambda acc, kv: acc.when(part == kv[0], F.lit(float(kv[1]))), CEILING.items(), F.when(F.lit(False), F.lit(0.0)))
    return version.cast("double") <= ceiling


def document_rules(facts: DataFrame, key: str) -> DataFrame:
    """(key, rule, status) of the rules for files over what sources.parts.conformance tells of them. Filters are judged in part 1 alone."""
    part = F.when(F.col("part").isin("1", "2"), F.col("part").cast("int"))
    known = F.col("part").isin("1", "2") & (F.col("conformance") == "B") & F.col("other").isNull()
    return findings(
        facts, key,
        {
            "identification": (F.coalesce(known, F.lit(False)),),
            "encryption": (~F.col("encrypted"),),
            "version": (version_within(part, F.col("version")), part.isNotNull()),
            "appearances": (~F.col("appearances"),),
            "output_intent": (F.col("intent") == "ok",),
            "filters": (~F.col("lzw"), part == 1),
        },
    )

"""Revisions of objects: the newest entry of each counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by order (which must be total); an aggregate with map-side combine, no window."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, "_r.*")


def live(rows: DataFrame, key: list[str], order: list[str], kind: str, free: str) -> DataFrame:
    """Newest rows whose kind isn't free: an object that its newest revision frees is gone."""
    return last_wins(rows, key, order).where(F.col(kind) != free)


def upsert(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """base with the rows of delta in place of those of equal key."""
    return base.join(delta.select(*key), key, "left_anti").unionByName(delta)

"""First-wins and last-wins duplicates, upserts and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order; null keys are a key."""
    return _ranked(df, keys, order)


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in the given order."""
    return _ranked(df, keys, [(F.col(c) if isinstance(c, str) else c).desc() for c in order])


def _ranked(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; where both have a key the new row wins."""
    both = base.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return _ranked(both, keys, [F.desc("_src")]).drop("_src")


def union_first(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """UNION by key over several tables: the first table that has a key gives its row."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("_src", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return _ranked(out, keys, ["_src"]).drop("_src")

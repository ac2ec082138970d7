"""Deterministic samples: hash order, round-robin over groups, weighted round-robin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity(alpha_hash="alpha_hash", source_path="source_path", ident="id") -> Column:
    """The first of hash, source path and id that is there and not empty."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in (alpha_hash, source_path, ident)))


def hash_rank(salt, ident, key="id") -> Column:
    """Sort key of a record: SHA-256 of salt, identity and id joined by colons."""
    parts = [F.lit(salt) if isinstance(salt, str) else salt, *(F.col(c) if isinstance(c, str) else c for c in (ident, key))]
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)


def stable_limit(df: DataFrame, limit: int, salt: str, ident="alpha_hash", key: str = "id") -> DataFrame:
    """The ``limit`` rows that come first by hash_rank; a top-k plan, no full sort."""
    if limit <= 0:
        return df.limit(0)
    return df.withColumn("_rank", hash_rank(salt, ident, key)).orderBy("_rank", key).limit(limit).drop("_rank")


def _turns(df: DataFrame, limit: int, salt: str, ident, key: str, band: str) -> DataFrame:
    """Rows with _rn, their place from 0 within their band; bands without a name are dropped.

    Only ``limit`` rows of a band can be taken, so the window keeps no more:
    Spark turns the bound on row_number into a limit for each group before the
    shuffle.
    """
    rows = df.where(F.coalesce(F.col(band), F.lit("")) != "")
    rank = hash_rank(F.concat(F.lit(f"{salt}:"), F.col(band)), ident, key)
    w = Window.partitionBy(band).orderBy("_rank", key)
    return rows.withColumn("_rank", rank).withColumn("_rn", F.row_number().over(w) - 1).where(F.col("_rn") < limit).drop("_rank")


def round_robin(df: DataFrame, limit: int, salt: str, ident="alpha_hash", key: str = "id", band: str = "band") -> DataFrame:
    """One row of each band a turn, bands in ascending order, until ``limit`` rows are taken."""
    return weighted_round_robin(df, limit, salt, {}, ident, key, band)


def weighted_round_robin(df: DataFrame, limit: int, salt: str, weights: dict[str, int], ident="alpha_hash", key: str = "id", band: str = "band") -> DataFrame:
    """A band's turn takes its weight of rows (1 where none is given, and at least); names of ``weights`` match in any case."""
    if limit <= 0:
        return df.limit(0)
    weight = F.lit(1)
    for name, n in sorted(weights.items()):
        weight = F.when(F.upper(band) == str(name).upper(), max(1, int(n))).otherwise(weight)
    turns = _turns(df, limit, salt, ident, key, band).withColumn("_turn", F.floor(F.col("_rn") / weight))
    return turns.orderBy("_turn", band, "_rn").limit(limit).drop("_turn", "_rn")

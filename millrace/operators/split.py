"""Quotas by largest remainder and exact stratified splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def largest_remainder(weights: DataFrame, total: int, name: str = "name", weight: str = "weight") -> DataFrame:
    """(name, quota): floor shares of ``total``, the rest by largest remainder, names ascending on a tie."""
    everything = Window.partitionBy(F.lit(0))
    share = F.lit(float(total)) * F.col(weight) / F.sum(weight).over(everything)
    rows = weights.select(name, weight).withColumn("_share", share).withColumn("_base", F.floor("_share").cast("bigint"))
    rows = rows.withColumn("_left", F.lit(total) - F.sum("_base").over(everything))
    w = everything.orderBy(F.desc(F.col("_share") - F.col("_base")), name)
    return rows.withColumn("_rn", F.row_number().over(w)).select(name, (F.col("_base") + (F.col("_rn") <= F.col("_left")).cast("bigint")).alias("quota"))


def allocate(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Quotas of bands in proportion to their sizes, never above them; a total out of range is an error."""
    everything = sum(sizes.values())
    if not 0 <= total <= everything:
        raise ValueError(f"cannot take {total} of {everything} rows")
    if not everything:
        return dict.fromkeys(sizes, 0)
    share = {b: total * n / everything for b, n in sizes.items()}
    quota = {b: min(int(s), sizes[b]) for b, s in share.items()}
    order = sorted(sizes, key=lambda b: (-(share[b] - int(share[b])), b))
    while (left := total - sum(quota.values())) > 0:
        for band in [b for b in order if quota[b] < sizes[b]][:left]:
            quota[band] += 1
    return quota


def numbered(df: DataFrame, band: str, key: str) -> DataFrame:
    """Row number _rn of each row within its band by (_rank, key), for a hexadecimal _rank.

    A band may hold most rows, so it is numbered in 256 parts by the first two
    digits of the rank; the parts' sizes, a few hundred rows, give the offsets.
    """
    df = df.withColumn("_part", F.substring("_rank", 1, 2))
    sizes = df.groupBy(band, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(band).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select(band, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(band, "_part").orderBy("_rank", key))
    return df.withColumn("_in", inside).join(start, [band, "_part"]).withColumn("_rn", F.col("_in") + F.col("_start")).drop("_part", "_in", "_start")


def exact_splits(df: DataFrame, counts: dict[str, int], band: str = "band", ident="alpha_hash", key: str = "id", golden: str | None = None) -> DataFrame:
    """Column split: train, dev or test with exactly the given numbers of rows, spread over bands.

    Bands are ordered by hash of ``ident``; dev takes its quota of each band
    first, test its quota of what is left, the rest is train.  Rows of the
    band ``golden`` get that split.  Counts that do not add up are an error.
    Only the sizes of bands come to the driver.
    """
    rows = df if golden is None else df.where(F.col(band) != golden)
    sizes = {r[0]: r[1] for r in rows.groupBy(band).count().collect()}
    if sum(counts.values()) != sum(sizes.values()):
        raise ValueError(f"splits of {sum(counts.values())} rows asked of {sum(sizes.values())}")
    dev = allocate(sizes, counts.get("dev", 0))
    test = allocate({b: n - dev[b] for b, n in sizes.items()}, counts.get("test", 0))
    quota = lambda q: F.coalesce(F.create_map(*[F.lit(x) for b in sorted(q) for x in (b, q[b])])[F.col(band)], F.lit(0)) if q else F.lit(0)
    rank = F.sha2(F.col(ident).cast("string"), 256) if isinstance(ident, str) else F.sha2(ident, 256)
    rows = numbered(rows.withColumn("_rank", rank), band, key)
    split = F.when(F.col("_rn") <= quota(dev), "dev").when(F.col("_rn") <= quota(dev) + quota(test), "test").otherwise("train")
    out = rows.withColumn("split", split).select(*df.columns, "split")
    if golden is not None:
        out = out.unionByName(df.where(F.col(band) == golden).withColumn("split", F.lit(golden)))
    return out

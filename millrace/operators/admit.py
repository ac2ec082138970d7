"""Admission under quotas, resume state and novelty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import numbered
from millrace.session import cut

#: Places that one task of a trailing frame looks at.
RUN = 100_000
#: Quotas up to this sum are broadcast as accepted rows; above, they are joined by band and key.
BROADCAST_QUOTAS = 1_000_000


def _decide(firsts: DataFrame, quotas: dict[str, int], band: str) -> DataFrame:
    """(band, key, place, ordinal, full) of accepted keys, by rounds that settle all rows that no open row can change.

    A row goes as soon as its key is accepted at an earlier place, or its band
    has accepted its quota before it.  It is accepted as soon as all earlier
    rows of its key are gone, and those of its band that are accepted or open
    do not fill the quota.  The first open row can always be settled, so the
    rounds end; without keys in several bands there are two.
    """
    limit = F.create_map(*[F.lit(x) for b, q in sorted(quotas.items()) for x in (b, q)])[F.col(band)] if quotas else F.lit(0)
    earlier = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    of_key, of_band = earlier.partitionBy("_key"), earlier.partitionBy(band)
    count = lambda state, window: F.coalesce(F.sum((F.col("_state") == state).cast("int")).over(window), F.lit(0))

    def settled(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_ka": count(1, of_key), "_ko": count(0, of_key)}).withColumns({"_ba": count(1, of_band), "_bo": count(0, of_band)})
        gone = (F.col("_ka") > 0) | (F.col("_ba") >= limit)
        sure = (F.col("_ko") == 0) & (F.col("_ba") + F.col("_bo") < limit)
        return rows.withColumn("_state", F.when(F.col("_state") != 0, F.col("_state")).when(gone, -1).when(sure, 1).otherwise(0)).drop("_ka", "_ko", "_ba", "_bo")

    rows = firsts.select(band, "_key", "_place", F.lit(0).alias("_state"))
    while True:
        rows = cut(settled(settled(rows)))
        if rows.where("_state = 0").isEmpty():
            break
    taken = rows.where("_state = 1").drop("_state")
    ends = Window.partitionBy(band)
    taken = taken.withColumn("full", (F.count("*").over(ends) == limit) & (F.max("_place").over(ends) == F.col("_place")))
    return taken.withColumn("ordinal", F.row_number().over(Window.orderBy("_place")).cast("long"))  # as many rows as the quotas allow


def admit(df: DataFrame, quotas: dict[str, int], key: str = "alpha_hash", band: str = "band", order: list[str] = ("seed", "band")) -> DataFrame:
    """Adds reason, status (accepted or rejected) and ordinal (place among the accepted), in place of columns so named.

    In order: a band at its quota rejects (quota_reached); a key that an
    accepted row of any band has rejects (duplicate); else the row is
    accepted.  Each decision depends on those before it, also in other bands,
    but a band is full after as many different keys as all quotas together, so
    the rounds of decisions look at no more than that for each band, whatever
    the size of the table.  The rows themselves are judged by what was accepted:
    a row after the last accepted one of a full band met the quota, any other
    one a duplicate.  ``order`` gives every row its own place; a null key is a
    key like any other.
    """
    total = sum(max(0, q) for q in quotas.values())
    place = F.struct(*order)
    rows = df.withColumns({"_key": F.col(key), "_place": place})
    firsts = rows.where(F.col(band).isin([b for b, q in quotas.items() if q > 0])).groupBy(band, "_key").agg(F.min("_place").alias("_place"))
    near = firsts.withColumn("_n", F.row_number().over(Window.partitionBy(band).orderBy("_place"))).where(F.col("_n") <= total).drop("_n")
    taken = _decide(near, {b: q for b, q in quotas.items() if q > 0}, band)
    # one last row for each full band, and at most ``total`` accepted rows
    ends = taken.where("full").groupBy(F.col(band).alias("_b")).agg(F.max("_place").alias("_end"))
    taken = taken.select(F.col(band).alias("_b"), F.col("_key").alias("_k"), F.col("_place").alias("_p"), F.col("ordinal").alias("_ordinal"))
    rows = rows.join(F.broadcast(ends), F.col(band) == F.col("_b"), "left").drop("_b")
    same = (F.col(band) == F.col("_b")) & F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_place") == F.col("_p"))
    rows = rows.join(F.broadcast(taken) if total <= BROADCAST_QUOTAS else taken, same, "left")
    limit = F.create_map(*[F.lit(x) for b, q in sorted(quotas.items()) for x in (b, q)])[F.col(band)] if quotas else F.lit(0)
    late = (F.coalesce(limit, F.lit(0)) <= 0) | F.coalesce(F.col("_place") > F.col("_end"), F.lit(False))
    taken_ = F.col("_ordinal").isNotNull()
    reason = F.when(taken_, None).when(late, "quota_reached").otherwise("duplicate").cast("string")
    names = [c for c in df.columns if c not in ("reason", "status", "ordinal")]
    return rows.select(*names, reason.alias("reason"), F.when(taken_, "accepted").otherwise("rejected").alias("status"), F.col("_ordinal").alias("ordinal"))


def rejection_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def resume_state(done: DataFrame, band: str = "band", seed: str = "seed") -> DataFrame:
    """(band, accepted, next_seed) of an index that exists already."""
    return done.groupBy(band).agg(F.count("*").alias("accepted"), (F.max(seed) + 1).alias("next_seed"))


def novelty(df: DataFrame, key: str, order: list[str], trailing: int = 1000) -> DataFrame:
    """Adds first_seen, and novelty: the share of first-seen keys among the last ``trailing`` rows.

    Rows are numbered in order and dealt out in runs of places; each run gets
    a copy of the ``trailing`` - 1 rows before it, so no task holds more than
    a run.  ``order`` gives every row its own place.
    """
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    rows = df.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn("first_seen", (F.struct(*order) == F.col("_first")).cast("int")).drop("_key", "_first")
    run = max(RUN, trailing)
    rows = numbered(rows, order, "_at").withColumn("_run", F.floor(F.col("_at") / run))
    halo = (F.col("_at") % run >= run - trailing + 1) if trailing > 1 else F.lit(False)
    runs = rows.withColumn("_of", F.explode(F.when(halo, F.array("_run", F.col("_run") + 1)).otherwise(F.array("_run"))))
    share = F.avg("first_seen").over(Window.partitionBy("_of").orderBy("_at").rowsBetween(-(trailing - 1), 0))
    return runs.withColumn("novelty", share).where(F.col("_of") == F.col("_run")).drop("_at", "_run", "_of")

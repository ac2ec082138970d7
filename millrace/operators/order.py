"""Places in a total order without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut


def numbered(df: DataFrame, order: list[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the place of each row, from 0, by ``order`` (a column by its name goes up, nulls first).

    Ranges of the order are dealt to parts and sorted there, in one shuffle; the
    stored rows carry their part and their place in it, and the sizes of the
    parts, one row each, give the offsets.  Rows alike in ``order`` meet in one
    part, so a column that tells them apart should stand last in it.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id has the number of the partition above 33 bits of the place inside it
    rows = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_id").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_id", "_start")

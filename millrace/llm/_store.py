"""Intermediate tables in the shared folder, and the fixed-size filters built from them."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set a temporary one, which only local sessions can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write the table once into the shared folder and read it back: lineage ends here and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by stored() that no later plan reads."""
    path = getattr(df, "_millrace_path", None)
    if path:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context.hadoopConfiguration()).delete(target, True)


def key_filter(keys: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """A one-hash Bloom filter of a long column by its lowest bits, as ``bits / 64`` words.

    Its size is fixed whatever the table holds.  It lets a rescan skip texts
    that no later join can use; false positives are removed by that join.
    """
    rows = (
        keys.where(F.col(column).isNotNull()).select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("b"))
        .select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("m"))
        .groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    )
    words = np.zeros(bits // 64, np.int64)
    words[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return words


def maybe_in(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Mask of the 64-bit keys that may be in the filter."""
    at = keys.view(np.int64) & np.int64(len(words) * 64 - 1)
    return ((words[at >> 6] >> (at & 63)) & 1).astype(bool)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or a longer one where a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Keys that spread_join() broadcasts at most.
HOT_KEYS = 10_000


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], by: list, total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row for each value of ``keys``, its number of rows in ``count``).

    A key with more than its share of rows is dealt by the columns ``by`` to
    several tasks, in each of which its row of ``groups`` has a copy.  ``total``
    is the number of rows or more, so such keys are at most ``HOT_KEYS``.
    """
    each = max(1000, -(-total // HOT_KEYS))
    groups = groups.withColumn("__parts", F.ceil(F.col(count) / F.lit(float(each))).cast("int"))
    hot = groups.where("__parts > 1").select(*keys, F.col("__parts").alias("__k"))
    salt = F.when(F.col("__k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.col("__k")).cast("int"))
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__k")
    groups = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return rows.join(groups, [*keys, "__salt"], how).drop("__salt")


def input_bytes(df: DataFrame) -> int:
    """Size of the plan's input as the optimiser states it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(spark: SparkSession, size: int, each: int = 16 << 20) -> int:
    """Shuffle partitions for ``size`` bytes: in proportion, at least the session's own number; that number where the size is unknown."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return own if size > 1 << 60 else min(max(own, -(-size // each)), 100_000)

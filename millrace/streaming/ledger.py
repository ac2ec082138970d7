"""Appending each micro-batch exactly once to a table of files.

A batch is written to a folder of its number and then entered in a ledger;
readers see entered batches only.  A run that stops between the two writes the
same batch to the same folder again, since the checkpoint gives it the same
rows and number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from millrace.sources.sinks import _path, write_text


def entered(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the batches in the ledger."""
    fs, folder = _path(spark, f"{target}/ledger")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())


def append_once(stream: DataFrame, target: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, before_entry: Callable[[int], None] = lambda n: None) -> None:
    """Append all that is there, each batch after ``change``, and stop; ``before_entry`` runs between a batch's files and its entry."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        if number in entered(spark, target):
            return
        change(batch).write.mode("overwrite").parquet(f"{target}/batches/{number}")
        before_entry(number)
        write_text(spark, f"{target}/ledger/{number}", "")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    """The rows of the batches in the ledger."""
    paths = [f"{target}/batches/{n}" for n in entered(spark, target)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

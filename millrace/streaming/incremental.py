"""Incremental forms on the file source: dedupe, progress and resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def dedupe(stream: DataFrame, keys: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """First row of each key seen; with an event time and delay the state is bounded by the watermark."""
    if time and delay:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def progress(stream: DataFrame, by: str) -> DataFrame:
    return stream.groupBy(by).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, by: list[str]) -> DataFrame:
    """Counts of tumbling windows; rows later than the delay are dropped by the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> None:
    """Process all that is there and stop; the next call goes on from the checkpoint."""
    stream.writeStream.format(kind).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()


def run_whole(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Process all that is there; each batch replaces the files of ``target`` by the whole result so far, which is read back.

    A batch that fails half way is written anew by the next start.
    """
    whole = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    whole.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(target)).start().awaitTermination()
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(target)  # there was no batch
    return spark.read.schema(stream.schema).parquet(target)

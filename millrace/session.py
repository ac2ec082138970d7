"""Sessions, and shipping this package to Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of whole texts or sets are large: smaller Arrow batches bound the memory of Python workers.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Give Python workers this package as a zip, once per context, so that it need not be installed on executors."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_ROWS) == "10000":  # only Spark's own default is changed
        spark.conf.set(BATCH_ROWS, "1000")
    if not getattr(context, "_millrace_shipped", False):
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(path)
        context._millrace_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one named by ``spark.checkpoint.dir``; where none is set a temporary one, which only local sessions can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/millrace-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back, so that no later plan works it out again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches: UTC, adaptive execution, few shuffle partitions, no UI."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("millrace")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())

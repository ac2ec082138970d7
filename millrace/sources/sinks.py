"""Documents, reports, archives and slices as files, and a lock for writers."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.dedupe import union_first
from millrace.operators.sample import round_robin


#: Names of the splits of a corpus (fixed values).
SPLITS = ("train", "dev", "test", "golden", "adversarial_test")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A small text as one file of the path's file system; without ``overwrite`` an existing file is an error."""
    fs, target = _path(spark, path)
    out = fs.create(target, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def json_document(df: DataFrame, key: str | None = None) -> str:
    """A result of a few rows as one pretty JSON document: a list, or an object by ``key``."""
    rows = [json.loads(x) for x in df.toJSON().collect()]
    return json.dumps({str(r.pop(key)): r for r in rows} if key else rows, indent=2, sort_keys=True)


def markdown_report(title: str, sections: dict[str, DataFrame]) -> str:
    """Bullets of small tables: the first column names the row, the others follow."""
    lines = [f"# {title}", ""]
    for name, df in sections.items():
        lines += [f"## {name}", ""]
        for row in df.collect():
            head, *rest = zip(df.columns, row, strict=True)
            lines.append(f"- {head[1]}: " + ", ".join(f"{c} {v:.4f}" if isinstance(v, float) else f"{c} {v}" for c, v in rest))
        lines.append("")
    return "\n".join(lines)


def archive(cases: DataFrame, target: str, name: str, by: str) -> DataFrame:
    """Write cases below ``target`` in one folder for each ``by``; returns the manifest (by, n_cases, first, last)."""
    cases.write.mode("overwrite").partitionBy(by).parquet(f"{target}/cases")
    manifest = cases.groupBy(by).agg(F.count("*").alias("n_cases"), F.min(name).alias("first"), F.max(name).alias("last"))
    manifest.write.mode("overwrite").json(f"{target}/manifest")
    return manifest


def write_splits(df: DataFrame, target: str, split: str = "split", names: tuple[str, ...] = SPLITS, kind: str = "json") -> dict[str, int]:
    """One table for each named split below ``target``, empty ones too; returns their sizes."""
    counts = {r[0]: r[1] for r in df.groupBy(split).count().collect()}
    if unknown := set(counts) - set(names):
        raise ValueError(f"unknown splits: {sorted(map(str, unknown))}")
    for name in names:
        df.where(F.col(split) == name).drop(split).write.mode("overwrite").format(kind).save(f"{target}/{name}")
    return {n: counts.get(n, 0) for n in names}


def append_new(df: DataFrame, path: str, key: str, kind: str = "parquet") -> int:
    """Append the rows whose key the table at ``path`` does not have yet; returns how many.

    The first of several rows of one key is not defined: pass distinct keys.
    A run that was cut short is made up for by calling it again.
    """
    spark = df.sparkSession
    fs, target = _path(spark, path)
    if fs.exists(target) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(target)):
        df = df.join(spark.read.schema(df.schema).format(kind).load(path).select(key), key, "left_anti").select(*df.columns)
    before = spark.read.schema(df.schema).format(kind).load(path).count() if fs.exists(target) else 0
    df.write.mode("append").format(kind).save(path)
    return spark.read.schema(df.schema).format(kind).load(path).count() - before


def copy_files(spark: SparkSession, sources: list[str], target: str, missing_ok: bool = True) -> list[str]:
    """Copy files of any file system into a folder; returns the new paths.  Names must differ."""
    out = []
    names = [s.rstrip("/").rpartition("/")[2] for s in sources]
    if len(set(names)) < len(names):
        raise ValueError("files of one name")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for source, name in zip(sources, names, strict=True):
        fs, path = _path(spark, source)
        if not fs.exists(path) and missing_ok:
            continue
        other, copy = _path(spark, f"{target}/{name}")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, other, copy, False, True, hadoop)
        out.append(f"{target}/{name}")
    return out


def slice_dataset(splits: dict[str, DataFrame], target: str, limits: dict[str, int], salt: str, ident: str = "alpha_hash", key: str = "id", band: str = "band") -> DataFrame:
    """Write a sample of each split, taking turns over bands, and the index of all: one row for each key, first split first."""
    parts = []
    for name, df in splits.items():
        part = (round_robin(df, limits[name], f"{salt}:{name}", ident, key, band) if name in limits else df).withColumn("split", F.lit(name))
        part.write.mode("overwrite").parquet(f"{target}/splits/{name}")
        parts.append(df.sparkSession.read.parquet(f"{target}/splits/{name}"))
    index = union_first(parts, [key])
    index.write.mode("overwrite").parquet(f"{target}/index")
    return index


def archive_dataset(splits: dict[str, DataFrame], columns: list[str], target: str) -> str:
    """Write only the given columns of the chosen splits below ``target``/<fingerprint>, unless they are there; returns that folder.

    The fingerprint covers the columns, the split names and the rows of each,
    whatever their order, so an equal archive is written once.
    """
    spark = next(iter(splits.values())).sparkSession
    parts = []
    for name, df in sorted(splits.items()):
        row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        # sums of 60 bits of each row's digest do not depend on the order and need no sort
        bits = [F.conv(F.substring(row, k, 15), 16, 10).cast("decimal(38,0)") for k in (1, 16, 31)]
        parts.append([name, *map(str, df.agg(F.count("*"), *(F.sum(b) for b in bits)).first())])
    mark = hashlib.sha256(json.dumps([columns, parts]).encode()).hexdigest()[:16]
    folder = f"{target}/{mark}"
    fs, done = _path(spark, f"{folder}/manifest.json")
    if not fs.exists(done):
        for name, df in splits.items():
            df.select(*columns).write.mode("overwrite").parquet(f"{folder}/{name}")
        write_text(spark, f"{folder}/manifest.json", json.dumps({"columns": columns, "rows": {p[0]: int(p[1]) for p in parts}}, indent=2, sort_keys=True))
    return folder


class Locked(RuntimeError):
    """Another writer holds the path."""


@contextmanager
def single_writer(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold ``path``.lock while writing; ``path``.state says running, done or failed."""
    lock, state = f"{path}.lock", f"{path}.state"
    try:
        write_text(spark, lock, str(time.time()), overwrite=False)
    except Exception as error:
        raise Locked(path) from error
    stamp = lambda status, **more: write_text(spark, state, json.dumps({"status": status, "at": time.strftime("%Y-%m-%dT%H:%M:%S"), **more}))
    try:
        stamp("running")
        yield
        stamp("done")
    except BaseException as error:
        stamp("failed", error=repr(error)[:500])
        raise
    finally:
        fs, target = _path(spark, lock)
        fs.delete(target, False)

"""Hashes, record identities and hash splits."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256(c) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def record_id(band, seed, surface_hash, alpha_hash, deck_hash) -> Column:
    """SHA-256 of the five parts joined by LF; null if a part is null."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (band, seed, surface_hash, alpha_hash, deck_hash)]
    joined = F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\n"))][:-1])
    return sha256(joined)


def unit_hash(c) -> Column:
    """The first 32 bits of SHA-256 as a number from 0 to 1."""
    return F.conv(F.substring(sha256(c), 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967295.0)


def hash_split(c, train: float = 0.8, dev: float = 0.1) -> Column:
    """train, dev or test by unit_hash."""
    u = unit_hash(c)
    return F.when(u < F.lit(train), "train").when(u < F.lit(train + dev), "dev").otherwise("test")


def fileset_digest(files: DataFrame, by: list[str], path: str = "path", content: str = "content", piece: str | None = None) -> DataFrame:
    """(by, n_files, digest): SHA-256 over path NUL content NUL of each group's files in path order.

    Rows are dealt by group and sorted by path, and, where a file's content
    comes in several rows, by ``piece``; each group is hashed as its rows pass
    by, so memory does not depend on a group or file.  Null paths and contents
    are empty; a group without rows has no digest.
    """
    order = ["_p", "_k"]
    rows = files.select(
        *by, F.coalesce(F.col(path).cast("string"), F.lit("")).cast("binary").alias("_p"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("_c"),
        (F.col(piece).cast("long") if piece else F.lit(0).cast("long")).alias("_k"),
    )
    rows = rows.repartition(*by).sortWithinPartitions(*by, *order)
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        group = key = name = digest = None
        n, schema = 0, None

        def done():
            digest.update(b"\0")
            return pa.RecordBatch.from_arrays([*group, pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], schema=schema)

        for b in batches:
            keys = b.select(by)
            schema = schema or pa.schema([*keys.schema, ("n_files", pa.int64()), ("digest", pa.string())])
            for i, (of, p, c) in enumerate(zip(keys.to_pylist(), b.column("_p").to_pylist(), b.column("_c").to_pylist(), strict=True)):
                of = tuple(of.values())
                if digest is None or of != key:
                    if digest is not None:
                        yield done()
                    group, key, name, digest, n = keys.slice(i, 1).columns, of, None, hashlib.sha256(), 0
                if p != name or not piece:
                    digest.update((b"\0" if n else b"") + p + b"\0")
                    name, n = p, n + 1
                digest.update(c)
        if digest is not None:
            yield done()

    return rows.mapInArrow(run, f"{kinds}, n_files long, digest string")


def fingerprint(c) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(sha256(c), 1, 16)

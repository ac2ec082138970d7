"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._store import forget, spread_join, stored

#: Edges (16 bytes each) that one task may hold.
SMALL = 100_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of one block of edges, by repeated minimum."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while True:
            short = new[new]
            if np.array_equal(short, new):
                break
            new = short
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _block_forest(batches):
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def reduced():
        x, y = (np.concatenate(c) for c in zip((u, v), *held, strict=True))
        held.clear()
        return forest(x, y)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=EDGES)

    rows = 0
    for b in batches:
        held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
        rows += b.num_rows
        if rows > 1_000_000:
            u, v = reduced()
            if len(u) > 800_000:  # a forest of that many nodes goes on as it is
                yield out()
                u, v = u[:0], v[:0]
            rows = len(u)
    if rows:
        u, v = reduced()
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """Rows (u, v): v is the smallest id reachable from u, for every u that is not itself the smallest.

    ``edges`` has long columns u and v.  Blocks of edges are first reduced to
    forests where they lie; each round then moves every neighbour to the local
    minimum and ends in the shared folder, so that a lost executor costs one
    round.  Where the forests have at most ``SMALL`` edges together, one task
    finishes instead.  Loops and null ends are dropped.  An empty table gives
    an empty table.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    now = stored(edges.mapInArrow(_block_forest, "u long, v long"))
    size = now.count()
    if size <= SMALL:
        return stored(now.coalesce(1).mapInArrow(_block_forest, "u long, v long"))
    seen = None
    while True:  # ends: each round lowers some label until none can be lowered
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, low, ["u"], ["v"], 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            spread_join(down, low, ["u"], ["v"], 2 * size).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        new = stored(small)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now = new
        if state == seen or not state[0]:
            return now
        seen, size = state, state[0]

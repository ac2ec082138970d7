"""Embedding near-dedup by a forest of random-projection trees with spill overlap.

Each tree cuts the unit vectors of one label again and again at the median of a
random projection; a vector within ``margin`` of the median goes to both sides.
Labels of more than ``group`` vectors are first cut by a top tree of bounded
size, fitted on a bounded sample; what falls under one of its leaves meets in a
task, which goes on cutting by splits fitted there, down to ``leaf`` vectors.  A
part that no projection can cut, because its vectors lie close together, stays
one leaf.  So splits are fitted on samples and every vector is indexed.

Vectors are compared within leaves, block by block where a leaf is large, and
the cosine is verified in double precision.  Two vectors may meet in several
leaves: they are counted in the leaf with the smallest code that both are in.
A block gives the number of links of each of its vectors and a spanning forest
of its links, never the pairs.  Equal vectors are one point with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._graph import components, forest
from millrace.llm._store import partitions_for, stored

COSINE = 0.93
TREES = 10
LEAF = 400
#: Half width of the overlap, as a difference of projections of unit vectors.
MARGIN = 0.02
#: Vectors of a label that one task cuts without a top tree.
GROUP = 8192
#: Vectors on which the top trees are fitted, and levels of a top tree at most.
SAMPLE = 20_000
TOP_DEPTH = 12
#: Vectors of a group on which its splits are fitted; the rest of a larger group only passes through them.
HOLD = 100_000
BLOCK = 2048


def _direction(x: np.ndarray, rng) -> np.ndarray:
    """A unit vector between two of the vectors, with noise."""
    way = x[rng.integers(len(x))] - x[rng.integers(len(x))]
    if np.linalg.norm(way) < 1e-6:
        way = rng.normal(size=x.shape[1])
    way = way + 0.3 * np.linalg.norm(way) * rng.normal(size=len(way)) / math.sqrt(len(way))
    return way / np.linalg.norm(way)


class Tree:
    """Splits (direction, median) of one tree by node; nodes without a split are leaves."""

    def __init__(self, sample: np.ndarray, leaf: float, margin: float, seed: int, most_depth: int = 60):
        rng = np.random.default_rng(seed)
        self.margin, self.seed, self.splits = margin, seed, {}
        todo = [(1, np.arange(len(sample)), 0)]
        while todo:
            node, own, depth = todo.pop()
            if len(own) <= leaf or depth >= most_depth:
                continue
            x = sample[own]
            for _ in range(4):
                way = _direction(x, rng)
                y = x @ way
                middle = float(np.median(y))
                left, right = y <= middle + margin, y >= middle - margin
                if max(left.sum(), right.sum()) <= 0.85 * len(own):
                    self.splits[node] = (way, middle)
                    todo += [(2 * node, own[left], depth + 1), (2 * node + 1, own[right], depth + 1)]
                    break

    def leaves(self, x: np.ndarray):
        """(vector, leaf) pairs: a vector within the overlap goes both ways."""
        who, where, todo = [], [], [(1, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            split = self.splits.get(node)
            if split is None or not len(own):
                code = _text.mix(np.array([self.seed, node & 0xFFFFFFFFFFFFFFFF], np.uint64))
                who.append(own)
                where.append(np.full(len(own), _text.mix(code[:1] * np.uint64(3) + code[1:])[0]))
                continue
            y = x[own] @ split[0]
            todo += [(2 * node, own[y <= split[1] + self.margin]), (2 * node + 1, own[y >= split[1] - self.margin])]
        return np.concatenate(who), np.concatenate(where)


def unit(batch, column: str = "embedding"):
    """Unit vectors in double precision and the rows that have one: not null, not zero, all components finite."""
    lists = batch.column(column).to_pylist()
    rows, out = [], []
    for i, v in enumerate(lists):
        if not v or any(c is None for c in v):
            continue
        a = np.array(v, np.float64)
        n = np.linalg.norm(a)
        if np.isfinite(a).all() and n > 0 and np.isfinite(n):
            rows.append(i)
            out.append(a)
    return rows, out


def _grouped(batches, keys: tuple[str, ...], most_rows: int = 1 << 62):
    """(key, table) of each run of equal keys of sorted batches; a run of more than ``most_rows`` comes in parts of about that size."""
    held, key, rows = [], None, 0
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c).to_numpy(zero_copy_only=False) for c in keys]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edge = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            own = tuple(c[s] for c in columns)
            if held and (own != key or rows >= most_rows):
                yield key, pa.Table.from_batches(held)
                held, rows = [], 0
            key = own
            held.append(b.slice(s, e - s))
            rows += e - s
    if held:
        yield key, pa.Table.from_batches(held)


def _matrix(column, dims: int) -> np.ndarray:
    buf, _ = _text.column_bytes(column)
    return np.frombuffer(buf.tobytes(), np.float64).reshape(-1, dims)


def _shared(codes_x, codes_y, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Incidence of the codes smaller than ``below`` that are in both lists: their product is above 0 where two vectors share one."""

    def flat(codes):
        at = codes.offsets.to_numpy()
        value = codes.flatten().to_numpy()
        owner = np.repeat(np.arange(len(codes)), np.diff(at))
        keep = value < below
        return owner[keep], value[keep]

    (ox, vx), (oy, vy) = flat(codes_x), flat(codes_y)
    both = np.intersect1d(vx, vy)
    x, y = (np.zeros((len(c), max(1, len(both))), np.float32) for c in (codes_x, codes_y))
    for table, owner, value in ((x, ox, vx), (y, oy, vy)):
        if len(both):
            at = np.minimum(np.searchsorted(both, value), len(both) - 1)
            hit = both[at] == value
            table[owner[hit], at[hit]] = 1
    return x, y


def _block(left, right, dims: int, code: int, cosine: float):
    """Links of the vectors of two blocks of a leaf (``right`` None: of one with itself): (point, links, spanning edge's other end)."""
    a, x, n = left.column("point").to_numpy(), _matrix(left.column("v"), dims), left.column("n").to_numpy().astype(np.float64)
    codes = left.column("codes").combine_chunks()
    same = right is None
    right = left if same else right
    b, y, m = right.column("point").to_numpy(), _matrix(right.column("v"), dims), right.column("n").to_numpy().astype(np.float64)
    ex, ey = _shared(codes, right.column("codes").combine_chunks(), code)
    link_a, link_b = np.zeros(len(a)), np.zeros(len(b))
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for s in range(0, len(a), 256):
        e = min(len(a), s + 256)
        near = (x[s:e] @ y.T) >= cosine - 1e-9
        if same:
            near &= a[s:e, None] != b[None, :]
        i, j = np.nonzero(near)
        exact = np.einsum("ij,ij->i", x[s + i], y[j]) >= cosine if len(i) < 1 << 16 else np.concatenate([np.einsum("ij,ij->i", x[s + i[k : k + 65536]], y[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)])
        near[i[~exact], j[~exact]] = False
        u, v = forest(np.concatenate([u, a[s + i[exact]]]), np.concatenate([v, b[j[exact]]])) if exact.any() else (u, v)
        fresh = near & ~((ex[s:e] @ ey.T) > 0)
        link_a[s:e] += fresh @ m
        if not same:
            link_b += n[s:e] @ fresh
    points = a if same else np.concatenate([a, b])
    links = link_a if same else np.concatenate([link_a, link_b])
    some = links > 0
    return np.concatenate([points[some], u]), np.concatenate([links[some], np.zeros(len(u))]).astype(np.int64), pa.array(np.concatenate([np.zeros(int(some.sum()), np.int64), v]), mask=np.concatenate([np.ones(int(some.sum()), bool), np.zeros(len(v), bool)]))


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, margin: float = MARGIN,
    group: int = GROUP, hold: int = HOLD, block: int = BLOCK, same_label: bool = True, seed: int = 5,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null and their cosine
    is at least ``cosine``.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and so do vectors of different
    lengths.  n_links counts the other vectors linked directly, copies
    included; component_id is the smallest vec_id reachable.  Repeated rows
    are copies of each other.  A null vec_id links like any other and has no
    say in component_id.  Extra columns are ignored.  An empty table gives an
    empty table.
    """
    spark = vectors.sparkSession
    label = F.col("label").cast("long") if same_label else F.lit(0).cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    code = F.when(F.col("label").isNotNull() & (F.size("embedding") > 0), F.xxhash64("label", "embedding"))
    rows = rows.withColumn("point", code)
    points = rows.where("point is not null").groupBy("point").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    good = pa.schema([("point", pa.int64()), ("vec_id", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()), ("v", pa.binary())])

    def normalise(batches):
        for b in batches:
            keep, x = unit(b)
            if keep:
                take = pa.array(keep)
                # scaled first, so that very large and very small components do not overflow
                x = [v / np.abs(v).max() for v in x]
                yield _text.batch_of(
                    good, **{c: b.column(c).take(take) for c in ("point", "vec_id", "n", "label")}, dims=[len(v) for v in x],
                    v=[(v / np.linalg.norm(v)).tobytes() for v in x],
                )

    clean = stored(points.mapInArrow(normalise, "point long, vec_id long, n long, label long, dims int, v binary"))
    sizes = clean.groupBy("label", "dims").agg(F.count("*").alias("size")).agg(F.sum("size"), F.max("size"), F.max_by("dims", "size")).first()
    total, largest, dims = (int(x or 0) for x in sizes)
    top = _top_forest(clean, total, largest, dims, trees, sample, margin, group, seed)
    model = spark.sparkContext.broadcast((top, dims))
    placed_schema = pa.schema([("label", pa.int64()), ("dims", pa.int32()), ("tree", pa.int32()), ("top", pa.int64()), ("rank", pa.int64()), ("point", pa.int64()), ("v", pa.binary())])

    def place(batches):
        top, dims = model.value
        for b in batches:
            d = b.column("dims").to_numpy()
            for size in np.unique(d):
                own = b.filter(pa.array(d == size))
                point = own.column("point").to_numpy()
                rank = _text.mix(point.view(np.uint64)).view(np.int64)  # a task's first vectors are a sample of its group
                if size == dims and top:
                    x = _matrix(own.column("v"), int(size))
                    found = [(t, *tree.leaves(x)) for t, tree in enumerate(top)]
                else:
                    found = [(-1, np.arange(len(point)), np.zeros(len(point), np.uint64))]
                for t, who, at in found:
                    take = pa.array(who)
                    yield _text.batch_of(
                        placed_schema, tree=np.full(len(who), t, np.int32), top=at.view(np.int64), rank=rank[who],
                        **{c: own.column(c).take(take) for c in ("label", "dims", "point", "v")},
                    )

    coded = pa.schema([("point", pa.int64()), ("code", pa.int64())])

    def descend(batches):
        """Codes of the leaves of each vector of a group, by splits fitted on its first vectors."""
        last, forest_ = None, []
        for key, part in _grouped(batches, ("label", "dims", "tree", "top"), hold):
            x = _matrix(part.column("v"), int(key[1]))
            if key != last:
                last = key
                salt = int(_text.mix(np.array([key[0], key[3]], np.int64).view(np.uint64)).sum() & np.uint64(0xFFFFFFFFFFFF))
                forest_ = [Tree(x, leaf, margin, salt + 7919 * (seed + t)) for t in (range(trees) if key[2] < 0 else (int(key[2]),))]
            point = part.column("point").to_numpy()
            for tree in forest_:
                who, at = tree.leaves(x)
                yield _text.batch_of(coded, point=point[who], code=_text.mix(at + np.uint64(int(key[1]))).view(np.int64))

    keys = ("label", "dims", "tree", "top")
    copies = trees if top else 1
    parts = partitions_for(spark, total * dims * 8 * copies, 8 << 20)
    placed = clean.select("point", "label", "dims", "v").mapInArrow(place, "label long, dims int, tree int, top long, rank long, point long, v binary")
    placed = placed.repartition(parts, *keys).sortWithinPartitions(*keys, "rank")
    leaves = stored(placed.mapInArrow(descend, "point long, code long").distinct())
    # a vector's leaves: as many as it has trees, times its overlaps
    held = leaves.groupBy("point").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    blocks = F.ceil(F.count("*") / F.lit(float(block))).cast("int")
    rooms = leaves.groupBy("code").agg(F.count("*").alias("size"), blocks.alias("blocks")).where("size > 1")
    mine = F.pmod(F.xxhash64("point", "code"), F.col("blocks")).cast("int")
    spread = (
        leaves.join(rooms.select("code", "blocks"), "code").join(held, "point").join(clean.select("point", "dims", "n", "v"), "point")
        .withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("code", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "dims", "point", "n", "codes", "v")
    )
    result = pa.schema([("point", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def compare(batches):
        for (code, lo, hi), table in _grouped(batches, ("code", "lo", "hi")):
            size = int(table.column("dims")[0].as_py())
            if lo == hi:
                got = _block(table, None, size, code, cosine)
            else:
                first = pa.array(table.column("mine").to_numpy() == lo)
                left, right = table.filter(first), table.filter(pc.invert(first))
                if not left.num_rows or not right.num_rows:
                    continue
                got = _block(left, right, size, code, cosine)
            if len(got[0]):
                yield _text.batch_of(result, point=got[0], links=got[1], other=got[2])

    order = ("code", "lo", "hi")
    parts = partitions_for(spark, 2 * total * dims * 8 * trees, 8 << 20)
    found = stored(spread.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(compare, "point long, links long, other long"))
    links = found.where("links > 0").groupBy("point").agg(F.sum("links").alias("links"))
    label_of = components(found.where("other is not null").select(F.col("point").alias("u"), F.col("other").alias("v")))
    named = clean.select("point", "n", "vec_id").join(label_of.select(F.col("u").alias("point"), F.col("v").alias("c")), "point", "left").withColumn("c", F.coalesce("c", "point"))
    least = named.groupBy("c").agg(F.min("vec_id").alias("least"))
    named = named.join(least, "c").join(links, "point", "left").select("point", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least")
    out = rows.select("vec_id", "point").join(named, "point", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _top_forest(clean: DataFrame, total: int, largest: int, dims: int, trees: int, sample: int, margin: float, group: int, seed: int) -> list[Tree]:
    """Top trees, none where every label fits a group; fitted on at most ``sample`` vectors of the most frequent length."""
    if largest <= group:
        return []
    some = clean.where(F.col("dims") == dims).orderBy(F.xxhash64("point", F.lit(seed))).limit(sample).select("v").toArrow()
    x = _matrix(some.column("v"), dims)
    depth = min(TOP_DEPTH, math.ceil(math.log2(largest / group)))
    return [Tree(x, max(8.0, len(x) * group / largest), margin, seed * 1000 + t, depth) for t in range(trees)]

"""Candidate groups by shared signatures, and the exact links within them.

A map function emits (signature, id) pairs packed into binary blocks, one for
each range of signatures, so the shuffle moves 14 bytes a pair.  Reducers keep
only signatures that at least two ids share.  Links are then found without
listing a group's pairs: each group is compared with a leader, the verified
links are joined to components, and only members that are still apart are
compared further, by other leaders and at last with each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._graph import components
from millrace.llm._store import forget, spread_join, stored

BLOCK = pa.schema([("bucket", pa.int32()), ("heavy", pa.bool_()), ("block", pa.binary())])
BLOCK_DDL = "bucket int, heavy boolean, block binary"
#: Signatures that a sample finds frequent, at most; their pairs are dealt out by id.
HEAVY = 10_000
#: How often a signature must be in the sample, which holds every ``SAMPLED``-th text.
OFTEN, SAMPLED = 64, 64
_LOW = np.uint64((1 << 48) - 1)
#: Pairs that a task gathers before it emits blocks.
GATHER = 1 << 19


class Packer:
    """Gathers (signature, id) pairs of a task and turns them into blocks by signature range."""

    def __init__(self, bits: int, heavy: np.ndarray = np.zeros(0, np.uint64)):
        """heavy: sorted signatures, as heavy_signatures() finds them."""
        self.bits, self.heavy, self.held, self.n = bits, heavy, [], 0

    def add(self, sig: np.ndarray, ident: np.ndarray):
        """Blocks to emit now, usually none."""
        self.held.append((sig, ident))
        self.n += len(sig)
        return self.flush() if self.n >= GATHER else ()

    def flush(self):
        if not self.n:
            return
        sig, ident = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        often = _isin_sorted(self.heavy, sig)
        yield from self._blocks(sig[~often], ident[~often], (sig[~often] >> np.uint64(64 - self.bits)).astype(np.int64), False)
        sig, ident = sig[often], ident[often]
        yield from self._blocks(sig, ident, (_text.mix(ident.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64), True)

    def _blocks(self, sig: np.ndarray, ident: np.ndarray, bucket: np.ndarray, heavy: bool):
        if not len(sig):
            return
        order = np.argsort(bucket if heavy else sig, kind="stable")
        sig, ident, bucket = sig[order], ident[order], bucket[order]
        # 48 bits travel: the place among the heavy ones, or the bits after the bucket's
        part = np.searchsorted(self.heavy, sig).astype(np.uint64) if heavy else _low_bits(sig, self.bits)
        row = np.concatenate([part.view(np.uint8).reshape(-1, 8)[:, :6], ident.view(np.uint8).reshape(-1, 8)], axis=1)
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        end = np.append(start[1:], len(bucket))
        for i in range(0, len(start), 256):
            part = [row[s:e].tobytes() for s, e in zip(start[i : i + 256], end[i : i + 256], strict=True)]
            yield _text.batch_of(BLOCK, bucket=bucket[start[i : i + 256]].astype(np.int32), heavy=[heavy] * len(part), block=part)


def _low_bits(sig: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits of a signature after those of its bucket."""
    return (sig << np.uint64(bits)) >> np.uint64(16)


def _isin_sorted(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def heavy_signatures(docs: DataFrame, sign, key: str = "doc_id") -> np.ndarray:
    """Sorted signatures found ``OFTEN`` times in a sample of ``docs``; ``sign(packer)`` makes the map function.

    They only decide to which tasks pairs go.
    """
    schema = pa.schema([("sig", pa.int64())])

    class Every:
        """Gathers signatures as a Packer does."""

        def add(self, sig, ident):
            for s in range(0, len(sig), 500_000):
                yield _text.batch_of(schema, sig=sig[s : s + 500_000].view(np.int64))

        def flush(self):
            return ()

    some = docs.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(SAMPLED)) == 0)
    counts = some.mapInArrow(sign(Every), "sig long").groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.desc("n"), "sig").limit(HEAVY).select("sig").toArrow()
    return np.sort(rows.column("sig").to_numpy().view(np.uint64))


def bucket_bits(partitions: int) -> int:
    """Ranges of signatures: about 16 for each partition, 2**16 at most, as 48 more bits travel."""
    return min(16, max(4, (partitions * 12).bit_length()))


def groups(blocks: DataFrame, partitions: int, bits: int, heavy: np.ndarray = np.zeros(0, np.uint64)) -> DataFrame:
    """(sig, id, n): signatures that two or more ids share, with all their ids and how many they are.

    The ids of heavy signatures are in several tasks, each with its own number.
    """
    schema = pa.schema([("sig", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])

    code = ((heavy >> np.uint64(64 - bits)) << np.uint64(48)) | _low_bits(heavy, bits)

    def reduce(batches):
        held: dict[tuple, list] = {}
        for b in batches:
            for k, h, x in zip(b.column("bucket").to_pylist(), b.column("heavy").to_pylist(), b.column("block"), strict=True):
                held.setdefault((k, h), []).append(np.frombuffer(x.as_buffer(), np.uint8).copy())
        for k, often in sorted(held):
            row = np.concatenate(held.pop((k, often))).reshape(-1, 14)
            sig = np.zeros((len(row), 8), np.uint8)
            sig[:, :6] = row[:, :6]
            sig = sig.view(np.uint64).ravel()
            ident = np.ascontiguousarray(row[:, 6:]).view(np.int64).ravel()
            if often:
                pair = np.unique(np.column_stack([sig.view(np.int64), ident]), axis=0)
                yield _text.batch_of(schema, sig=code[pair[:, 0]].view(np.int64), id=pair[:, 1], n=np.bincount(pair[:, 0])[pair[:, 0]])
                continue
            order = np.argsort(sig)
            sig, ident = sig[order], ident[order]
            same = sig[1:] == sig[:-1]
            some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            sig, ident = sig[some], ident[some]
            order = np.lexsort((ident, sig))
            sig, ident = sig[order], ident[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (ident[1:] != ident[:-1])
            sig, ident = sig[new], ident[new]
            if not len(sig):
                continue
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            count = np.diff(np.append(start, len(sig)))
            count = np.repeat(count, count)
            keep = count > 1
            if keep.any():
                full = (sig[keep] | np.uint64(k << 48)).view(np.int64)
                yield _text.batch_of(schema, sig=full, id=ident[keep], n=count[keep])

    return blocks.repartition(partitions, "bucket").mapInArrow(reduce, "sig long, id long, n long")


def sketch(values: np.ndarray, finer: int = 0) -> bytes:
    """Counts of a set's values by their lowest bits, in about size / 2 classes, or 2 ** finer times as many; bounds an intersection from above."""
    bits = max(3, min(14, (len(values) // 2).bit_length() + finer))
    count = np.bincount((values & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.minimum(count, 65535).astype(np.uint16).tobytes() if count.max() > 255 else count.astype(np.uint8).tobytes() + b"\1"


def _counts(x: bytes) -> np.ndarray:
    return (np.frombuffer(x[:-1], np.uint8) if len(x) & 1 else np.frombuffer(x, np.uint16)).astype(np.int32)


def _folded(x: np.ndarray, classes: int) -> np.ndarray:
    """The same counts in fewer classes: classes are the lowest bits, so they nest."""
    return x if len(x) == classes else x.reshape(-1, classes).sum(0)


def may_link(x: bytes, y: bytes, nx: int, ny: int, percent: int) -> bool:
    """False only if the sketches prove that the similarity is below the threshold."""
    a, b = _counts(x), _counts(y)
    classes = min(len(a), len(b))
    most = int(np.minimum(_folded(a, classes), _folded(b, classes)).sum())
    return 100 * most >= percent * (nx + ny - most)


#: Members of a group that meet in one task; larger groups are cut into blocks, compared two by two.
BLOCK_MEMBERS = 4096
#: Elements that a sample of the sets finds frequent, at most; they only decide the order in which elements are compared.
FREQUENT = 1 << 18
#: Bytes of prefixes that a task compares at once, and candidates that it tries at once.
COMPARED, TRIED = 8 << 20, 1 << 20


def frequent_elements(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Elements found in three or more of every eighth set of (id, s), sorted, and their ranks, the rarest first: a cost estimate, not a filter."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in _text.pieces(batches, "s"):
            h, n = np.unique(_text.column_bytes(b.column("s"))[0].view(np.int64), return_counts=True)
            yield _text.batch_of(schema, h=h, n=n)

    some = sets.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(8)) == 0)
    count = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 3")
    rows = count.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - order).astype(np.uint64)


def prefixes(s: pa.Array, often: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of sets (sorted 64-bit values) and their first elements, as 32-bit names, in one order for all sets: the rare ones first.

    Sets that are linked share an element among the first
    ``size * (100 - percent) // 100 + 1`` of each.
    """
    buf, offs = _text.column_bytes(s)
    values, at = np.frombuffer(buf.tobytes(), np.uint64), offs // 8
    size = np.diff(at)
    place = np.minimum(np.searchsorted(often, values), max(0, len(often) - 1))
    known = often[place] == values if len(often) else np.zeros(len(values), bool)
    name = _text.mix(values ^ np.uint64(0xA0761D6478BD642F))
    key = name >> np.uint64(20)
    key[known] |= rank[place[known]] << np.uint64(44)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((key, owner))
    first = np.arange(len(values)) - at[owner] <= size[owner] * (100 - percent) // 100
    name = (name[order[first]] >> np.uint64(32)).astype(np.uint32)
    return size, name


def near_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of one group but two components; every linked one is among them.

    ``rest`` has (sig, id, c), ``sets`` (id, s: sorted 64-bit values) for its ids.  If the
    elements of all sets stand in one order, two linked sets share an element
    at places that leave enough elements behind them.  With the rare elements
    first, copies of one text with many edits each begin with their own edits, so that the pairs
    tried grow with the members of a group and not with their square.
    Blocks of a group meet in one task and only candidates leave it.
    """
    model = rest.sparkSession.sparkContext.broadcast(frequent_elements(sets))
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    short = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("prefix", pa.binary()), ("sketch", pa.binary())])

    def shorten(batches):
        for b in _text.pieces(batches, "s"):
            size, name = prefixes(b.column("s"), *model.value, percent)
            offs = np.concatenate([[0], np.cumsum(4 * (size * (100 - percent) // 100 + (size > 0)))]).astype(np.int32)
            prefix = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(name)])
            sketches = [sketch(np.frombuffer(x.as_buffer(), np.uint64), 1) for x in b.column("s")]
            yield _text.batch_of(short, id=b.column("id"), size=size, prefix=prefix, sketch=sketches)

    total = rest.count()
    sizes = rest.groupBy("sig").agg(F.ceil(F.count("*") / F.lit(float(BLOCK_MEMBERS))).cast("int").alias("blocks"), F.count("*").alias("n"))
    rows = spread_join(rest.select("sig", "id", "c"), sizes, ["sig"], ["id"], total).drop("n").join(sets.mapInArrow(shorten, "id long, size long, prefix binary, sketch binary"), "id")
    mine = F.pmod(F.xxhash64("id", "sig"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "c", "size", "prefix", "sketch")
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches):
        held, size, limit = [], 0, COMPARED
        for b in batches:
            held.append(b)
            size += b.column("prefix").nbytes
            if size < limit:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            last = int(_group_starts(rows)[-1])  # the last group may go on
            if last:
                yield from _candidates(rows.slice(0, last), percent, pair)
            held = rows.slice(last).to_batches()
            size = sum(x.column("prefix").nbytes for x in held)
            limit = max(COMPARED, 2 * size)
        if held:
            yield from _candidates(pa.Table.from_batches(held).combine_chunks(), percent, pair)

    keys = ("sig", "lo", "hi")
    parts = max(parts, -(-total // 100_000))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long").distinct()


def _group_starts(rows: pa.Table) -> np.ndarray:
    keys = [rows.column(c).to_numpy() for c in ("sig", "lo", "hi")]
    new = np.ones(rows.num_rows, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _candidates(rows: pa.Table, percent: int, schema: pa.Schema):
    """Pairs of whole groups, each of two blocks or of one block with itself, that share an element early enough and that the sketches leave possible."""
    start = _group_starts(rows)
    count = np.diff(np.append(start, rows.num_rows))
    group = np.repeat(np.arange(len(start)), count)
    ident, mine, size = (rows.column(c).to_numpy().astype(np.int64) for c in ("id", "mine", "size"))
    comp = np.unique(rows.column("c").to_numpy(), return_inverse=True)[1]
    one_block = rows.column("lo").to_numpy() == rows.column("hi").to_numpy()
    least = np.repeat(np.minimum.reduceat(size, start), count)
    buf, offs = _text.column_bytes(rows.column("prefix"))
    names, at = np.frombuffer(buf.tobytes(), np.uint32), offs // 4
    turns = max(1, -(-len(names) // (COMPARED // 2)))
    found = [np.zeros(0, np.int64)]
    for turn in range(turns):
        take = np.flatnonzero(names % np.uint32(turns) == turn) if turns > 1 else np.arange(len(names))
        row = np.searchsorted(at, take, "right") - 1
        # an element at this place is the first shared one only with sets of at most reach / percent elements
        reach = 100 * size[row] - (100 + percent) * (take - at[row])
        use = reach >= percent * least[row]
        take, row, reach = take[use], row[use], reach[use]
        key = group[row].astype(np.uint64) << np.uint64(32) | names[take]
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
        order = order[np.lexsort((comp[row[order]], key[order]))]
        if not len(order):
            continue
        row, reach, key = row[order], reach[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.concatenate([[True], new[1:] | (comp[row[1:]] != comp[row[:-1]])])
        place = np.arange(len(row))
        list_start = np.maximum.accumulate(np.where(new, place, 0))
        other = np.maximum.accumulate(np.where(run, place, 0)) - list_start  # members of other components before
        total = np.concatenate([[0], np.cumsum(other)])
        s = 0
        while s < len(row):
            e = max(s + 1, int(np.searchsorted(total, total[s] + TRIED, "right")) - 1)
            x = np.repeat(place[s:e], other[s:e])
            y = list_start[x] + np.arange(len(x)) - (total[x] - total[s])
            i, j = row[x], row[y]
            fit = (percent * size[i] <= reach[y]) & (percent * size[j] <= reach[x]) & (one_block[i] | (mine[i] != mine[j]))
            i, j = i[fit], j[fit]
            code = np.unique(np.minimum(i, j) * rows.num_rows + np.maximum(i, j))
            i, j = np.divmod(code, rows.num_rows)
            found.append(code[_possible(rows.column("sketch"), size, i, j, percent)])
            if sum(map(len, found)) > TRIED:
                found = [np.unique(np.concatenate(found))]
                if len(found[0]) > TRIED // 2:
                    yield _pairs(found.pop(), ident, schema)
            s = e
    yield _pairs(np.concatenate([np.zeros(0, np.int64), *found]), ident, schema)


def _possible(sketches, size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows the sketches leave possible, as may_link() does for one pair."""
    keep = np.zeros(len(i), bool)
    own, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    counts = [_counts(x) for x in sketches.take(pa.array(own)).to_pylist()]
    length = np.array([len(x) for x in counts], np.int64)
    a, b = at[: len(i)], at[len(i) :]
    classes = np.minimum(length[a], length[b])
    for c in np.unique(classes):
        these = np.flatnonzero(classes == c)
        used, place = np.unique(np.concatenate([a[these], b[these]]), return_inverse=True)
        table = np.stack([_folded(counts[k], c) for k in used])
        table = table.astype(np.uint8) if table.max() < 256 else table
        x, y = place[: len(these)], place[len(these) :]
        step = max(1, (1 << 22) // int(c))
        for s in range(0, len(these), step):
            most = np.minimum(table[x[s : s + step]], table[y[s : s + step]]).sum(1, dtype=np.int64)
            p = these[s : s + step]
            keep[p] = 100 * most >= percent * (size[i[p]] + size[j[p]] - most)
    return keep


def _pairs(code: np.ndarray, ident: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    a, b = ident[code // len(ident)], ident[code % len(ident)]
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return _text.batch_of(schema, a=a[new], b=b[new])


def linked(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], percent: int, rounds: int = 2) -> DataFrame:
    """Edges (u, v) whose components are those of all verified pairs within groups.

    ``members`` has (sig, id, n).  ``sets_of`` gives (id, s: sorted 64-bit values) for
    distinct ids.  ``verify`` takes distinct pairs (a, b), a < b, and returns those that are linked.  A group's leader is its member
    with the most company over all groups: of a text and its edited copies
    that is the text itself, which shares every unedited part, so one turn
    joins them.  Up to ``rounds`` turns are taken, each with a leader outside
    the component of the one before.  Then every pair of members that are in
    one group but not in one component is looked at, by their rarest elements within
    blocks and exactly where those leave it possible, so no link is lost.
    """
    company = members.groupBy("id").agg(F.sum("n").alias("w"))
    members = stored(members.select("sig", "id").join(company, "id"))
    total = members.count()
    rank = F.struct("w", F.col("id"))
    lead = members.groupBy("sig").agg(F.max_by("id", rank).alias("l"), F.count("*").alias("n"))
    pairs = spread_join(members, lead, ["sig"], ["id"], total).where("id <> l")
    pairs = pairs.select(F.least("id", "l").alias("a"), F.greatest("id", "l").alias("b")).distinct()
    edges = None
    for _ in range(rounds):
        good = verify(pairs).select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = stored(good if edges is None else edges.unionByName(good))
        comp = components(edges).select(F.col("u").alias("id"), F.col("v").alias("c"))
        now = members.join(comp, "id", "left").withColumn("c", F.coalesce("c", "id"))
        ids = F.sum(F.xxhash64("id").cast("decimal(38,0)"))
        apart = now.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), ids.alias("ids"), F.max_by("c", rank).alias("top"), F.count("*").alias("n")).where("lo <> hi")
        apart = apart.groupBy("ids").agg(F.min_by(F.struct("sig", "top", "n"), "sig").alias("x")).select("x.*")  # groups of the same ids once
        rest = stored(spread_join(now, apart, ["sig"], ["id"], total).drop("n"))
        if not rest.head(1):
            forget(members)
            return edges
        other = F.when(F.col("c") != F.col("top"), rank)
        lead = rest.groupBy("sig").agg(F.max_by(F.struct("id", "c"), other).alias("l"), F.count("*").alias("n"))
        pairs = spread_join(rest, lead, ["sig"], ["id"], total).where("c <> l.c")
        pairs = pairs.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b")).distinct()
    forget(members)
    pairs = near_pairs(rest, stored(sets_of(rest.select("id").distinct())), percent)
    return stored(edges.unionByName(verify(pairs).select(F.col("a").alias("u"), F.col("b").alias("v"))))

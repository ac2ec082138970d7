"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Sets whose sizes fall in one size band, or on both sides of a band's edge, are
matched under one scheme.  A scheme bounds the symmetric difference H of linked
sets, cuts the hash universe into segments and so every set into subsets.  If
two linked sets differ in at most H elements and the segments' budgets exceed
H, some segment's subsets are equal (budget 1), or differ by at most one element
where a segment also indexes the subsets with one element left out (budget 2).
``allocate`` picks the cheaper mix for each scheme.

Empty subsets, and subsets of very common shingles only, are not selective and
are not indexed.  ``slack`` extra segments pay for them.  A set with more such
segments than the slack indexes all its non-empty subsets too; one with more
empty segments than that is indexed again under other hash seeds, and in the end
by one common signature.  So every linked pair shares an indexed signature, and
verification is exact.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._graph import components
from millrace.llm._store import free_name, input_bytes, key_filter, maybe_in, partitions_for, spread_join, stored
from millrace.llm.candidates import BLOCK_DDL, Packer, bucket_bits, groups, heavy_signatures, linked, may_link, sketch
from millrace.llm.paragraphs import verified

#: Ratio of the largest to the smallest size of a band.
BAND = 1.7
SEEDS = 8
#: Bound of the broadcast list of common shingles; it only steers which subsets are indexed.
COMMON = 100_000


class Scheme:
    """Sizes lo to hi, at most ``h`` differing elements, m segments of which the first q index deletions."""

    def __init__(self, name: int, lo: int, hi: int, largest_sum: int, percent: int):
        self.name, self.lo, self.hi = name, lo, hi
        self.h = largest_sum * (100 - percent) // (100 + percent)
        self.m, self.q, self.slack = self.allocate()

    def allocate(self):
        """The mix of segments with the lowest expected number of signatures for a set of middling size."""
        size = (self.lo + self.hi) / 2
        small = -(-(self.h + 1) // 2)
        options = [(small + size, (small, self.h + 1 - small, 0))]
        slack = 0
        while slack <= self.h:
            m = self.h + 1 + slack
            empty = m * math.exp(-self.lo / m)
            if empty + 2 * math.sqrt(empty) <= slack:
                options.append((m, (m, 0, slack)))
                break
            slack += max(1, self.h // 50)
        return min(options)[1]


def schemes(largest: int, percent: int) -> list[Scheme]:
    """In-band and edge schemes for set sizes up to ``largest``; sizes at which only equal sets can be linked need none."""
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo, math.ceil(lo * BAND) - 1)
        out.append(Scheme(len(out), lo, hi, 2 * hi, percent))
        above = hi * 100 // percent
        if above > hi:  # pairs r <= hi < s
            out.append(Scheme(len(out), -(-(hi + 1) * percent // 100), above, hi + above, percent))
        lo = hi + 1
    return [s for s in out if s.h > 0]


class Plan:
    """Arrays over set sizes for a vectorised choice of schemes: at most ``slots`` schemes hold a size."""

    def __init__(self, largest: int, percent: int):
        self.of = schemes(largest, percent)
        self.limit = largest
        slots: list[np.ndarray] = []
        for k, s in enumerate(self.of):
            for slot in slots:
                if (slot[s.lo : s.hi + 1] < 0).all():
                    slot[s.lo : s.hi + 1] = k
                    break
            else:
                slots.append(np.full(largest + 2, -1, np.int32))
                slots[-1][s.lo : s.hi + 1] = k
        self.slots = slots
        self.m = np.array([s.m for s in self.of], np.int64)
        self.q = np.array([s.q for s in self.of], np.int64)
        self.slack = np.array([s.slack for s in self.of], np.int64)
        self.salt = _text.mix(np.arange(1, len(self.of) + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) if self.of else np.zeros(0, np.uint64)


def _signatures(plan: Plan, k: np.ndarray, ident: np.ndarray, values: np.ndarray, at: np.ndarray, common: np.ndarray, seed: int):
    """Signatures of sets (values sorted within each) under scheme k of each, and the sets to be indexed under another seed."""
    m, q, size = plan.m[k], plan.q[k], np.diff(at)
    owner = np.repeat(np.arange(len(k)), size)
    h = values if not seed else _text.mix(values + np.uint64(seed * 0x8CB92BA72F3D8DD7 & ((1 << 64) - 1)))
    part = (((h >> np.uint64(32)) * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    base = np.zeros(len(k) + 1, np.int64)
    np.cumsum(m, out=base[1:])
    cell = base[owner] + part
    weight = _text.mix(values ^ np.uint64(0x5851F42D4C957F2D))
    if seed:
        order = np.argsort(cell, kind="stable")
        cell, weight, common = cell[order], weight[order], common[order]
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    used = cell[start]
    total = np.add.reduceat(weight, start)
    rare = np.add.reduceat((~common).astype(np.int64), start)
    row = np.searchsorted(base, used, "right") - 1
    seg = used - base[row]
    salt = _text.mix(plan.salt[k[row]] + seg.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
    filled = np.bincount(row, minlength=len(k))
    selective = np.bincount(row[rare > 0], minlength=len(k))
    slack = plan.slack[k]
    weak, empty = m - selective > slack, m - filled > slack
    mixed = q > 0  # schemes with deletions index every segment, empty ones too
    index = (rare > 0) | weak[row] | mixed[row]
    sig, who = [_text.mix(total[index] + salt[index])], [ident[row[index]]]
    deletes = seg < q[row]
    if mixed.any():
        pick = np.repeat(deletes, np.diff(np.append(start, len(cell))))
        lead = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(cell))))[pick]
        sig.append(_text.mix(total[lead] - weight[pick] + salt[lead]))
        who.append(ident[row[lead]])
        gap = np.flatnonzero(mixed & (filled < m))
        for i in gap:
            gone = np.setdiff1d(np.arange(m[i]), seg[row == i])
            own = _text.mix(plan.salt[k[i]] + gone.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
            sig.append(_text.mix(own))
            who.append(np.full(len(gone), ident[i]))
    return np.concatenate(sig), np.concatenate(who), np.flatnonzero(empty & ~mixed)


def set_signatures(plan: Plan, ident: np.ndarray, values: np.ndarray, at: np.ndarray, common: np.ndarray):
    """All (signature, id) pairs of some sets: ``values[at[i]:at[i + 1]]`` sorted and distinct."""
    size = np.diff(at)
    for slot in plan.slots:
        k = slot[np.minimum(size, plan.limit + 1)]
        rows = np.flatnonzero(k >= 0)
        for seed in range(SEEDS + 1):
            if not len(rows):
                break
            if seed == SEEDS:
                yield plan.salt[k[rows]], ident[rows]
                break
            count = size[rows]
            own = np.zeros(len(rows) + 1, np.int64)
            np.cumsum(count, out=own[1:])
            take = np.arange(own[-1]) + np.repeat(at[:-1][rows] - own[:-1], count)
            sig, who, left = _signatures(plan, k[rows], ident[rows], values[take], own, common[take], seed)
            yield sig, who
            rows = rows[left]


def _sets(b, shingle: int):
    """Sorted distinct shingles of each text of a piece, concatenated, and their offsets; and the sets' identities."""
    h, _, _, first = _text.words(*_text.column_bytes(b.column("text")))
    s, at = _text.shingles(h, first, shingle)
    own = [np.unique(s[at[i] : at[i + 1]]) for i in range(b.num_rows)]
    out = np.zeros(len(own) + 1, np.int64)
    np.cumsum([len(x) for x in own], out=out[1:])
    values = np.concatenate(own) if own else np.zeros(0, np.uint64)
    ident = np.zeros(len(own), np.uint64)
    full = np.flatnonzero(np.diff(out))
    if len(full):
        ident[full] = _text.mix(np.add.reduceat(_text.mix(values), out[:-1][full]) + np.diff(out)[full].astype(np.uint64))
    return values, out, ident


def _common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles found in four or more of every 64th text, the most frequent ones: a cost estimate, not a filter."""
    schema = pa.schema([("h", pa.int64())])

    def run(batches):
        for b in _text.pieces(batches):
            values, _, _ = _sets(b, shingle)
            yield _text.batch_of(schema, h=values.view(np.int64))

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(64)) == 0)
    count = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 4")
    rows = count.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def jaccard_components(docs: DataFrame, percent: int = 80, shingle: int = 5, details: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union of their sets of
    distinct ``shingle``-word shingles (with fewer words, the whole sequence);
    component_id is the smallest doc_id reachable.  Texts without words, null
    or empty, link with nothing.  Equal sets are collapsed first, so groups of
    copies cost one set.  Repeated rows get a row each.  A null doc_id is no
    smallest id: its component_id is that of its group, or null.  Extra columns
    are ignored; an empty table gives an empty table.  ``details`` adds
    text_hash (xxhash64 of the text) and component (one number for each
    component of texts with words, null for others).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    parts = partitions_for(spark, input_bytes(docs), 6 << 20)
    bits = bucket_bits(parts)
    table = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("sketch", pa.binary())])

    def describe(batches):
        for b in _text.pieces(batches):
            values, at, ident = _sets(b, shingle)
            n = np.diff(at)
            yield _text.batch_of(
                table, doc_id=b.column("doc_id"), th=b.column("th"), n=n, id=pa.array(ident.view(np.int64), mask=n == 0),
                sketch=[sketch(values[at[i] : at[i + 1]], 1) if n[i] else None for i in range(len(n))],
            )

    every = stored(docs.mapInArrow(describe, "doc_id long, th long, n long, id long, sketch binary"))
    largest = every.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    model = spark.sparkContext.broadcast((Plan(int(largest), percent), _common_shingles(docs, shingle)))

    def sign(make, batches):
        plan, common = model.value
        packer = make()
        for b in _text.pieces(batches):
            values, at, ident = _sets(b, shingle)
            _, own = np.unique(ident, return_index=True)
            n = np.diff(at)
            own = own[n[own] > 0]
            keep = np.zeros(len(n), bool)
            keep[own] = True
            rows = np.repeat(keep, n)
            at = np.concatenate([[0], np.cumsum(n[keep])]).astype(np.int64)
            values = values[rows]
            place = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
            known = common[place] == values if len(common) else np.zeros(len(values), bool)
            for sig, who in set_signatures(plan, ident[keep], values, at, known):
                yield from packer.add(sig, who)
        yield from packer.flush()

    heavy = heavy_signatures(docs, lambda every: partial(sign, every))
    members = groups(docs.mapInArrow(partial(sign, lambda: Packer(bits, heavy)), BLOCK_DDL), parts, bits, heavy)
    sets_schema = pa.schema([("id", pa.int64()), ("s", pa.binary())])
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    facts = every.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))

    def possible(batches):
        for b in batches:
            x, y = b.column("xa").to_pylist(), b.column("xb").to_pylist()
            na, nb = b.column("na").to_pylist(), b.column("nb").to_pylist()
            keep = pa.array([may_link(*t, percent) for t in zip(x, y, na, nb, strict=True)], pa.bool_())
            yield _text.batch_of(pair, a=b.column("a").filter(keep), b=b.column("b").filter(keep))

    def verify(pairs):
        a = facts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("xa"))
        c = facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("xb"))
        near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        left = stored(pairs.join(a, "a").join(c, "b").where(near).mapInArrow(possible, "a long, b long"))
        return verified(left, sets_of(left.select(F.explode(F.array("a", "b")).alias("id")).distinct()), percent)

    def sets_of(wanted):
        home = stored(facts.join(wanted, "id").select("id", "doc_id"))
        filters = spark.sparkContext.broadcast((key_filter(home, "id"), key_filter(home, "doc_id")))

        def sets(batches):
            by_id, by_doc = filters.value
            for b in _text.pieces(batches):
                doc = b.column("doc_id").fill_null(0).to_numpy()
                ask = maybe_in(by_doc, doc) | b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                if not ask.any():
                    continue
                values, at, ident = _sets(b.filter(pa.array(ask)), shingle)
                own = np.flatnonzero((np.diff(at) > 0) & maybe_in(by_id, ident))
                if len(own):
                    yield _text.batch_of(sets_schema, id=ident[own].view(np.int64), s=[values[at[i] : at[i + 1]].tobytes() for i in own])

        return docs.mapInArrow(sets, "id long, s binary").dropDuplicates(["id"])

    edges = linked(members, sets_of, verify, percent)
    label = components(edges)
    # components of set identities become smallest document ids
    ids = facts.select("id", "doc_id").join(label.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    least = ids.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = ids.join(least, "c").select("id", "component_id", "c")
    component = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    more = [F.col("th").alias("text_hash"), F.col("c").alias("component")] if details else []
    return every.select("doc_id", "th", F.col("n").alias("n_shingles"), "id").join(named, "id", "left").select("doc_id", "n_shingles", component, *more)


def one_of_each(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, without those linked with an earlier document.

    Of each component the document stays that is first by doc_id (null last)
    and text hash.  Rows alike in doc_id and text are one document and stay or
    go together; another text of the same doc_id is another document.  Texts
    without words stay.
    """
    found = jaccard_components(docs, percent, shingle, details=True).where("component is not null").select("doc_id", "text_hash", "component")
    found = stored(found)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1")
    go = spread_join(found, first, ["component"], ["doc_id", "text_hash"], found.count()).where(order > F.col("f"))
    own_d, own_th, other_d, other_th = (free_name(docs.columns, x) for x in ("own_d", "own_th", "other_d", "other_th"))
    go = go.select(F.col("doc_id").alias(other_d), F.col("text_hash").alias(other_th)).distinct()
    keyed = docs.withColumns({own_d: F.col("doc_id").cast("long"), own_th: F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(go, F.col(own_d).eqNullSafe(F.col(other_d)) & (F.col(own_th) == F.col(other_th)), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

"""Exact substring dedup by a sampled, range-partitioned suffix array.

A string of ``length`` bytes is a window.  Its token is the window's anchor: the
byte string of ``GRAM`` bytes with the smallest hash in it, the leftmost on a
tie.  Equal windows have equal anchors at equal places, so only suffixes at
anchors, one in about a hundred bytes, travel.

1. A scan emits each anchor with the hash of its token and a digest of its
   reach, which is all windows that share it.  Tokens found once are done with.
2. A reach found twice is repeated as a whole.
3. For reaches that differ under one token, the windows are compared byte by
   byte: cells of ``CELL`` neighbouring windows go out with their text,
   range-partitioned by the leading bytes of what their windows share, with
   splitters sampled by Spark.  Every partition sorts its windows by multikey
   quicksort, eight bytes a step; windows that share all bytes are repeated.

Hashes of tokens only bring candidates together.  Step 2 decides by 128 bits of
a cryptographic digest of the bytes, step 3 by the bytes themselves.  Windows
with equal shared parts have equal range keys, so none of their copies is on
the other side of a partition boundary.  A text is named by doc_id and its
64-bit hash ``th``; two texts with one ``th`` would be taken for copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._store import forget, input_bytes, key_filter, maybe_in, partitions_for, spread_join, stored

LENGTH = 400
GRAM = 128
CELL = 64
#: Windows sorted at once where a group of cells is larger.
MOST_WINDOWS = 500_000
_STEP = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)


def _sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, in three passes whatever the width."""
    n = len(v) - width + 1
    full = -(-len(v) // width) * width
    padded = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(v)] = v
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Of each run of windows with one anchor: (text, first window, last window, anchor, token hash)."""
    n, width = len(buf), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    p, down = _text.prefix_hash(buf)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    first, last, anchor = [], [], []
    windows = n - length + 1
    for s in range(0, windows, _STEP):
        e = min(windows, s + _STEP)
        at = np.arange(s, e + width - 1)
        h = _text.mix((p[at + gram] - p[at]) * down[at])
        ordered = (h & ~_PLACE) | (at - s).astype(np.uint64)
        pick = (_sliding_minimum(ordered, width) & _PLACE).astype(np.int64) + s
        start = np.arange(s, e)
        whole = owner[start] == owner[start + length - 1]
        start, pick = start[whole], pick[whole]
        if not len(start):
            continue
        new = np.concatenate([[True], (pick[1:] != pick[:-1]) | (owner[start[1:]] != owner[start[:-1]])])
        head = np.flatnonzero(new)
        first.append(start[head])
        last.append(start[np.append(head[1:], len(start)) - 1])
        anchor.append(pick[head])
    if not first:
        return none, none, none, none, none.astype(np.uint64)
    first, last, anchor = np.concatenate(first), np.concatenate(last), np.concatenate(anchor)
    token = _text.mix((p[anchor + gram] - p[anchor]) * down[anchor])
    return owner[first], first, last, anchor, token


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of byte spans as two columns."""
    view, one = memoryview(buf), hashlib.blake2b
    made = b"".join([one(view[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def repeated_windows(buf: np.ndarray, starts: np.ndarray, length: int, group: np.ndarray) -> np.ndarray:
    """Mask of the windows whose ``length`` bytes occur at another start with the same group.

    Multikey quicksort: windows are split by group, then by their next eight
    bytes; a window alone in its part leaves, the others go on to the next
    eight.  At the end those left share everything with a neighbour.
    """
    out = np.zeros(len(starts), bool)
    live = np.arange(len(starts))
    part = np.unique(group, return_inverse=True)[1].astype(np.int64)
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)
    for depth in range(-8, length, 8):
        if depth >= 0:
            at = min(depth, length - 8)  # the last step may look at some bytes again
            word = eight[starts[live] + at].view(">u8").ravel().astype(np.uint64)
            order = np.lexsort((word, part))
            live, part, word = live[order], part[order], word[order]
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (word[1:] != word[:-1])])
        else:
            order = np.argsort(part, kind="stable")
            live, part = live[order], part[order]
            new = np.concatenate([[True], part[1:] != part[:-1]])
        part = np.cumsum(new)
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        stay = np.repeat(size > 1, size)
        live, part = live[stay], part[stay]
        if not len(live):
            return out
    out[live] = True
    return out


def _merge(starts: np.ndarray, ends: np.ndarray):
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    head = np.flatnonzero(new)
    return starts[head], ends[np.append(head[1:], len(starts)) - 1]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """Rows (d, th, s, e): byte spans of windows that start anywhere else too, in this text or another.

    ``d`` is doc_id and ``th`` the hash of the text.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    schema = pa.schema([(c, pa.int64()) for c in ("d", "th", "s", "n", "off", "token", "reach", "reach2")])

    def find(batches):
        for b in _text.pieces(batches):
            buf, offs = _text.column_bytes(b.column("text"))
            owner, first, last, anchor, token = anchors(buf, offs, length, gram)
            if len(owner):
                take, reach = pa.array(owner), digests(buf, first, last + length)
                yield _text.batch_of(
                    schema, d=b.column("doc_id").take(take), th=b.column("th").take(take), s=first - offs[:-1][owner], n=last - first,
                    off=anchor - first, token=token.view(np.int64), reach=reach[:, 0], reach2=reach[:, 1],
                )

    found = stored(keyed.mapInArrow(find, ", ".join(f"{c} long" for c in schema.names)))
    mixed = (F.min("reach") != F.max("reach")) | (F.min("reach2") != F.max("reach2"))
    tokens = found.groupBy("token").agg(F.count("*").alias("k"), mixed.alias("mixed")).where("k > 1")
    place = ["d", "th", "s"]
    again = stored(spread_join(found, tokens, ["token"], place, found.count(), "k").drop("k"))
    forget(found)
    mixed = again.where("mixed")
    same = mixed.groupBy("token", "reach", "reach2").agg(F.count("*").alias("k"), F.min("th").alias("th1"))
    whole = again.where("not mixed").select("d", "th", "s", (F.col("s") + F.col("n") + length).alias("e"))
    judged = stored(spread_join(mixed, same, ["token", "reach", "reach2"], place, again.count(), "k"))
    whole = whole.unionByName(judged.where("k > 1").select("d", "th", "s", (F.col("s") + F.col("n") + length).alias("e")))
    # of a reach found twice one copy stands for all; it needs no answer itself
    one = judged.where("k > 1 and th = th1").groupBy("token", "reach", "reach2").agg(F.min("th").alias("th"), F.min_by("s", F.struct("th", "s")).alias("s"), F.min("n").alias("n"), F.min("off").alias("off"))
    asked = judged.where("k = 1").select("th", "s", "n", "off", F.lit(True).alias("ask")).unionByName(one.select("th", "s", "n", "off", F.lit(False).alias("ask")))
    per_text = asked.groupBy("th").agg(F.collect_list(F.struct("s", "n", "off", "ask")).alias("w"))  # at most one for each byte of a text
    per_text = per_text.select("th", *(F.expr(f"transform(w, x -> x.{c})").alias(c) for c in ("s", "n", "off", "ask")))
    wanted = spark.sparkContext.broadcast(key_filter(asked.select("th").distinct(), "th"))

    def chosen(batches):
        for b in batches:
            yield b.filter(pa.array(maybe_in(wanted.value, b.column("th").to_numpy())))

    texts = keyed.where("text is not null").mapInArrow(chosen, keyed.schema).select("th", "text").dropDuplicates(["th"])
    cells = pa.schema([("lead", pa.int64()), ("core", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("far", pa.int64()), ("ask", pa.bool_()), ("x", pa.binary())])

    def cut(batches):
        for b in _text.pieces(batches):
            raw = b.column("text").cast(pa.binary())
            for i in range(b.num_rows):
                buf = np.frombuffer(raw[i].as_buffer(), np.uint8)
                p, down = _text.prefix_hash(buf)
                s, n, off, ask = (np.array(b.column(c)[i].as_py()) for c in ("s", "n", "off", "ask"))
                low, high = off - n, off  # how far before the anchor the run's windows start
                count = high // cell - low // cell + 1
                own = np.repeat(np.arange(len(s)), count)
                j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (low // cell)[own]
                anchor = (s + off)[own]
                a_hi, a_lo = np.minimum(high[own], j * cell + cell - 1), np.maximum(low[own], j * cell)
                begin, many = anchor - a_hi, a_hi - a_lo
                core_s, core_e = anchor - j * cell, anchor - j * cell - cell + 1 + length
                core = _text.mix((p[core_e] - p[core_s]) * down[core_s] + j.astype(np.uint64))
                lead = buf[core_s[:, None] + np.arange(8)].view(">i8").ravel().astype(np.int64)
                yield _text.batch_of(
                    cells, lead=lead, core=core.view(np.int64), th=np.full(len(own), b.column("th")[i].as_py()), s=begin, n=many, far=a_hi, ask=ask[own],
                    x=[buf[x : x + y + length].tobytes() for x, y in zip(begin, many, strict=True)],
                )

    ready = texts.join(per_text, "th").mapInArrow(cut, "lead long, core long, th long, s long, n long, far long, ask boolean, x binary")
    parts = partitions_for(spark, input_bytes(docs), 8 << 20)
    spans = pa.schema([("th", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])

    def compare(batches):
        held, size = [], 0
        for b in batches:  # sorted by core: cells of a core lie together
            core = b.column("core").to_numpy()
            held.append(b)
            size += b.column("x").nbytes
            if size > 2 << 20 and len(core):
                table = pa.Table.from_batches(held)
                all_core = table.column("core").to_numpy()
                cut_at = int(np.flatnonzero(all_core != all_core[-1])[-1]) + 1 if (all_core != all_core[-1]).any() else 0
                if cut_at:
                    yield from answer(table.slice(0, cut_at))
                    held = table.slice(cut_at).combine_chunks().to_batches()
                    size = sum(x.column("x").nbytes for x in held)
        if held:
            yield from answer(pa.Table.from_batches(held))

    def answer(table):
        buf, offs = _text.column_bytes(table.column("x"))
        n, core, far, ask = (table.column(c).to_numpy() for c in ("n", "core", "far", "ask"))
        _, inverse, count = np.unique(core, return_inverse=True, return_counts=True)
        use = np.flatnonzero(count[inverse] > 1)
        if not len(use):
            return
        windows = n[use] + 1
        # equal windows lie equally far before their anchors, so a large group is compared distance by distance
        turns = [(0, 1 << 62)] if windows.sum() <= MOST_WINDOWS else [(d, d + 1) for d in range(int((far - n)[use].min()), int(far[use].max()) + 1)]
        for low, high in turns:
            begin = np.maximum(far[use] - high + 1, 0)
            many = np.maximum(np.minimum(n[use], far[use] - low) - begin + 1, 0)
            own = np.repeat(use, many)
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - begin, many)
            if not len(own):
                continue
            twice = repeated_windows(buf, offs[:-1][own] + step, length, core[own]) & ask[own]
            own, step = own[twice], step[twice]
            if not len(own):
                continue
            th, s = table.column("th").to_numpy(), table.column("s").to_numpy()
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (step[1:] != step[:-1] + 1)])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(own)) - 1
            at = s[own[head]] + step[head]
            yield _text.batch_of(spans, th=th[own[head]], s=at, e=at + step[tail] - step[head] + length)

    part = ready.repartitionByRange(parts, "lead", "core").sortWithinPartitions("lead", "core").mapInArrow(compare, "th long, s long, e long")
    asked_docs = judged.where("k = 1").select("d", "th").distinct()
    part = part.join(asked_docs, "th").select("d", "th", "s", "e")
    return whole.unionByName(part)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, starts, ends, kept): texts without the bytes of repeated windows.

    Every byte covered by a ``length``-byte string that also starts anywhere
    else is removed, first copies too; strings are judged on the input.
    ``starts`` and ``ends`` are the maximal removed byte runs, ``kept`` the
    remaining bytes joined.  Null texts count as empty.  Texts shorter than
    ``length`` stay whole.  Repeated rows are copies of each other.
    """
    spark = docs.sparkSession
    spans = stored(repeated_spans(docs, length, gram, cell))
    wanted = spark.sparkContext.broadcast(key_filter(spans.select("th").distinct(), "th"))
    per_text = spans.groupBy("th").agg(F.collect_set(F.struct("s", "e")).alias("w"), F.count("*").alias("k"))  # at most one for each byte of a text
    per_text = stored(per_text.select("th", F.expr("transform(w, x -> x.s)").alias("s"), F.expr("transform(w, x -> x.e)").alias("e"), (F.col("k") / F.size("w")).alias("copies")))
    total = int(per_text.agg(F.coalesce(F.sum("copies"), F.lit(0.0))).first()[0])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary"
    keyed = _keyed(docs)

    def hit(batches):
        for b in batches:
            yield b.filter(pa.array(maybe_in(wanted.value, b.column("th").to_numpy())))

    def clean(batches):
        for b in _text.pieces(batches):
            b = b.filter(pa.array(~maybe_in(wanted.value, b.column("th").to_numpy())))
            raw = b.column("text").cast(pa.binary()).fill_null(b"")
            none = [[]] * b.num_rows
            _, offs = _text.column_bytes(raw)
            zero = np.zeros(b.num_rows, np.int64)
            yield _text.batch_of(schema, doc_id=b.column("doc_id"), n_bytes=np.diff(offs), n_removed=zero, n_spans=zero, starts=none, ends=none, kept=raw)

    def cut(batches):
        for b in _text.pieces(batches):
            raw = b.column("text").cast(pa.binary()).fill_null(b"")
            rows = []
            for i in range(b.num_rows):
                x, s, e = raw[i].as_py(), b.column("s")[i].as_py(), b.column("e")[i].as_py()
                if s:
                    s, e = _merge(np.array(s), np.array(e))
                    kept = b"".join(x[a:c] for a, c in zip([0, *e], [*s, len(x)], strict=True))
                    rows.append((len(x), int((e - s).sum()), len(s), s.tolist(), e.tolist(), kept))
                else:
                    rows.append((len(x), 0, 0, [], [], x))
            names = schema.names[1:]
            yield _text.batch_of(schema, doc_id=b.column("doc_id"), **dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    removed = spread_join(keyed.mapInArrow(hit, keyed.schema), per_text, ["th"], ["doc_id", F.monotonically_increasing_id()], total, "copies", "left")
    return keyed.mapInArrow(clean, ddl).unionByName(removed.select("doc_id", "text", "s", "e").mapInArrow(cut, ddl))


"""Retrieval: exact text first, else the most similar example."""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.edits import Texts, edits
from millrace.functions.python import edit_distance
from millrace.session import cut


def exact_matches(queries: DataFrame, examples: DataFrame, text: str = "text", query_id: str = "query_id", example_id: str = "example_id") -> DataFrame:
    """(query_id, example_id): the smallest example id with the same text; joined by hash, compared by text."""
    q = queries.select(F.col(query_id), F.col(text).alias("_q"), F.sha2(text, 256).alias("_h"))
    e = examples.select(F.col(example_id), F.col(text).alias("_e"), F.sha2(text, 256).alias("_h")).join(q.select("_h").distinct(), "_h", "left_semi")
    e = e.groupBy("_h").agg(F.min_by(F.struct(example_id, "_e"), example_id).alias("e")).select("_h", f"e.{example_id}", "e._e")
    return q.join(e, "_h").where("_q = _e").select(query_id, example_id)


#: Queries that go over all examples at once.
QUERIES = 256


#: Candidates of a query that give it a bound from below, those that one task names, and the characters of all queries up to which they are looked for.
CANDIDATES, NAMED, LOOKED_FOR = 64, 4, 1 << 22


def _runs(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes, 8 at most, from each place on as a number."""
    out = np.empty(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    for k in range(8):
        own = out[k::8]
        own[:] = padded[k : k + 8 * len(own)].view("<u8")
    return (out & np.uint64((1 << 8 * width) - 1))[: max(0, len(data) - width + 1)]


def _guess(queries: DataFrame, examples: DataFrame, text: str, query_id: str, grams: int, mode: str) -> DataFrame:
    """(query_id, least): the best similarity to some examples that share most runs of ``grams`` bytes, 8 at most, for their length; a bound from below."""
    width, asked = min(grams, 8), queries.select(query_id, text).collect()
    runs = [np.unique(_runs(np.frombuffer(r[1].encode(), np.uint8), width)) for r in asked]
    sizes = np.array([len(r[1].encode()) for r in asked], np.int64)
    every, owner = np.concatenate([np.empty(0, np.uint64), *runs]), np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    order = np.argsort(every, kind="stable")
    owner, (keys, first, times) = owner[order], np.unique(every[order], return_index=True, return_counts=True)
    place = lambda runs: (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def name(batches):
        known, top, kind = np.zeros(1 << 20, bool), [[] for _ in runs], pa.string()
        known[place(keys)] = True
        for b in batches:
            col = b.column("_e")
            kind, wide = col.type, np.int64 if pa.types.is_large_string(col.type) else np.int32
            start = np.frombuffer(col.buffers()[1], wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[start[0] : start[-1]]
            start -= start[0]
            here = _runs(data, width)
            at = np.flatnonzero(known[place(here)])
            row, key = np.searchsorted(start, at, "right") - 1, np.searchsorted(keys, here[at])
            good = (keys[np.minimum(key, len(keys) - 1)] == here[at]) & (at + width <= start[row + 1])
            row, key = row[good], key[good]
            n = times[key]
            which = owner[np.repeat(first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pairs, shared = np.unique(which * len(col) + np.repeat(row, n), return_counts=True)
            q, row = pairs // len(col), pairs % len(col)
            part = shared / np.maximum(sizes[q], (start[1:] - start[:-1])[row])  # a long text shares much and is still far
            order = np.lexsort((-part, q))
            q = q[order]
            for i in order[np.arange(len(q)) - np.searchsorted(q, q) < NAMED]:
                own = top[pairs[i] // len(col)]
                if len(own) < NAMED or part[i] > own[-1][0]:
                    own.append((float(part[i]), col[int(row[i])].as_py()))
                    own.sort(key=lambda x: -x[0])
                    del own[NAMED:]
        rows = [(k, *x) for k, own in enumerate(top) for x in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), kind), strict=True)], names=["_k", "part", "_e"])

    named = examples.select(F.col(text).alias("_e")).where(F.lit(len(keys) > 0)).mapInArrow(name, "_k long, part double, _e string")
    kinds = T.StructType([T.StructField("_k", T.LongType()), queries.schema[query_id], T.StructField("_q", T.StringType())])
    asked = queries.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(asked)], kinds)
    best = F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("part"), "_e"))
    pairs = named.withColumn("_place", best).where(F.col("_place") <= CANDIDATES).join(asked, "_k")
    # comparing is the work, not the size of the table: as many parts as there are cores, several times
    pairs = pairs.repartition(4 * queries.sparkSession.sparkContext.defaultParallelism)
    return pairs.groupBy(query_id).agg(F.max(1 - edit_distance("_q", "_e", mode)).alias("least"))


#: Characters of all queries up to which they are broadcast.
BROADCAST_CHARS = 1 << 25
#: Examples that one row of work holds; for ``levenshtein`` it holds examples of about one length, so many characters in all.
EXAMPLES, CHARS = 2048, 1 << 23
#: Examples that a query's edits are counted for at once, the longest at most a quarter and 16 characters longer than the shortest.
AT_ONCE = 1 << 14
#: Of so many examples one is compared first, where that makes so many: what is found is a bound from below.
FIRST, FIRST_LEAST = 32, 2048
#: Classes of characters whose counts bound a similarity from above.
CLASSES = 128


def _counts(texts: list[str]) -> np.ndarray:
    """How often each class of characters (code point modulo ``CLASSES``) occurs in each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) % CLASSES
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(owner * CLASSES + points, minlength=len(texts) * CLASSES).reshape(len(texts), CLASSES).astype(np.int32)


def _edits(text: str, alphabet: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Edits between a text and each of some others: ``size`` places of ``alphabet`` from ``start`` on in ``codes``."""
    others = [alphabet[codes[a : a + n]] for a, n in zip(start, size, strict=True)]
    texts = Texts(np.concatenate([np.empty(0, np.uint32), *others]), size)
    return edits(_points([text]), texts, slice(None), np.maximum(size, len(text)))


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _best(queries: list[tuple], texts: list[str], ids: list) -> list[tuple]:
    """(query, id, score, compared) for each (query, text, least): the fewest edits for their length, the larger id on a tie; None where nothing reaches ``least``."""
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(size, kind="stable")
    size, found = size[order], {q: (least, None, 0) for q, _, least in queries}
    points, at = {q: _points([t]) for q, t, _ in queries}, 0
    while at < len(size):
        end = min(at + AT_ONCE, int(np.searchsorted(size, size[at] + max(size[at] // 4, 16), "right")))
        here, own = None, size[at:end]
        for q, p in points.items():
            least, best, compared = found[q]
            floor = least - 1e-9
            # the shorter length over the longer one, then the shared characters over it, are bounds from above
            a, z = np.searchsorted(own, floor * len(p) - 1e-6), np.searchsorted(own, len(p) / floor + 1e-6, "right") if floor > 1e-6 else len(own)
            if a >= z:
                continue
            if here is None:
                here = Texts(_points([texts[i] for i in order[at:end]]), own)
            longest = np.maximum(np.maximum(own[a:z], len(p)), 1)
            likely = np.flatnonzero(here.shared(p)[a:z] >= floor * longest)
            some = slice(int(a), int(z))
            if len(likely) < 0.6 * (z - a):  # fewer texts are worth copying their masks
                some, longest = a + likely, longest[likely]
            most = np.floor((1 - floor) * longest).astype(np.int64)
            n = edits(p, here, some, most)
            score = np.where(n <= most, 1 - n / longest, -1.0)
            top = float(score.max(initial=-1.0))
            if top >= (floor if best is None else least):
                tied = max(ids[i] for i in order[at:end][some][score == top])
                best = tied if best is None or top > least else max(best, tied)
                least = top
            found[q] = least, best, compared + len(likely)
        at = end
    return [(q, best, None if best is None else least, n) for q, (least, best, n) in found.items()]


def nearest(queries: DataFrame, examples: DataFrame, text: str = "text", query_id: str = "query_id", example_id: str = "example_id", grams: int = 0, mode: str = "compat", details: bool = False) -> DataFrame:
    """(query_id, example_id, score): the example with the highest similarity of all, the larger id on a tie.

    Exact texts are settled by a join.  The other queries, a stated set, meet
    all examples in blocks of about ``QUERIES``.  A task takes many examples at
    once: counts of characters bound each similarity from above, and what a
    query has found spares it the examples whose bound is lower.  For
    ``levenshtein`` the examples of a task have about one length, and tables of
    edits are filled only where they can reach the best found so far; one of
    ``FIRST`` examples goes before all of them to give a bound from below.  With
    ``grams``, candidates that share runs of so many bytes give one, too.  ``details`` adds
    ``compared``, the pairs compared for a query.  Null texts match nothing; a
    query has no row only if there is no example.
    """
    examples = examples.select(example_id, F.col(text).alias("_e")).where("_e is not null")
    if mode == "levenshtein":
        examples = cut(examples.withColumn("_n", F.length("_e")))  # it is read for each bound
    same = cut(exact_matches(queries.withColumnRenamed(text, "_e"), examples, "_e", query_id, example_id)).withColumn("score", F.lit(1.0))
    rest = queries.where(F.col(text).isNotNull()).join(same.select(query_id), query_id, "left_anti").select(query_id, text)
    if grams and (rest.agg(F.sum(F.length(text))).first()[0] or 0) <= LOOKED_FOR:
        rest = rest.join(_guess(rest, examples.withColumnRenamed("_e", text), text, query_id, grams, mode), query_id, "left")
    else:
        rest = rest.withColumn("least", F.lit(0.0))
    rest, n_examples = cut(rest.withColumn("least", F.coalesce("least", F.lit(0.0)))), examples.count()
    if mode == "levenshtein" and n_examples >= FIRST * FIRST_LEAST:
        some = _search(rest, examples.where(F.pmod(F.xxhash64("_e", F.lit(1)), F.lit(FIRST)) == 0), n_examples // FIRST, text, query_id, example_id, mode)
        some = some.select(query_id, F.col("score").alias("_s"))
        rest = cut(rest.join(some, query_id, "left").select(query_id, text, F.greatest("least", F.coalesce("_s", F.lit(0.0))).alias("least")))
    top = _search(rest, examples, n_examples, text, query_id, example_id, mode)
    out = same.withColumn("compared", F.lit(0).cast("long")).unionByName(top)
    return out.select(query_id, example_id, F.col("score").cast("double").alias("score"), *(["compared"] if details else []))


def _packs(examples: DataFrame, example_id: str) -> tuple[DataFrame, int]:
    """With ``_part``: examples of about one length ``_n``, about ``CHARS`` characters in all; the number of parts."""
    sizes = examples.groupBy("_n").agg((F.count("*") * (F.col("_n") + 64)).alias("_c"))
    upto = F.sum("_c").over(Window.orderBy("_n"))  # as many rows as there are lengths
    first, last = F.floor((upto - F.col("_c")) / CHARS), F.floor((upto - 1) / CHARS)
    sizes = cut(sizes.select("_n", first.alias("_first"), last.alias("_last")))
    part = F.col("_first") + F.pmod(F.xxhash64(example_id, "_e"), F.col("_last") - F.col("_first") + 1)
    packed = examples.join(F.broadcast(sizes), "_n").select(example_id, "_e", part.alias("_part"))
    return packed, 1 + (sizes.agg(F.max("_last")).first()[0] or 0)


def _search(rest: DataFrame, examples: DataFrame, n_examples: int, text: str, query_id: str, example_id: str, mode: str) -> DataFrame:
    """(query_id, example_id, score, compared): for each query the best example that reaches its ``least``."""
    count, chars = rest.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    # comparing is the work, not the size of the table: as many parts as there are cores, several times
    parts = 4 * rest.sparkSession.sparkContext.defaultParallelism
    if mode == "compat":
        packs = max(-(-n_examples // EXAMPLES), parts)
        blocks = max(1, -(-count // QUERIES))
        packed = examples.withColumn("_part", F.pmod(F.xxhash64(example_id, "_e"), F.lit(packs)))
    else:  # long vectors pay, so queries are dealt to tasks where examples make few packs
        packed, packs = _packs(examples, example_id)
        blocks = max(1, -(-count // QUERIES), min(count, -(-parts // packs)))
    hint = F.broadcast if chars <= BROADCAST_CHARS else (lambda df: df)
    asked = hint(rest.groupBy(F.pmod(F.xxhash64(query_id), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct(query_id, text, "least")).alias("q")))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))
    qid, eid = (t.schema[c].dataType.simpleString() for t, c in ((rest, query_id), (examples, example_id)))
    kinds_of_ids = [t.select(c).limit(0).toArrow().schema.field(0).type for t, c in ((rest, query_id), (examples, example_id))]

    names, kinds = [query_id, example_id, "score", "compared"], [*kinds_of_ids, pa.float64(), pa.int64()]

    def compare(queries, texts, ids):
        counts, sizes = _counts(texts), np.array([len(t) for t in texts])
        for q, asked_text, least in queries:
            shared = np.minimum(_counts([asked_text])[0], counts).sum(axis=1)  # only characters that both have can match
            bound = 2 * shared / np.maximum(len(asked_text) + sizes, 1)
            best, n = None, 0
            for i in np.argsort(-bound, kind="stable"):
                if bound[i] < (best[0] if best else least) - 1e-9:
                    break
                n += 1
                here = (difflib.SequenceMatcher(a=asked_text, b=texts[i]).ratio(), ids[i])
                best = here if best is None or here > best else best
            yield q, *((best[1], best[0]) if best else (None, None)), n

    work_on = compare if mode == "compat" else _best

    def batches_of(batches):
        for b in batches:
            for q, e in zip(b.column("q"), b.column("e"), strict=True):
                queries = [(x[query_id], x[text], x["least"]) for x in q.as_py()]
                rows = list(work_on(queries, e.values.field("_e").to_pylist(), e.values.field(example_id).to_pylist()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    held = packed.groupBy("_part").agg(F.collect_list(F.struct(example_id, "_e")).alias("e"))
    tasks = parts if mode == "compat" else max(parts, 2 * packs * blocks)
    work = held.withColumn("_block", every).join(asked, "_block").select("q", "e").repartition(tasks)
    found = work.mapInArrow(batches_of, f"`{query_id}` {qid}, `{example_id}` {eid}, score double, compared long")
    top = found.groupBy(query_id).agg(F.max_by(F.struct(example_id, "score"), F.struct("score", example_id)).alias("t"), F.sum("compared").alias("compared"))
    return top.where("t.score is not null").select(query_id, f"t.{example_id}", "t.score", "compared")


def few_shot(examples: DataFrame, k: int, order: list) -> DataFrame:
    """One row with ``shots``: the first k examples as an array; k is small by nature."""
    first = examples.orderBy(*order).limit(k)
    return first.agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*examples.columns).alias("x")))).alias("s")).select(F.transform("s", lambda x: x["x"]).alias("shots"))

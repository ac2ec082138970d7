"""Language-model scoring by prediction by partial matching over a byte-context trie.

Training counts all strings of ``order`` + 1 bytes of the training texts (each
text is preceded by ``order`` marks and followed by one), so the counts of
every shorter context are sums of the counts of longer ones.  A symbol's
probability is that of its longest matching context; escapes follow method C
(as many escape counts as distinct symbols) and symbols already seen in the
longer context are excluded from the shorter one, which makes the
probabilities of all 256 symbols sum to one.

The frequent contexts are broadcast.  A gram whose longest context is not
among them is scored by the table of all counts: both are dealt out by the last
bytes of the context, so a task holds every longer context that ends in them,
and the few short ones are broadcast whole.  A document's sums come back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._store import forget, partitions_for, stored
from millrace.llm.candidates import bucket_bits

#: 0xFF is no byte of UTF-8: it stands for the marks before a text and its end.
MARK = 0xFF
#: 255 bytes and the end.
SYMBOLS = 256
#: Bound of the broadcast trie: entries of each order kept at most (24 bytes each); grams after rarer contexts are scored by a shuffle.
TRIE_ENTRIES = 1 << 20
#: Bound of the broadcast word table; rarer words are scored by a shuffle join.
COMMON_WORDS = 1 << 18


def grams(buf: np.ndarray, offs: np.ndarray, order: int):
    """The byte strings of ``order`` + 1 symbols that end at each symbol of each text, its end included."""
    sizes = np.diff(offs) + order + 1
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    padded = np.full(at[-1], MARK, np.uint8)
    if len(buf):
        shift = np.repeat(at[:-1] + order - offs[:-1], np.diff(offs))
        padded[np.arange(len(buf)) + shift] = buf
    out = np.zeros(len(padded) - order if len(padded) > order else 0, np.uint64)
    for j in range(order + 1):
        out |= padded[j : j + len(out)].astype(np.uint64) << np.uint64(8 * (order - j))
    keep = np.ones(len(out), bool)
    if len(at) > 2:
        inner = at[1:-1]
        for j in range(1, order + 1):  # windows that cross two texts
            keep[inner - j] = False
    return out[keep], at[:-1] - np.arange(len(sizes)) * order


def _count_grams(batches, order):
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for b in _text.pieces(batches):
        g, _ = grams(*_text.column_bytes(b.column("text")), order)
        g.sort()
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        new, n = g[start], np.diff(np.append(start, len(g)))
        both = np.concatenate([keys, new])
        rank = np.argsort(both, kind="stable")
        both, n = both[rank], np.concatenate([counts, n])[rank]
        start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        keys, counts = both[start], np.add.reduceat(n, start)
        if len(keys) > 1_000_000:
            yield _text.batch_of(schema, gram=keys.view(np.int64), n=counts)
            keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(keys), 500_000):
        yield _text.batch_of(schema, gram=keys[i : i + 500_000].view(np.int64), n=counts[i : i + 500_000])


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(gram, n) over all texts, summed within tasks before the shuffle."""
    return docs.select("text").mapInArrow(lambda it: _count_grams(it, order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _bounded(counts: DataFrame, order: int, entries: int) -> DataFrame:
    """Contexts with the highest totals such that at most ``entries`` grams stay; whole contexts go or stay."""
    total = counts.groupBy(F.shiftrightunsigned("gram", 8).alias("c")).agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    by = total.groupBy(F.floor(F.log2("t")).cast("int").alias("b")).agg(F.sum("k").alias("k")).orderBy(F.desc("b")).collect()
    left, low = entries, 0
    for r in by:
        left -= r.k
        if left < 0:
            low = r.b + 1
            break
    if not low:
        return counts
    keep = total.where(F.col("t") >= F.lit(1 << low)).select("c")
    return counts.join(keep, F.shiftrightunsigned("gram", 8) == F.col("c"), "left_semi")


class Trie:
    """Counts by order as sorted arrays, and the probability of a symbol after its context."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[k]: sorted grams of k + 1 bytes and their counts; every parent of a kept context is kept."""
        self.order = len(levels) - 1
        self.gram, self.ctx, self.esc, self.full, self.part, self.den, self.sum = [], [], [], [], [], [], []
        self.uniform = -np.log10(max(1, SYMBOLS - len(levels[0][0])))  # below order 0: over what order 0 has not seen
        n_below = t_below = None
        for k, (g, c) in enumerate(levels):
            g, c = g.view(np.uint64), c.astype(np.float64)
            ctx, start, t = np.unique(g >> np.uint64(8), return_index=True, return_counts=True)
            n = np.add.reduceat(c, start) if len(g) else np.zeros(0)
            self.gram.append(g)
            self.ctx.append(ctx)
            self.esc.append(np.log10(t) - np.log10(n + t))
            self.part.append(np.log10(c))
            self.full.append(self.part[k] - np.log10(np.repeat(n + t, t)))
            if k == 0 or not len(g):
                self.den.append(np.zeros(len(ctx)))
                self.sum.append(np.zeros(len(ctx)))
            else:
                below, counts = levels[k - 1]
                at = np.searchsorted(below.view(np.uint64), g & np.uint64((1 << (8 * k)) - 1))
                seen = np.add.reduceat(counts[at].astype(np.float64), start)
                up = np.searchsorted(self.ctx[k - 1], ctx & np.uint64((1 << (8 * (k - 1))) - 1))
                pn, pt = n_below[up] - seen, t_below[up] - t
                den = np.log10(np.where(pt > 0, pn + pt, 1))
                self.den.append(den)
                self.sum.append(self.sum[k - 1][up] + np.where(pt > 0, np.log10(np.maximum(pt, 1)) - den, 0.0))
            n_below, t_below = n, t

    def _find(self, table: np.ndarray, key: np.ndarray):
        if not len(table):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return at, table[at] == key

    def log10p(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the bytes before it."""
        out = np.zeros(len(g))
        todo = np.arange(len(g))
        longest = np.full(len(g), -1)  # order at which coding starts
        start_sum, start_esc = np.zeros(len(g)), np.zeros(len(g))
        above = np.zeros(len(g), np.int64)  # node one order longer, whose symbols are excluded
        for k in range(self.order, -1, -1):
            key = g[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            node, there = self._find(self.ctx[k], key >> np.uint64(8))
            entry, seen = self._find(self.gram[k], key)
            first = there & (longest[todo] < 0)
            i = todo[first & seen]
            out[i] = self.full[k][entry[first & seen]]
            i = todo[first & ~seen]
            longest[i] = k
            start_esc[i] = self.esc[k][node[first & ~seen]]
            start_sum[i] = self.sum[k][node[first & ~seen]]
            later = there & ~first
            i = todo[later & seen]
            a = above[i]
            if len(i):
                out[i] = start_esc[i] + start_sum[i] - self.sum[k + 1][a] + self.part[k][entry[later & seen]] - self.den[k + 1][a]
            above[todo] = node
            todo = todo[~(there & seen)]
        if len(todo):
            out[todo] = start_esc[todo] + start_sum[todo] + self.uniform
        return out


class Table:
    """Open-addressing table of 64-bit keys for vectorised lookups."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(max(1, len(keys)) * 2.5).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << bits, np.float64)
        self.mask = (1 << bits) - 1
        at, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            slot, who = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[who]
            self.keys[slot], self.values[slot] = keys[left[won]], values[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray):
        """(values, found)."""
        at = self._slot(keys)
        found = self.keys[at] == keys
        values = np.where(found, self.values[at], 0.0)
        miss = np.flatnonzero(~found)
        for _ in range(self.probes - 1):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & self.mask
            k = self.keys[at[miss]]
            hit = k == keys[miss]
            values[miss[hit]] = self.values[at[miss[hit]]]
            found[miss[hit]] = True
            miss = miss[~hit & (k != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return values, found


def _columns(df: DataFrame, *names: str):
    """Columns of a bounded result as int64 arrays."""
    table = df.select(*names).toArrow()
    return [table.column(c).to_numpy().astype(np.int64, copy=False) for c in names]


def _summed(gram: np.ndarray, n: np.ndarray):
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    return gram[start], np.add.reduceat(n, start) if len(gram) else n


def _shorter(levels: list, order: int, least: int) -> list:
    """The levels from ``least`` up to the given one of ``order``: counts of shorter contexts are sums of longer ones."""
    for k in range(order - 1, least - 1, -1):
        levels = [_summed(levels[0][0] & np.int64((1 << (8 * (k + 1))) - 1), levels[0][1]), *levels]
    return levels


def _fit(docs: DataFrame, order: int, entries: int):
    """The bounded trie, and unless it is whole the stored counts of all grams, their number and the short levels, all of them."""
    whole = stored(gram_counts(docs, order))
    size = whole.count()
    if size <= entries:
        trie = Trie(_shorter([_summed(*_columns(whole, "gram", "n"))], order, 0))
        forget(whole)
        return trie, None, size, None
    levels, parents, short = [], None, None
    for k in range(order + 1):
        cut = F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        counts = whole if k == order else whole.groupBy(cut.alias("gram")).agg(F.sum("n").alias("n"))
        kept = _bounded(counts, k, entries)
        g, n = _summed(*_columns(kept, "gram", "n"))
        if k < order and (k < 2 or k == 2 and kept is counts):  # 2^8, 2^16 and at most ``entries`` grams
            short = (g, n) if kept is counts else _summed(*_columns(counts, "gram", "n"))
            base = k
        if k > 1:  # a context stays only if the next shorter one did
            ok = np.isin((g >> 8) & np.int64((1 << (8 * (k - 1))) - 1), parents)
            g, n = g[ok], n[ok]
        parents = np.unique(g >> 8)
        levels.append((g, n))
    return Trie(levels), whole, size, _shorter([short], base, 0)


def train(docs: DataFrame, order: int = 5, entries: int = TRIE_ENTRIES) -> Trie:
    """A trie over the whole texts of ``docs``; its size is bounded by ``entries`` per order."""
    trie, whole, _, _ = _fit(docs, order, entries)
    if whole is not None:
        forget(whole)
    return trie


#: Pairs of 64-bit numbers that a task gathers before it emits blocks.
GATHER = 1 << 19
BLOCKS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])
BLOCKS_DDL = "bucket int, kind int, block binary"


def _blocks(bucket: np.ndarray, one: np.ndarray, two: np.ndarray):
    """(bucket, bytes) of pairs of 64-bit columns: a block for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, pairs = bucket[order], np.column_stack([one[order].view(np.int64), two[order].view(np.int64)])
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(bucket))
    return bucket[start].astype(np.int32), [pairs[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def _unpacked(blocks: list) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(blocks), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (_text.mix(keys) >> np.uint64(64 - bits)).astype(np.int64)


def _context_bucket(gram: np.ndarray, base: int, bits: int) -> np.ndarray:
    """Grams whose contexts end in the same ``base`` + 1 bytes, which share all counts that they need, are in one bucket."""
    return _bucket((gram.view(np.uint64) >> np.uint64(8)) & np.uint64((1 << (8 * (base + 1))) - 1), bits)


def _far_scores(far: DataFrame, whole: DataFrame, size: int, short: list, order: int, bits: int) -> DataFrame:
    """(row, far_score): for each row the log10 probabilities, by all counts of the training texts, of its grams in the blocks ``far``, summed.

    Grams and counts meet by the last bytes of their contexts; only sums for
    rows leave a task.
    """
    spark = whole.sparkSession
    base = len(short) - 1
    given = spark.sparkContext.broadcast(short)

    def counts(batches):
        for b in batches:
            gram = b.column("gram").to_numpy()
            bucket, block = _blocks(_context_bucket(gram, base, bits), gram, b.column("n").to_numpy())
            yield _text.batch_of(BLOCKS, bucket=bucket, kind=np.zeros(len(bucket), np.int32), block=block)

    def run(batches):
        held: tuple[list, list] = ([], [])
        for b in batches:
            for kind, x in zip(b.column("kind").to_pylist(), b.column("block").to_pylist(), strict=True):
                held[kind].append(x)
        if not held[1]:
            return
        trie = Trie(given.value + _shorter([_summed(*_unpacked(held[0]))], order, base + 1))
        held[0].clear()
        gram, row = _unpacked(held[1])
        held[1].clear()
        own, inverse = np.unique(gram, return_inverse=True)
        p = trie.log10p(own.view(np.uint64))[inverse]
        rows, inverse = np.unique(row, return_inverse=True)
        bucket, block = _blocks(_bucket(rows.view(np.uint64), bits), rows, np.bincount(inverse, p, len(rows)))
        yield _text.batch_of(BLOCKS, bucket=bucket, kind=np.zeros(len(bucket), np.int32), block=block)

    schema = pa.schema([("row", pa.int64()), ("far_score", pa.float64())])

    def add(batches):
        blocks = [x for b in batches for x in b.column("block").to_pylist()]
        if blocks:
            row, part = _unpacked(blocks)
            own, inverse = np.unique(row, return_inverse=True)
            yield _text.batch_of(schema, row=own, far_score=np.bincount(inverse, part.view(np.float64), len(own)))

    pairs = far.agg(F.coalesce(F.sum(F.length("block")), F.lit(0))).first()[0]
    parts = partitions_for(spark, 16 * size + pairs)
    met = far.unionByName(whole.mapInArrow(counts, BLOCKS_DDL)).repartition(parts, "bucket").mapInArrow(run, BLOCKS_DDL)
    return met.repartition(partitions_for(spark, pairs // 16), "bucket").mapInArrow(add, "row long, far_score double")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): 64-bit word hashes with their counts over all texts; the end of a text has word null."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        keys, counts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for b in _text.pieces(batches):
            h, _, _, _ = _text.words(*_text.column_bytes(b.column("text")))
            ends += b.num_rows
            new, n = np.unique(h, return_counts=True)
            both, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, n]), len(both)).astype(np.int64)
            keys = both
            if len(keys) > 1_000_000:
                yield _text.batch_of(schema, word=keys.view(np.int64), n=counts)
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for i in range(0, len(keys), 500_000):
            yield _text.batch_of(schema, word=keys[i : i + 500_000].view(np.int64), n=counts[i : i + 500_000])
        yield _text.batch_of(schema, word=[None], n=[ends])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def score(docs: DataFrame, held_out, order: int = 5, entries: int = TRIE_ENTRIES, common_words: int = COMMON_WORDS) -> DataFrame:
    """Model and base scores of every text, learning from the rows where ``held_out`` is false.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 probability of the whole text and its end), n_bytes.  A null
    text counts as empty: its only token is the end.  A null doc_id is hashed
    as an empty string by the caller's expression and kept.  Repeated rows get
    a row each.  Without training rows every byte costs log10(256) and the
    base is that of a table with no counts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = docs.where("not held_out")
    trie, whole, size, short = _fit(training, order, entries)
    partial = whole is not None
    counts = stored(word_counts(training))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = (counts.where("word is null").select("n").first() or [0])[0]
    known = counts.where("word is not null")
    by_n, by_k = _columns(known.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")), "n", "k")
    fits = by_n[np.cumsum(by_k) <= common_words]
    low = int(fits.min()) if len(fits) else 1 << 62  # words found so often are looked up, others joined
    common, common_n = _columns(known.where(F.col("n") >= low), "word", "n")
    scale = n + 0.5 * (v + 1)
    lookup = Table(common.view(np.uint64), np.log10((common_n + 0.5) / scale))
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((trie, lookup))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("rare", pa.list_(pa.int64())), *BLOCKS])
    base, bits = (len(short) - 1 if partial else 0), bucket_bits(partitions_for(spark, 16 * size))
    end_cost = float(np.log10((ends + 0.5) / scale))
    ready: dict = {}

    def run(batches):
        trie, lookup = model.value
        if "t" not in ready:
            top = trie.gram[trie.order]
            ready["t"] = Table(top, trie.full[trie.order])
        held: list = []  # grams after contexts that the trie may lack, and their rows

        def flush():
            gram, row = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket, block = _blocks(_context_bucket(gram, base, bits), gram, row)
            columns = {f.name: pa.nulls(len(bucket), f.type) for f in schema} | {"bucket": bucket, "kind": np.ones(len(bucket), np.int32), "block": block}
            return _text.batch_of(schema, **columns)

        for b in _text.pieces(batches):
            buf, offs = _text.column_bytes(b.column("text"))
            g, at = grams(buf, offs, trie.order)
            p, found = ready["t"].get(g)
            new, inverse = np.unique(g[~found], return_inverse=True)
            p[~found] = trie.log10p(new)[inverse]
            far = np.zeros(0, np.int64)
            if partial:  # the trie may lack what follows these contexts
                _, there = trie._find(trie.ctx[trie.order], new >> np.uint64(8))
                far = np.flatnonzero(~found)[~there[inverse]]
                p[far] = 0
            total = np.add.reduceat(p, at)
            h, _, _, first = _text.words(buf, offs)
            value, known = lookup.get(h)
            sums = np.concatenate([[0.0], np.cumsum(value)])
            hits = np.concatenate([[0], np.cumsum(known)])
            rare = np.flatnonzero(~known)
            split = np.searchsorted(rare, first)
            yield _text.batch_of(
                schema, row=b.column("row"), doc_id=b.column("doc_id"), held_out=b.column("held_out"),
                n_tokens=np.diff(first) + 1, n_known=hits[first[1:]] - hits[first[:-1]] + int(ends > 0),
                base=sums[first[1:]] - sums[first[:-1]] + end_cost, score=total, n_bytes=np.diff(offs),
                rare=pa.ListArray.from_arrays(pa.array(split.astype(np.int32)), pa.array(h[rare].view(np.int64))),
                **{c: pa.nulls(b.num_rows, t) for c, t in zip(BLOCKS.names, BLOCKS.types, strict=True)},
            )
            if len(far):
                held.append((g[far], b.column("row").to_numpy()[np.searchsorted(at, far, "right") - 1].view(np.uint64)))
                if sum(len(x) for x, _ in held) >= GATHER:
                    yield flush()
        if held:
            yield flush()

    ddl = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, " + BLOCKS_DDL
    made = stored(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, ddl))
    rows = made.where("bucket is null").drop(*BLOCKS.names)
    rest = (
        rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
        .join(counts.where(F.col("word").isNotNull() & (F.col("n") < low)), "word", "left")
        .groupBy("row").agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.5)) / F.lit(float(scale)))).alias("rare_base"),
        )
    )
    rows_out = rows.drop("rare").join(rest, "row", "left")
    far_score = F.lit(0.0)
    if partial:
        far = stored(_far_scores(made.where("bucket is not null").select(*BLOCKS.names), whole, size, short, order, bits))
        forget(whole)
        rows_out = rows_out.join(far, "row", "left")
        far_score = F.coalesce("far_score", F.lit(0.0))
    return rows_out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + far_score).alias("score"), "n_bytes",
    )


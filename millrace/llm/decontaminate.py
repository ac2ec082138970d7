"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Every benchmark item is a set of distinct shingles.  Items are partitioned by
set size.  An item of n shingles that must share ``need`` of them with a
document keeps its bottom-k MinHash sketch, k = n - need + 1: whichever
``need`` shingles a document holds, one of those k is among them, so the
sketch loses nothing.  A partition's largest sketch value bounds what is
looked up of a document; colliding pairs are verified by exact containment of
the item's whole shingle set in the document's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._store import key_filter, maybe_in, stored

#: Largest number of benchmark shingles that is broadcast (16 bytes each); above it both sides are shuffled.
BROADCAST_SHINGLES = 2_000_000


def _item_sets(batches, size, id_column):
    schema = pa.schema([("item_id", pa.int64()), ("n", pa.int64()), ("h", pa.list_(pa.int64()))])
    for b in _text.pieces(batches):
        hashes, _, _, first = _text.words(*_text.column_bytes(b.column("text")))
        s, at = _text.shingles(hashes, first, size)
        sets = [np.unique(s[at[i] : at[i + 1]]) for i in range(b.num_rows)]
        yield _text.batch_of(schema, item_id=b.column(id_column), n=[len(x) for x in sets], h=[_text.signed(x) for x in sets])


def needed(n, percent):
    return -(-np.asarray(n) * percent // 100)


def item_table(items: DataFrame, id_column: str = "item_id", shingle: int = 5) -> DataFrame:
    """(item_id, n, h): distinct shingle hashes of each item that has words."""
    return items.select(id_column, "text").mapInArrow(
        lambda it: _item_sets(it, shingle, id_column), "item_id long, n long, h array<long>"
    ).where("n > 0")


class _Index:
    """The size partitions of a bounded item table: sketch values with their items, and whole sets."""

    def __init__(self, rows, percent: int):
        self.ids = [r[0] for r in rows]
        self.sets = [np.sort(np.array(r[2], np.int64).view(np.uint64)) for r in rows]
        self.need = needed([len(s) for s in self.sets], percent) if rows else np.zeros(0, np.int64)
        self.parts = []
        band = np.array([len(s).bit_length() for s in self.sets], int)
        for k in np.unique(band):
            members = np.flatnonzero(band == k)
            keep = [self.sets[i][: len(self.sets[i]) - self.need[i] + 1] for i in members]
            value, owner = np.concatenate(keep), np.repeat(members, [len(x) for x in keep])
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            bloom = np.zeros(1 << 20, bool)
            bloom[value & np.uint64(0xFFFFF)] = True
            self.parts.append((value[-1], value, owner, bloom))

    def hits(self, buf, offs, shingle):
        """(row, item, shared) of a piece of texts."""
        hashes, _, _, first = _text.words(buf, offs)
        s, at = _text.shingles(hashes, first, shingle)
        found = []
        for top, value, owner, bloom in self.parts:
            where = np.flatnonzero((s <= top) & bloom[s & np.uint64(0xFFFFF)])
            left = np.searchsorted(value, s[where], "left")
            count = np.searchsorted(value, s[where], "right") - left
            where, left, count = where[count > 0], left[count > 0], count[count > 0]
            if len(where):
                row = np.repeat(np.searchsorted(at, where, "right") - 1, count)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                found.append(np.unique(row * len(self.ids) + owner[np.repeat(left, count) + step]))
        out, last, own = [], -1, None
        for pair in np.unique(np.concatenate(found)) if found else ():
            row, item = divmod(int(pair), len(self.ids))
            if row != last:
                own, last = np.unique(s[at[row] : at[row + 1]]), row
            place = np.minimum(np.searchsorted(own, self.sets[item]), len(own) - 1)
            shared = int((own[place] == self.sets[item]).sum())
            if shared >= self.need[item]:
                out.append((row, item, shared))
        return out


def _bounded_index(items: DataFrame, percent: int, limit: int):
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _Index(items.collect(), percent) if total <= limit else None


def _given(items: DataFrame, shingle: int) -> DataFrame:
    return stored(item_table(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "item_id", shingle))


def contaminated_pairs(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", percent: int = 80, shingle: int = 5, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared) where 100 * n_shared >= percent * n_item.

    Sets are distinct ``shingle``-word shingles over whole texts, words
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; with fewer words the whole
    sequence is the only shingle.  Null or empty texts and items match
    nothing.  Repeated rows give repeated pairs on the document side; repeated
    item ids are separate items.  A null doc_id is kept.  Extra columns are
    ignored.  Whether the items are broadcast or shuffled changes no row.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = _given(items, shingle)
    index = _bounded_index(table, percent, broadcast_shingles)
    if index is None:
        hits = _shuffled(docs, table, percent, shingle)
        rows = docs.select("doc_id", F.xxhash64("text").alias("th"))  # repeated rows of one text each get its pairs
        hits = hits.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "h")
        return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("doc_id", "item_id", "n_item", "n_shared")
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_item", "n_shared")])

    def search(batches):
        ix = shared.value
        for b in _text.pieces(batches):
            ids = b.column("doc_id")
            hits = ix.hits(*_text.column_bytes(b.column("text")), shingle)
            if hits:
                row, item, n = (list(x) for x in zip(*hits, strict=True))
                yield _text.batch_of(schema, doc_id=ids.take(pa.array(row)), item_id=[ix.ids[i] for i in item], n_item=[len(ix.sets[i]) for i in item], n_shared=n)

    return docs.mapInArrow(search, "doc_id long, item_id long, n_item long, n_shared long")


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = 80, shingle: int = 5, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no item; see contaminated_pairs().

    Null and empty texts stay; every row is judged by its own text, whatever its doc_id.
    """
    table = _given(items, shingle)
    index = _bounded_index(table, percent, broadcast_shingles)
    if index is None:
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        hits = _shuffled(keyed, table, percent, shingle).select(F.col("doc_id").alias("__d"), F.col("th").alias("__h")).distinct()
        same = docs["doc_id"].cast("long").eqNullSafe(hits["__d"]) & (F.xxhash64(docs["text"].cast("string")) == hits["__h"])
        return docs.join(hits, same, "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def clean(batches):
        for b in _text.pieces(batches):
            keep = np.ones(b.num_rows, bool)
            keep[[h[0] for h in shared.value.hits(*_text.column_bytes(b.column("text")), shingle)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def _shuffled(docs: DataFrame, items: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(doc_id, th, item_id, n_item, n_shared) of each distinct text and doc_id, for an item table of any size.

    Texts are scanned for sketch values, those of candidates again for whole
    sets; filters of a fixed size keep other shingles out of the shuffles.
    """
    spark = docs.sparkSession
    need = F.ceil(F.col("n") * F.lit(percent) / F.lit(100)).cast("long")
    unsigned = F.transform("h", lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))  # signed order is then unsigned order
    items = items.withColumn("row", F.monotonically_increasing_id()).withColumn("need", need).withColumn("u", F.sort_array(unsigned))
    items = stored(items)
    sketch = items.select("row", F.explode(F.slice("u", 1, (F.col("n") - F.col("need") + 1).cast("int"))).alias("x"))
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("x", pa.int64())])
    docs = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("th"))

    def values(values_filter, texts_filter=None):
        shared = spark.sparkContext.broadcast((values_filter, texts_filter))

        def run(batches):
            wanted, texts = shared.value
            for b in _text.pieces(batches):
                if texts is not None:
                    b = b.filter(pa.array(maybe_in(texts, b.column("th").to_numpy())))
                hashes, _, _, first = _text.words(*_text.column_bytes(b.column("text")))
                s, at = _text.shingles(hashes, first, shingle)
                x = (s ^ np.uint64(1 << 63)).view(np.int64)
                keep = maybe_in(wanted, x)
                owner = np.repeat(np.arange(b.num_rows), np.diff(at))[keep]
                take = pa.array(owner)
                yield _text.batch_of(schema, doc_id=b.column("doc_id").take(take), th=b.column("th").take(take), x=x[keep])

        return docs.mapInArrow(run, "doc_id long, th long, x long").distinct()

    found = values(key_filter(sketch, "x", 1 << 25))
    pairs = stored(found.join(sketch, "x").select("doc_id", "th", "row").distinct())
    sought = items.join(pairs.select("row").distinct(), "row", "left_semi").select(F.explode("u").alias("x"))
    whole = values(key_filter(sought, "x", 1 << 25), key_filter(pairs, "th"))
    wanted = pairs.join(items.select("row", "item_id", "n", "need", F.explode("u").alias("x")), "row")
    whole = whole.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("x").alias("y"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("x") == F.col("y"))
    return (
        wanted.join(whole, same)
        .groupBy("doc_id", "th", "row", "item_id", "n", "need").agg(F.count("*").alias("n_shared"))
        .where("n_shared >= need")
        .select("doc_id", "th", "item_id", F.col("n").alias("n_item"), "n_shared")
    )

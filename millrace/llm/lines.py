"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

A text is a sequence of line identifiers (64-bit hashes of its lines).  Level k
sorts the runs of 2**k lines: a run's rank is the number of suffixes that begin
with a smaller run, which is where its interval starts in the suffix array, and
all suffixes of the interval share 2**k lines.  The keys of level k + 1 are the
pairs of ranks of two neighbouring runs of level k.  Distinct keys are counted
first and ranked by a range-partitioned sort with running sums, so that a
frequent run costs one row; runs that occur once drop out, as their longest
common prefix with any other suffix is known to be shorter.

The suffixes that share l lines, 2**k <= l < 2**(k + 1), are an LCP interval.
Its key is the pair of ranks of two overlapping runs of level k.  The shortest
runs that reach ``min_words`` words are looked up this way, from each line on
and (``whole_runs``) up to each line.  A repeated run of enough words is the
union of those inside it: a line with enough words from it to the run's end
begins one, any other line is in the one that ends with the run.  So every
later copy is deleted and overlapping copies merge to the maximal repeated runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm import _text
from millrace.llm._store import forget, free_name, spread_join, stored

MIN_WORDS = 50


def line_spans(buf: np.ndarray, offs: np.ndarray):
    """Starts and ends of the lines of each text, and the first line of each text; lines end at LF, a last empty one does not count."""
    after = np.flatnonzero(buf == 10) + 1
    starts = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], after[~np.isin(after, offs)]]))
    ends = np.append(starts[1:], len(buf))[: len(starts)]
    ends = ends - ((buf[ends - 1] == 10) & (ends > starts))
    return starts, ends, np.searchsorted(starts, offs)


def _lines(batches, min_words, whole_runs):
    schema = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("pos", pa.int64()), ("h", pa.int64()), ("lens", pa.list_(pa.int64()))])
    for b in _text.pieces(batches):
        buf, offs = _text.column_bytes(b.column("text"))
        if not len(buf):
            continue
        starts, ends, first = line_spans(buf, offs)
        h = _text.span_hash(buf, starts, ends)
        _, word_starts, _, _ = _text.words(buf, offs)
        so_far = np.searchsorted(word_starts, starts)
        owner = np.repeat(np.arange(b.num_rows), np.diff(first))
        reach = np.searchsorted(so_far, so_far + min_words)  # first line that starts with enough words before it
        total = np.searchsorted(word_starts, offs[1:])[owner]
        last = first[1:][owner]
        own = np.arange(len(starts))
        run = np.where(reach <= last - 1, reach, np.where(total - so_far >= min_words, last, -1)) - own
        until = np.append(so_far[1:], len(word_starts))
        begin = np.searchsorted(so_far, until - min_words, side="right") - 1  # last line from which there are enough words up to this one's end
        back = np.flatnonzero(begin >= first[:-1][owner])
        start, length = begin[back], back + 1 - begin[back]
        more = (length != run[start]) & whole_runs
        start, length = np.concatenate([own[run > 0], start[more]]), np.concatenate([run[run > 0], length[more]])
        order = np.argsort(start, kind="stable")
        lens = pa.ListArray.from_arrays(pa.array(np.searchsorted(start[order], np.arange(len(starts) + 1)).astype(np.int32)), pa.array(length[order].astype(np.int64)))
        yield _text.batch_of(schema, d=b.column("doc_id").take(pa.array(owner)), th=b.column("th").take(pa.array(owner)), pos=own - first[:-1][owner], h=h.view(np.int64), lens=lens)


KEY = ("d", "th")
PLACE = [*KEY, "pos"]


def ranked(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The rows whose key occurs again, with ``r``: the number of such rows with a smaller key."""
    spark = rows.sparkSession
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = stored(groups.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))
    sums, at = [], 0
    for part, n in sorted(groups.groupBy("part").agg(F.sum("n")).collect()):  # one row for each partition
        sums.append((part, at))
        at += n
    before = spark.createDataFrame(sums, "part int, before long")
    own = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.join(F.broadcast(before), "part").withColumn("r", F.col("before") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    return spread_join(rows, groups.select(*keys, "n", "r"), keys, PLACE, total).drop("n")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, whole_runs: bool = False) -> DataFrame:
    """Rows (d, th, pos, len): later copies of runs of lines that together reach ``min_words`` words; see dedup_lines()."""
    lines = stored(docs.mapInArrow(lambda it: _lines(it, min_words, whole_runs), "d long, th long, pos long, h long, lens array<long>").dropDuplicates(["d", "th", "pos"]))
    total = lines.count()
    level = stored(ranked(lines, ["h"], total).select(*PLACE, "r", "lens"))
    forget(lines)
    found, k = None, 0
    order = F.struct(F.col("d").isNull(), "d", "th", "pos")
    while True:
        step = 1 << k
        most = level.agg(F.max(F.array_max("lens"))).first()[0]
        if not most or most < step:
            break
        other = level.select(F.col("d").alias("d2"), F.col("th").alias("th2"), F.col("pos").alias("pos2"), F.col("r").alias("r2"))
        same = F.col("d").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("th2"))
        pairs = level.select(*PLACE, "r", F.explode("lens").alias("len")).where(f"len >= {step} and len < {2 * step}")
        pairs = pairs.join(other, same & (F.col("pos") + F.col("len") - step == F.col("pos2"))) if k else pairs.withColumn("r2", F.col("r"))
        pairs = pairs.select(*PLACE, "len", "r", "r2")
        key = ["r", "r2", "len"]
        first = pairs.groupBy(*key).agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1")
        later = spread_join(pairs, first, key, PLACE, 2 * total).where(order > F.col("f")).select(*PLACE, "len")
        later = stored(later)
        found = later if found is None else found.unionByName(later)
        if most < 2 * step:
            break
        grown = level.join(other, same & (F.col("pos") + step == F.col("pos2"))).select(*PLACE, F.col("r").alias("r1"), "r2", "lens")
        level = stored(ranked(grown, ["r1", "r2"], total).select(*PLACE, "r", "lens"))
        k += 1
    return found if found is not None else level.select(*PLACE, F.lit(0).cast("long").alias("len")).limit(0)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, details: bool = False, whole_runs: bool = False) -> DataFrame:
    """``docs`` (all columns) with later copies of repeated line runs deleted from ``text``.

    Copies are ordered by doc_id (null last), then text hash, then line, so
    every deleted line is kept at its first place.  Rows alike in doc_id and
    text count as one document and are treated alike.  Null and empty texts
    stay as they are; lines of a run are deleted with their line breaks.  An
    empty table gives an empty table; other columns may have any names.
    With ``whole_runs`` maximal repeated runs go to their last line; without it
    only the shortest run from each line does, which leaves the last lines of a
    run if fewer than ``min_words`` words are left in it.
    ``details`` adds n_lines, n_removed, n_spans (maximal deleted runs); where a
    column has such a name, the new one gets underscores before it.
    """
    names = docs.columns
    extra = [free_name(names, c) for c in ("n_lines", "n_removed", "n_spans")] if details else []
    runs = repeated_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th")), min_words, whole_runs)
    spans = runs.groupBy("d", "th").agg(F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("s"))  # of one document each
    own_d, own_th, other_d, other_th, begin, size = (free_name(names, x) for x in ("own_d", "own_th", "other_d", "other_th", "begin", "size"))
    spans = spans.select(F.col("d").alias(other_d), F.col("th").alias(other_th), F.expr("transform(s, x -> x.pos)").alias(begin), F.expr("transform(s, x -> x.len)").alias(size))
    keyed = docs.withColumns({own_d: F.col("doc_id").cast("long"), own_th: F.xxhash64(F.col("text").cast("string"))})
    joined = keyed.join(spans, F.col(own_d).eqNullSafe(F.col(other_d)) & (F.col(own_th) == F.col(other_th)), "left").select(*(F.col(f"`{c}`") for c in names), begin, size)
    schema = StructType(list(docs.schema.fields))
    for c in extra:
        schema = schema.add(c, "long")

    def cut(batches):
        for b in _text.pieces(batches):
            texts = b.column("text").to_pylist()
            starts, lens = b.column(begin).to_pylist(), b.column(size).to_pylist()
            counts = []
            for i, t in enumerate(texts):
                lines = t.split("\n") if t else []
                n = len(lines) - (bool(lines) and lines[-1] == "")
                gone = np.zeros(n + 1, bool)
                for s, e in zip(starts[i] or (), lens[i] or (), strict=True):
                    gone[s : s + e] = True
                counts.append((n, int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if n else 0))
                if starts[i]:
                    texts[i] = "\n".join([x for x, g in zip(lines, [*gone[:n], False], strict=False) if not g])
            at = b.schema.get_field_index("text")
            out = b.drop_columns([begin, size]).set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            for k, c in enumerate(extra):
                out = out.append_column(c, pa.array([x[k] for x in counts], pa.int64()))
            yield out

    return joined.mapInArrow(cut, schema)

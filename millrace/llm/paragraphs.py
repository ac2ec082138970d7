"""Substring dedup by paragraph MinHash banding, exact Jaccard verification and components.

Paragraphs are the lines of a text.  Those alike in their words share one
identity; each distinct paragraph's shingle set gets a MinHash signature whose
bands are tuned so that a pair at the threshold collides with probability
``recall``.  Colliding paragraphs are verified by exact Jaccard similarity,
linked to components, and every copy but a component's first is removed.

A passage may also lie inside longer paragraphs.  Runs of words are therefore
selected by winnowing, equal ones are matched, and each match is followed word
by word to the passage's ends; later copies of ``PASSAGE`` words or more go.

Words, shingles and paragraphs are named by 64-bit hashes, selected runs by 128
bits.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._graph import components
from millrace.llm._store import input_bytes, key_filter, maybe_in, partitions_for, spread_join, stored
from millrace.llm.candidates import BLOCK_DDL, Packer, bucket_bits, groups, heavy_signatures, linked, sketch
from millrace.llm.lines import line_spans
from millrace.llm.suffixes import _merge, _sliding_minimum

MIN_WORDS = 20
#: Words of the shortest passage that goes although it is no paragraph, and words of the runs that find it.
PASSAGE = 50
PASSAGE_GRAM = 26
ROWS = 4


def tuned_bands(percent: int, recall: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` values such that a pair at the threshold collides with probability ``recall`` at least."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows)))


def _paragraphs(b, min_words: int):
    """Of a piece: (owner, position, identity) of its paragraphs, their words' hashes, each one's first word, and which have enough words."""
    buf, offs = _text.column_bytes(b.column("text"))
    starts, ends, first = line_spans(buf, offs) if len(buf) else (np.zeros(0, np.int64),) * 2 + (np.zeros(len(offs), np.int64),)
    h, word_starts, _, _ = _text.words(buf, offs)
    at = np.searchsorted(word_starts, np.append(starts, len(buf)))
    owner = np.repeat(np.arange(b.num_rows), np.diff(first))
    pos = np.arange(len(starts)) - first[:-1][owner]
    enough = np.diff(at) >= max(1, min_words)
    code = _text.sequence_hash(h, at)  # identity: the words in their order
    return owner, pos, code, h, at, np.flatnonzero(enough)


def _shingle_sets(h: np.ndarray, at: np.ndarray, use: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The shingles of some of the runs ``h[at[i]:at[i + 1]]``, repeated ones too."""
    size = at[use + 1] - at[use]
    first = np.zeros(len(use) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    s, to = _text.shingles(h[np.arange(first[-1]) + np.repeat(at[use] - first[:-1], size)], first, shingle)
    return [s[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]


def _minhash(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row for each set; sets are not empty."""
    every = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    rng = np.random.default_rng(97)
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        value = np.zeros(len(sets), np.uint64)
        for _ in range(rows):
            a, c = (int(x) for x in rng.integers(0, 1 << 63, 2))
            low = np.minimum.reduceat((every ^ np.uint64(c)) * np.uint64(2 * a + 1), at)
            value = _text.mix(value * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = _text.mix(value + np.uint64(band * 0x632BE59BD9B4E019 & ((1 << 64) - 1)))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))


def paragraph_components(docs: DataFrame, percent: int = 80, shingle: int = 5, min_words: int = MIN_WORDS, recall: float = 0.999):
    """(occurrences, components): rows (d, th, pos, id) of all paragraphs looked at, and (u, v) between identities, v the smaller."""
    spark = docs.sparkSession
    bands = tuned_bands(percent, recall)
    size = input_bytes(docs)
    parts = partitions_for(spark, size, 8 << 20)
    bits = bucket_bits(parts)
    occurrence = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("pos", pa.int64()), ("id", pa.int64())])

    def scan(batches):
        for b in _text.pieces(batches):
            owner, pos, code, _, _, use = _paragraphs(b, min_words)
            take = pa.array(owner[use])
            yield _text.batch_of(occurrence, d=b.column("doc_id").take(take), th=b.column("th").take(take), pos=pos[use], id=code[use].view(np.int64))

    def sign(make, batches):
        packer, seen = make(), np.zeros(0, np.uint64)
        for b in _text.pieces(batches):
            _, _, code, h, at, use = _paragraphs(b, min_words)
            use = use[np.unique(code[use], return_index=True)[1]]
            use = use[~np.isin(code[use], seen)]
            if not len(use):
                continue
            seen = np.concatenate([seen, code[use]])[-500_000:]
            sig = _minhash(_shingle_sets(h, at, use, shingle), bands, ROWS)
            yield from packer.add(sig.ravel(), np.repeat(code[use], bands))
        yield from packer.flush()

    where = stored(_keyed(docs).mapInArrow(scan, "d long, th long, pos long, id long").dropDuplicates(["d", "th", "pos"]))
    heavy = heavy_signatures(_keyed(docs), lambda every: partial(sign, every))
    members = groups(_keyed(docs).mapInArrow(partial(sign, lambda: Packer(bits, heavy)), BLOCK_DDL), parts, bits, heavy)
    set_schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("s", pa.binary())])

    members = stored(members)
    filters = spark.sparkContext.broadcast(key_filter(members.select("id").distinct(), "id", 1 << 25))

    def sets(batches):
        seen = np.zeros(0, np.uint64)
        for b in _text.pieces(batches):
            _, _, code, h, at, use = _paragraphs(b, min_words)
            use = use[np.unique(code[use], return_index=True)[1]]
            use = use[maybe_in(filters.value, code[use]) & ~np.isin(code[use], seen)]
            seen = np.concatenate([seen, code[use]])[-500_000:]
            if len(use):
                own = [np.unique(x) for x in _shingle_sets(h, at, use, shingle)]
                yield _text.batch_of(set_schema, id=code[use].view(np.int64), n=[len(x) for x in own], sketch=[sketch(x, 3) for x in own], s=[x.tobytes() for x in own])

    found = stored(_keyed(docs).mapInArrow(sets, "id long, n long, sketch binary, s binary").dropDuplicates(["id"]))

    def verify(pairs):
        return verified(pairs, found, percent)

    def sets_of(wanted):
        return found.select("id", "s").join(wanted, "id")

    edges = linked(members, sets_of, verify, percent)
    return where, components(edges)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (id, s: sorted 64-bit values) have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    near = F.least(F.length("sa"), F.length("sb")) * 100 >= F.greatest(F.length("sa"), F.length("sb")) * percent
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("sa"), b.column("sb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                keep[i] = shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)
            if keep.any():
                m = pa.array(keep)
                yield _text.batch_of(schema, a=b.column("a").filter(m), b=b.column("b").filter(m))

    return pairs.join(left, "a").join(right, "b").where(near).mapInArrow(compare, "a long, b long")


def selected_grams(hashes: np.ndarray, first: np.ndarray, gram: int, least: int):
    """(text, word, identity, second identity) of the selected runs of ``gram`` words.

    Winnowing: of each ``least - gram + 1`` neighbouring runs the one with the
    smallest identity is selected, the leftmost on a tie.  So every common
    passage of ``least`` words holds a selected run of both texts, and
    neighbouring selected runs of a passage overlap or touch.
    """
    width, n = least - gram + 1, len(hashes) - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    steps = [np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)) for j in range(gram)]
    one = np.zeros(n, np.uint64)
    for s in range(0, n, 1 << 15):  # so that a stretch stays in the cache
        total = one[s : s + (1 << 15)]
        for j, step in enumerate(steps):
            total += _text.mix(hashes[s + j : s + j + len(total)] + step)
    one = _text.mix(one)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    start = np.arange(n - width + 1)
    whole = owner[start] == owner[start + least - 1]
    # the place is part of the key, so that the first of equal values is smaller
    places = np.uint64((1 << 22) - 1)
    picks = []
    for s in range(0, len(start), 1 << 21):
        e = min(len(start), s + (1 << 21))
        key = (one[s : e + width - 1] & ~places) | np.arange(e + width - 1 - s, dtype=np.uint64)
        picks.append((_sliding_minimum(key, width) & places).astype(np.int64)[whole[s:e]] + s)
    at = np.unique(np.concatenate(picks))
    two = np.zeros(len(at), np.uint64)
    for j, step in enumerate(steps):
        two += _text.mix(hashes[at + j] ^ step)
    return owner[at], at, one[at], _text.mix(two)


def repeated_passages(docs: DataFrame, least: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """(d, th, s, e, source, shift): words s to e of a text that the text ``source`` holds too, ``shift`` words on.

    Selected runs of ``gram`` words that occur before are matched with their
    first occurrence.  Where the neighbouring selected run is no match of the
    same source and shift, the words up to the passage's end are compared one
    by one.  Matches of one source and shift that overlap or touch are one
    passage; those of ``least`` words or more go, others stay.
    """
    if 2 * gram < least + 1:
        raise ValueError("selected runs must be longer than the gaps between them")
    spark, reach = docs.sparkSession, least - gram
    counted = pa.schema([("id", pa.int64()), ("n", pa.int64())])
    names = ("d", "th", "at", "id", "id2")
    found = pa.schema([*((c, pa.int64()) for c in (*names, "room")), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))])

    def count(batches):
        for b in _text.pieces(batches):
            h, _, _, first = _text.words(*_text.column_bytes(b.column("text")))
            ids, n = np.unique(selected_grams(h, first, gram, least)[2], return_counts=True)
            yield _text.batch_of(counted, id=ids.view(np.int64), n=n)

    again = stored(_keyed(docs).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where("n > 1").select("id"))
    filters = spark.sparkContext.broadcast(key_filter(again, "id", 1 << 25))

    def find(batches):
        for b in _text.pieces(batches):
            h, _, _, first = _text.words(*_text.column_bytes(b.column("text")))
            owner, at, one, two = selected_grams(h, first, gram, least)
            hit = maybe_in(filters.value, one)
            owner, at, one, two = owner[hit], at[hit], one[hit], two[hit]
            if not len(at):
                continue
            joins = (owner[1:] == owner[:-1]) & (at[1:] - at[:-1] <= gram)  # with the next match
            low = np.where(np.concatenate([[False], joins]), at, np.maximum(at - reach, first[owner]))
            high = np.where(np.concatenate([joins, [False]]), at + gram, np.minimum(at + gram + reach, first[owner + 1]))
            take = pa.array(owner)
            yield _text.batch_of(
                found, d=b.column("doc_id").take(take), th=b.column("th").take(take), at=at - first[owner], id=one.view(np.int64), id2=two.view(np.int64),
                room=first[owner + 1] - at - gram, before=_lists(h, low, at), after=_lists(h, at + gram, high),
            )

    rows = _keyed(docs).mapInArrow(find, ", ".join(f"{c} long" for c in (*names, "room")) + ", before array<long>, after array<long>")
    rows = stored(rows.join(again, "id", "left_semi").dropDuplicates(["d", "th", "at"]))
    order = F.struct(F.col("d").isNull(), "d", "th", "at")
    heads = stored(rows.groupBy("id", "id2").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1"))
    later = spread_join(rows, heads, ["id", "id2"], ["d", "th", "at"], rows.count()).where(order > F.col("f"))
    later = later.select("d", "th", "at", "room", "before", "after", F.col("f.th").alias("th0"), (F.col("f.at") - F.col("at")).alias("shift"))
    # where the next run that was found is of another source or shift, words on that side have not been sent along
    text = Window.partitionBy("d", "th").orderBy("at")

    def goes_on(step):
        other = step(F.struct("th0", "shift", "at"), 1).over(text)
        return F.coalesce((other["th0"] == F.col("th0")) & (other["shift"] == F.col("shift")) & (F.abs(other["at"] - F.col("at")) <= gram), F.lit(False))

    later = later.withColumns({
        "open_before": (F.size("before") == 0) & (F.col("at") > 0) & ~goes_on(F.lag), "open_after": (F.size("after") == 0) & (F.col("room") > 0) & ~goes_on(F.lead),
    }).drop("room")
    later = stored(later)
    open_ = F.col("open_before") | F.col("open_after")
    edge = open_ | (F.size("before") + F.size("after") > 0)
    ends, inner = later.where(edge), later.where(~edge)
    places = ends.select(F.col("th0").alias("th"), (F.col("at") + F.col("shift")).alias("at")).unionByName(later.where(open_).select("th", "at"))
    there = stored(_words_around(docs, places.distinct(), gram, reach))
    source = there.select(F.col("th").alias("th0"), F.col("at").alias("at0"), F.col("before").alias("b0"), F.col("after").alias("a0"))
    own = there.select("th", "at", F.col("before").alias("b1"), F.col("after").alias("a1"))

    def shared(mine, other):
        place = F.array_position(F.zip_with(mine, other, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        return F.when(place == 0, F.greatest(F.size(mine), F.size(other))).otherwise(place - 1)

    known = ends.where(~open_).withColumns({"b1": F.col("before"), "a1": F.col("after")})
    asked = ends.where(open_).join(own, ["th", "at"])
    asked = asked.withColumns({"b1": F.when(F.col("open_before"), F.col("b1")).otherwise(F.col("before")), "a1": F.when(F.col("open_after"), F.col("a1")).otherwise(F.col("after"))})
    ends = known.unionByName(asked).withColumn("at0", F.col("at") + F.col("shift")).join(source, ["th0", "at0"]).select(
        "d", "th", (F.col("at") - shared(F.reverse("b1"), F.reverse("b0"))).alias("s"), (F.col("at") + gram + shared(F.col("a1"), F.col("a0"))).alias("e"), "th0", "shift"
    )
    inner = inner.select("d", "th", F.col("at").alias("s"), (F.col("at") + gram).alias("e"), "th0", "shift")
    return inner.unionByName(ends).select("d", "th", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.col("th0").alias("source"), "shift")


def _lists(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.ListArray:
    """Lists ``h[start[i]:end[i]]``."""
    size = end - start
    offs = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offs[1:])
    pick = np.arange(offs[-1]) + np.repeat(start - offs[:-1], size)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(h[pick].view(np.int64)))


def _words_around(docs: DataFrame, places: DataFrame, gram: int, reach: int) -> DataFrame:
    """(th, at, before, after): hashes of up to ``reach`` words on both sides of the run at ``at`` of the texts ``th``."""
    spark = docs.sparkSession
    places = stored(places)
    wanted = spark.sparkContext.broadcast(key_filter(places.select("th").distinct(), "th"))
    per_text = places.groupBy("th").agg(F.collect_list("at").alias("at"))  # at most one for each word of a text
    schema = pa.schema([("th", pa.int64()), ("at", pa.int64()), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))])
    keyed = _keyed(docs).select("th", "text")

    def chosen(batches):
        for b in batches:
            yield b.filter(pa.array(maybe_in(wanted.value, b.column("th").to_numpy())))

    def around(batches):
        for b in _text.pieces(batches):
            h, _, _, first = _text.words(*_text.column_bytes(b.column("text")))
            lists = b.column("at")
            owner = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            own = lists.flatten().to_numpy()
            at = own + first[owner]
            yield _text.batch_of(
                schema, th=b.column("th").take(pa.array(owner)), at=own, before=_lists(h, np.maximum(at - reach, first[owner]), at),
                after=_lists(h, at + gram, np.minimum(at + gram + reach, first[owner + 1])),
            )

    texts = keyed.where("text is not null").mapInArrow(chosen, keyed.schema).dropDuplicates(["th"])
    return texts.join(per_text, "th").mapInArrow(around, "th long, at long, before array<long>, after array<long>")


_SPAN = ("s", "e", "source", "shift")


def _passages(s: np.ndarray, e: np.ndarray, source: np.ndarray, shift: np.ndarray):
    """Spans of ``PASSAGE`` words or more; only matches of one source and shift are joined."""
    order = np.lexsort((shift, source))
    s, e, source, shift = s[order], e[order], source[order], shift[order]
    cuts = np.flatnonzero((source[1:] != source[:-1]) | (shift[1:] != shift[:-1])) + 1
    made = [_merge(a, b) for a, b in zip(np.split(s, cuts), np.split(e, cuts), strict=True)]
    s, e = (np.concatenate(c) for c in zip(*made, strict=True))
    long = e - s >= PASSAGE
    return s[long], e[long]


def dedup_paragraphs(docs: DataFrame, percent: int = 80, shingle: int = 5, min_words: int = MIN_WORDS, recall: float = 0.999, passages: bool = True) -> DataFrame:
    """(doc_id, n_paragraphs, removed, n_bytes, n_removed, n_spans, starts, ends, kept): texts without later copies.

    Of each component of near-duplicate paragraphs the first by doc_id (null
    last), text hash and position stays; ``removed`` lists the positions of
    the others, which go with their line breaks.  Paragraphs of fewer than
    ``min_words`` words are not compared.  A passage inside longer paragraphs
    is no near-duplicate paragraph: with ``passages``, later copies of equal
    passages of ``PASSAGE`` words or more go too, if one earlier text or place
    holds them whole; see repeated_passages().  ``starts`` and ``ends`` are the maximal removed byte
    spans, n_removed their bytes, ``kept`` the rest.  Null texts count as
    empty.  Rows alike in doc_id and text are treated alike.
    """
    where, comp = paragraph_components(docs, percent, shingle, min_words, recall)
    order = F.struct(F.col("d").isNull(), "d", "th", "pos")
    each = where.groupBy("id").agg(F.min(order).alias("own"), F.count("*").alias("n"))
    each = each.join(comp.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    first = each.groupBy("c").agg(F.min("own").alias("f"), F.sum("n").alias("all")).where("all > 1")
    first = stored(each.join(first, "c").select("id", "f", "n"))
    later = spread_join(where, first, ["id"], ["d", "th", "pos"], where.count()).where(order > F.col("f"))
    none = F.lit(-1).cast("long")
    later = later.select("d", "th", F.col("pos").alias("s"), none.alias("e"), none.alias("source"), none.alias("shift"))
    if passages:
        later = later.unionByName(repeated_passages(docs))
    spans = later.groupBy("d", "th").agg(F.collect_list(F.struct("s", "e", "source", "shift")).alias("w"))  # of one text each
    spans = stored(spans.select("d", "th", *(F.expr(f"transform(w, x -> x.{c})").alias(c) for c in _SPAN)))
    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(spans.select("th").distinct(), "th"))
    docs = _keyed(docs)

    def chosen(inside, batches):
        for b in batches:
            yield b.filter(pa.array(maybe_in(wanted.value, b.column("th").to_numpy()) == inside))

    changed = docs.mapInArrow(partial(chosen, True), docs.schema)  # only these texts are shuffled
    changed = changed.join(spans, changed["doc_id"].eqNullSafe(spans["d"]) & (changed["th"] == spans["th"]), "left").select("doc_id", "text", *_SPAN)
    kinds = {"doc_id": "long", "n_paragraphs": "long", "removed": "array<long>", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "starts": "array<long>", "ends": "array<long>", "kept": "binary"}
    arrow = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    schema = pa.schema([(c, arrow[k]) for c, k in kinds.items()])

    def cut(batches):
        for b in _text.pieces(batches):
            lists = [b.column(c).to_pylist() if c in b.schema.names else [None] * b.num_rows for c in _SPAN]
            buf, offs = _text.column_bytes(b.column("text"))
            starts, _, first = line_spans(buf, offs) if len(buf) else (np.zeros(0, np.int64), None, np.zeros(b.num_rows + 1, np.int64))
            if any(e and max(e) >= 0 for e in lists[1]):  # no words are looked for where only lines go
                word_starts, word_ends, word_first = _text.word_spans(buf, offs)
            rows = []
            for i in range(b.num_rows):
                x, (s, e, source, shift) = buf[offs[i] : offs[i + 1]].tobytes(), (c[i] for c in lists)
                n = int(first[i + 1] - first[i])
                if not s:
                    rows.append((n, [], len(x), 0, 0, [], [], x))
                    continue
                s, e = np.array(s), np.array(e)
                own = np.append(starts[first[i] : first[i + 1]] - offs[i], len(x))
                line = e < 0
                gone = np.sort(s[line])
                from_, to = own[gone], own[gone + 1]
                if not line.all():
                    s, e = _passages(*(np.array(c)[~line] for c in (s, e, source, shift)))
                    s, e = s + word_first[i], e + word_first[i]
                    from_, to = np.concatenate([from_, word_starts[s] - offs[i]]), np.concatenate([to, word_ends[e - 1] - offs[i]])
                if not len(from_):
                    rows.append((n, [], len(x), 0, 0, [], [], x))
                    continue
                s, e = _merge(from_, to)
                kept = b"".join(x[a:c] for a, c in zip([0, *e], [*s, len(x)], strict=True))
                rows.append((n, gone.tolist(), len(x), len(x) - len(kept), len(s), s.tolist(), e.tolist(), kept))
            yield _text.batch_of(schema, doc_id=b.column("doc_id"), **dict(zip(list(kinds)[1:], map(list, zip(*rows, strict=True)), strict=True)))

    ddl = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return changed.mapInArrow(cut, ddl).unionByName(docs.mapInArrow(lambda batches: cut(chosen(False, batches)), ddl))

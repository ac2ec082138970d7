"""SentencePiece encoding and decoding by N-best segmentation over the piece lattice.

A text's lattice has a node at every character and an arc for every vocabulary
piece.  Forward Viterbi gives each node its best score from the start; these
scores are exact heuristics for an A-star search backwards from the end, which
therefore expands only arcs of the N best paths.  No piece spans the start of a
new word, so the lattice falls apart into segments.  Each distinct segment's best
path, and what its second best loses, is found once per worker; of a text only
the N - 1 segments that lose least can differ in its N best segmentations, and
only those are searched further.

Scores are those of the model file, but a piece that the file keeps and never
merges (score -1e9) costs as much as an unknown character.  Only model files
whose normalisation leaves texts as they are, but for the space before the
first word, are taken.
"""

from __future__ import annotations

import re
from bisect import insort
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text

SPACE = "▁"
#: Estimated bytes of distinct segments kept by a worker before its cache starts anew, and those of an entry without its characters.
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 250
#: Characters without a piece cost this much more than the worst piece.
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        probe = "Ａ ﬁ　x\n\tz  é́"
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{model_file} changes texts before it segments them")
        n = sp.get_piece_size()
        self.arc, self.byte, self.raw = {}, {}, [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.arc[piece] = (i, float(sp.get_score(i)))
                self.raw[i] = piece.replace(SPACE, " ").encode()
        self.unk = sp.unk_id()
        usual = [s for _, s in self.arc.values() if s > -1e8]
        self.unknown = min(usual, default=0.0) - UNKNOWN_PENALTY
        # pieces that the model keeps but never merges to (score -1e9) cost as much as an unknown character
        self.arc = {p: (i, max(s, self.unknown)) for p, (i, s) in self.arc.items()}
        self.single = {p for p in self.arc if len(p) == 1}
        self.root: dict = {}  # trie of the pieces: character -> [children, (id, score) or None]
        for p, hit in self.arc.items():
            children = self.root
            for c in p:
                node = children.setdefault(c, [{}, None])
                children = node[0]
            node[1] = hit
        spanning = any(SPACE in p.lstrip(SPACE) for p in self.arc)
        self.split = None if spanning else re.compile(self._segment_pattern())

    def _segment_pattern(self) -> str:
        """Cuts before word starts, around newlines, and between a letter and a mark, where no piece has both sides."""
        inside = {p[i : i + 2] for p in self.arc for i in range(len(p) - 1)}
        stop = "" if any("\n" in x for x in inside) else "\n"
        whole = f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + (f"|{stop}" if stop else "")
        marks = ".,;:!?*#$%&|"
        letters = [c for c in {c for p in self.arc for c in p if c.isalpha()} if not any(c + m in inside for m in marks)]
        if not letters:
            return whole
        any_letter, any_mark = f"[{re.escape(''.join(sorted(letters)))}]", f"[{re.escape(marks)}]"
        return f"{SPACE}*[^{SPACE}{stop}{re.escape(marks)}]*{any_letter}(?={any_mark})|{whole}"

    def segments(self, text: str) -> list[str]:
        """The text with its spaces as marks and one before it, cut where no piece crosses."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return self.split.findall(marked) if self.split else [marked]

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte.get(b, self.unk) for b in char.encode("utf-8", "replace"))

    def best(self, segment: str) -> tuple[list[int], float, float]:
        """Ids and score of the best path of a segment, and what the second best path loses against it.

        The second best path leaves the best one once, at a node where its arc is
        the second best, so two values for each node are enough.
        """
        size, root, unknown, low = len(segment), self.root, self.unknown, float("-inf")
        best, second, back = [0.0] + [low] * size, [low] * (size + 1), [None] * (size + 1)
        for i in range(size):
            here, children, j, lone = best[i], root, i, True
            while j < size:
                node = children.get(segment[j])
                if node is None:
                    break
                j += 1
                children, hit = node
                if hit is not None:
                    if j == i + 1:
                        lone = False
                    score = here + hit[1]
                    if score > best[j]:
                        second[j] = best[j]
                        best[j] = score
                        back[j] = (i, hit[0])
                    elif score > second[j]:
                        second[j] = score
            if lone:
                j, score = i + 1, here + unknown
                if score > best[j]:
                    second[j] = best[j]
                    best[j] = score
                    back[j] = (i, -1)
                elif score > second[j]:
                    second[j] = score
        ids: list[int] = []
        loss, at = float("inf"), size
        while at:
            if best[at] - second[at] < loss:
                loss = best[at] - second[at]
            at, i = back[at]
            if i >= 0:
                ids.append(i)
            else:
                ids += self.fallback(segment[at])[::-1]
        ids.reverse()
        return ids, best[size], loss

    def nbest(self, segment: str, n: int) -> tuple[list[tuple[int, ...]], list[float]]:
        """Ids and scores of the n best paths of a segment, best first.

        On a tie the path with the longer last piece is the best.
        """
        size, root, unknown = len(segment), self.root, self.unknown
        best = [0.0] + [float("-inf")] * size
        back: list = [None] * (size + 1)
        into: list[list] = [[] for _ in range(size + 1)]
        for i in range(size):
            here, children, j = best[i], root, i
            while j < size:
                node = children.get(segment[j])
                if node is None:
                    break
                j += 1
                children, hit = node
                if hit is not None:
                    score = here + hit[1]
                    into[j].append((i, score, hit[0]))
                    if score > best[j]:
                        best[j] = score
                        back[j] = (i, hit[0])
            j = i + 1
            if segment[i] not in self.single:
                into[j].append((i, here + unknown, -1))
                if here + unknown > best[j]:
                    best[j] = here + unknown
                    back[j] = (i, -1)
        # backward A-star: an open path's value is its exact best total, so only
        # what it loses against the best path counts and the first n ends are the n best
        top, ids, found, heap, bound, spare = best[size], [], [], [(0.0, 0, size, None)], [], n - 1
        count = 0
        while heap and len(found) < n:
            loss, _, at, path = heappop(heap)
            found.append(top - loss)
            while at:  # follow the best way to the start, leave every other arc open
                follow, piece = back[at]
                if spare:
                    value = best[at] + loss
                    for start, score, other_piece in into[at]:
                        if start != follow:
                            other = value - score
                            if len(bound) >= spare:
                                if other >= bound[-1]:
                                    continue
                                bound.pop()
                            insort(bound, other)
                            count += 1
                            heappush(heap, (other, count, start, (other_piece, start, path)))
                path = (piece, follow, path)
                at = follow
            own: list[int] = []
            while path:
                piece, start, path = path
                if piece >= 0:
                    own.append(piece)
                else:
                    own += self.fallback(segment[start])
            ids.append(tuple(own))
        return ids, found

    def decode(self, ids) -> str:
        """Text of a sequence of ids; the space before the first word is no part of it."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def document_nbest(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best sums that take one entry of every list, and which entry of each; lists are sorted, best first."""
    total: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for options in lists:
        total = sorted(((a + b, (*way, k)) for a, way in total for k, b in enumerate(options)), key=lambda x: -x[0])[:n]
    return total


class Encoder:
    """Segment cache of one worker: ids and score of each segment's best path, what the second best loses, and the n best of a few."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.v, self.n = vocabulary, n
        self._new()

    def _new(self):
        self.index: dict[str, int] = {}
        self.bytes = 0
        self.further: dict[str, tuple] = {}
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.top, self.loss = np.zeros(0), np.zeros(0)

    def _add(self, paths: list):
        """Append newly searched segments to the arrays."""
        if paths:
            ids, top, loss = zip(*paths, strict=True)
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in ids])])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32)])
            self.top, self.loss = np.concatenate([self.top, top]), np.concatenate([self.loss, loss])

    def _nbest(self, segment: str):
        """Ids of the n best paths of a segment and what each loses."""
        hit = self.further.get(segment)
        if hit is None:
            ids, scores = self.v.nbest(segment, self.n)
            self.bytes += ENTRY_BYTES + 200 * self.n
            hit = self.further[segment] = (ids, [x - scores[0] for x in scores])
        return hit

    def encode(self, texts: list[str]):
        """(ids of the best segmentation, first id of each text, of each text the scores of its n best, and the edits that make those after the best).

        An edit is (place in the best ids, how many go, ids that come).
        """
        if self.bytes > CACHE_BYTES:
            self._new()
        index, found, new, cut, best = self.index, [], [], [], self.v.best
        for text in texts:
            segments = self.v.segments(text)
            own = list(map(index.get, segments))
            if None in own:
                for k, i in enumerate(own):
                    if i is None:
                        seg = segments[k]
                        i = index.get(seg)
                        if i is None:
                            i = index[seg] = len(index)
                            self.bytes += ENTRY_BYTES + 8 * len(seg)
                            new.append(best(seg))
                        own[k] = i
            found.append(np.array(own, np.int64))
            cut.append(segments)
        self._add(new)
        flat, start, tops, loss = self.flat, self.start, self.top, self.loss
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        every = np.concatenate(found) if found else np.zeros(0, np.int64)
        count = start[every + 1] - start[every]
        shift = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        ids = flat[np.arange(shift[-1]) + np.repeat(start[every] - shift[:-1], count)]
        scores, more = [], []
        for i, segments in enumerate(cut):
            low = at[i]
            own = every[low : at[i + 1]]
            score = float(tops[own].sum())
            if self.n > 1 and len(own):
                near = np.argpartition(loss[own], min(self.n - 2, len(own) - 1))[: self.n - 1]
                near.sort()
                options = [self._nbest(segments[k]) for k in near]
                ways = document_nbest([x[1] for x in options], self.n)
                scores.append([score + d for d, _ in ways])
                for _, way in ways[1:]:
                    edits = []
                    for k, option, choice in zip(near, options, way, strict=True):
                        if choice:
                            edits.append((int(shift[low + k] - shift[low]), int(count[low + k]), option[0][choice]))
                    more.append(edits)
            else:
                scores.append([score])
        return ids, shift[at], scores, more


EDITS = "array<array<struct<at:int,drop:int,ids:array<int>>>>"


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _nested(edits: list, scores: list) -> pa.Array:
    """The edits of all segmentations after the best, by text."""
    flat = [e for own in edits for e in own]
    ids = pa.ListArray.from_arrays(_offsets([len(e[2]) for e in flat]), pa.array([i for e in flat for i in e[2]], pa.int32()))
    fields = pa.StructArray.from_arrays([pa.array([e[0] for e in flat], pa.int32()), pa.array([e[1] for e in flat], pa.int32()), ids], ["at", "drop", "ids"])
    return pa.ListArray.from_arrays(_offsets([len(x) - 1 for x in scores]), pa.ListArray.from_arrays(_offsets([len(x) for x in edits]), fields))


def encode(docs: DataFrame, model_file: str, n: int = 4) -> DataFrame:
    """Encode whole texts.

    Columns: doc_id, ids (best segmentation), scores (of the n best
    segmentations, best first; fewer where a text has fewer), others (the
    segmentations after the best, in that order, as edits of ids: at place
    ``at`` from 0, ``drop`` ids go and ``ids`` come; see segmentations()),
    round_trip (decoding ids gives the text back; U+2581 counts as a space).
    Null and empty texts have no ids, no others and the score 0.  Repeated
    rows get a row each, a null doc_id is kept, extra columns are ignored, an
    empty table gives an empty table.  ``model_file`` must exist on every
    executor.
    """
    number = pa.int32()
    edits = pa.list_(pa.list_(pa.struct([("at", number), ("drop", number), ("ids", pa.list_(number))])))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(number)), ("scores", pa.list_(pa.float64())), ("others", edits), ("round_trip", pa.bool_())])

    def run(batches):
        encoder = _worker_encoder(model_file, n)
        for b in _text.pieces(batches, keep_caches=True):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids, at, scores, more = encoder.encode(texts)
            back = [encoder.v.decode(ids[at[i] : at[i + 1]].tolist()) == t.replace(SPACE, " ") for i, t in enumerate(texts)]
            yield _text.batch_of(
                schema, doc_id=b.column("doc_id"), ids=pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), scores=scores,
                others=_nested(more, scores), round_trip=back,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, ids array<int>, scores array<double>, others {EDITS}, round_trip boolean"
    )


def segmentations(ids="ids", others="others") -> Column:
    """Column: array of the ids of all n best segmentations, best first, from columns of encode()."""
    ids, others = (F.col(c) if isinstance(c, str) else c for c in (ids, others))
    start = F.struct(F.slice(ids, 1, 0).alias("made"), F.lit(0).alias("next"))

    def edit(state, e):
        made = F.concat(state["made"], F.slice(ids, state["next"] + 1, e["at"] - state["next"]), e["ids"])
        return F.struct(made.alias("made"), (e["at"] + e["drop"]).alias("next"))

    def whole(state):
        return F.concat(state["made"], F.slice(ids, state["next"] + 1, F.greatest(F.size(ids) - state["next"], F.lit(0))))

    return F.concat(F.array(ids), F.transform(others, lambda edits: F.aggregate(edits, start, edit, whole)))


_encoders: dict = {}
_text.worker_caches.append(_encoders)


def _worker_encoder(model_file: str, n: int) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    if (model_file, n) not in _encoders:
        _encoders.clear()
        _encoders[model_file, n] = Encoder(Vocabulary(model_file), n)
    return _encoders[model_file, n]


def decode(frame: DataFrame, model_file: str) -> DataFrame:
    """Texts (doc_id, text) of the ids of encode(); null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        v = _worker_encoder(model_file, 1).v
        for b in batches:
            yield _text.batch_of(schema, doc_id=b.column("doc_id"), text=[None if x is None else v.decode(x) for x in b.column("ids").to_pylist()])

    return frame.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

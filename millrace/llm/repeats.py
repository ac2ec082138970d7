"""Operator 13: maximal runs of words within a text, by a suffix tree.

The tree stands in arrays: a suffix array by prefix doubling, its neighbours'
common lengths, and for each of its intervals (the inner nodes) depth, leaves
and parent.  Every leaf climbs from the top of one heavy path to the next, so
it meets only the nodes in whose smaller children it lies: the smaller-half
traversal.  At a node of depth q a leaf i asks whether i + q or i - q is also a
leaf of it and the words after the two squares' halves differ; that is a
branching tandem repeat.  Such a repeat is rotated to the left as far as its
halves keep agreeing, which gives the whole run, and runs of one stretch merge
into the one of the smallest period.

Before that, stretches that cannot hold a run go.  A run of at least six words
and four periods q has at each place five words that come again q words on or
back, and q is at most a quarter of the stretch of such places; places whose
nearest equal five words are farther are cut out, until nothing changes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import batch_of, column_bytes, mix, pieces

#: The shortest run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
GRAM = LEAST_WORDS - 1
#: Words of one tree, longer stretches have a tree of their own.
TREE_WORDS = 1 << 20

SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_dropped long"


def _candidates(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that may hold a run; none crosses from one text to the next."""
    n = len(ids)
    none = np.zeros(0, np.int64)
    if n < LEAST_WORDS:
        return none, none
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n - GRAM + 1)
    at = at[text[at] == text[at + GRAM - 1]]
    if not len(at):
        return none, none
    gram = mix(text[at].astype(np.uint64) + np.uint64(1))
    for k in range(GRAM):
        gram = mix(gram ^ mix(ids[at + k].astype(np.uint64)))
    order = np.argsort(gram, kind="stable")
    step = np.where(gram[order][1:] == gram[order][:-1], at[order][1:] - at[order][:-1], n)
    nearest = np.full(len(at), n)
    nearest[order[1:]] = step
    nearest[order[:-1]] = np.minimum(nearest[order[:-1]], step)
    while True:
        head = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (text[at][1:] != text[at][:-1])])) if len(at) else none
        size = np.diff(np.append(head, len(at)))
        words = size + GRAM - 1
        keep = (nearest * LEAST_PERIODS <= np.repeat(words, size)) & np.repeat(words >= LEAST_WORDS, size)
        if keep.all():
            return at[head], at[head] + words
        at, nearest = at[keep], nearest[keep]


def _levels(s: np.ndarray) -> list[np.ndarray]:
    """Ranks of the runs of 1, 2, 4, ... symbols from each place, up to the length where all differ; the end symbols differ from all others."""
    levels = [np.unique(s, return_inverse=True)[1].astype(np.int64)]
    n, h = len(s), 1
    while levels[-1].max() + 1 < n:
        key = levels[-1] * (n + 1)
        key[: n - h] += levels[-1][h:] + 1
        levels.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        h *= 2
    return levels


def _agree(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols from (or, ``back``, before) the places i and j on agree."""
    common = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        a, b = (i - common - width, j - common - width) if back else (i + common, j + common)
        ok = (a >= 0) & (b >= 0)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        common[ok] += width
    return common


def _intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``lcp`` the first and last suffix of its interval: how far no smaller value stands on either side."""
    n = len(lcp)
    tables = [lcp]
    while 2 << len(tables) - 1 <= n:
        last, half = tables[-1], 1 << len(tables) - 1
        tables.append(np.minimum(last[:-half], last[half:]))
    lo, hi = np.arange(n), np.arange(1, n + 1)
    for k in range(len(tables) - 1, -1, -1):
        width, table = 1 << k, tables[k]
        at = lo - width
        go = at >= 0
        go[go] = table[at[go]] >= lcp[go]
        lo[go] -= width
        go = hi + width <= n
        go[go] = table[hi[go]] >= lcp[go]
        hi[go] += width
    return lo - 1, hi - 1


def _tandem(s: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Branching tandem repeats: starts and lengths of their halves."""
    n = len(s)
    rank = levels[-1]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = _agree(levels, suffixes[:-1], suffixes[1:])
    lo, hi = _intervals(lcp)
    inner = np.flatnonzero(lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(inner):
        return none, none
    _, one, named = np.unique(lo[inner] * (n + 1) + hi[inner], return_index=True, return_inverse=True)
    node_at = np.full(n + 1, -1, np.int64)
    node_at[inner] = named
    one = inner[one]
    nodes = len(one)
    depth = lcp[one]
    left = np.concatenate([lo[one], np.arange(n)])  # inner nodes, then leaves
    right = np.concatenate([hi[one], np.arange(n)])
    parent = node_at[np.where(lcp[left] >= lcp[right + 1], left, right + 1)]
    order = np.lexsort((right - left, parent))
    heavy = np.zeros(len(parent), bool)
    heavy[order[np.append(parent[order][1:] != parent[order][:-1], True)]] = True
    heavy &= parent >= 0
    top = np.where(heavy, parent, np.arange(len(parent)))
    while not np.array_equal(up := top[top], top):
        top = up
    starts, halves = [], []
    leaf = np.arange(n)
    here = leaf + nodes
    while len(leaf):
        here = parent[top[here]]
        leaf, here = leaf[here >= 0], here[here >= 0]
        q, i = depth[here], suffixes[leaf]
        for a, b in ((i, i + q), (i - q, i)):
            other = np.where(a == i, b, a)
            ok = (other >= 0) & (other < n)
            ok[ok] = (left[here[ok]] <= rank[other[ok]]) & (rank[other[ok]] <= right[here[ok]])
            ok[ok] = s[b[ok]] != s[b[ok] + q[ok]]
            starts.append(a[ok])
            halves.append(q[ok])
    return np.concatenate(starts), np.concatenate(halves)


def _tree_runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of the runs of a sequence whose parts end with symbols that occur once."""
    levels = _levels(s)
    at, q = _tandem(s, levels)
    end = at + 2 * q
    at = at - _agree(levels, at, at + q, back=True)
    long = end - at >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    at, end, q = at[long], end[long], q[long]
    order = np.lexsort((q, end, at))
    at, end, q = at[order], end[order], q[order]
    new = np.append(True, (at[1:] != at[:-1]) | (end[1:] != end[:-1]))[: len(at)]
    return at[new], end[new], q[new]


def find_runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs; ``ids`` are the words of texts in a row, text k's are ``first[k]`` to ``first[k + 1]``."""
    a, b = _candidates(ids, first)
    made = [np.zeros((3, 0), np.int64)]
    group = (np.cumsum(b - a + 1) - (b - a + 1)) // TREE_WORDS if len(a) else a
    for k in np.unique(group):
        x, y = a[group == k], b[group == k]
        size = y - x + 1
        shift = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(shift - x, size)
        s = ids[np.minimum(place, len(ids) - 1)]
        s[shift + size - 1] = ids.max() + 1 + np.arange(len(x))
        at, end, q = _tree_runs(s)
        back = (x - shift)[np.searchsorted(shift, at, "right") - 1]
        made.append(np.stack([at + back, end + back, q]))
    return tuple(np.concatenate(made, axis=1))


def stretched(words: list, doc_id) -> list:
    """The words with those of some documents' ends repeated, by the checksum of the doc_id; a null doc_id changes nothing."""
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if not n or h is None or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _scan(batches, key: str, change: bool):
    schema = None
    for piece in pieces(batches):
        if schema is None:
            schema = pa.schema([piece.schema.field(key), *(pa.field(n, pa.string() if n.endswith("256") else pa.int64()) for n in _NAMES)])
        buf, offs = column_bytes(piece.column("text"))
        data = buf.tobytes()
        keys = piece.column(key).to_pylist()
        number: dict = defaultdict()
        number.default_factory = number.__len__
        texts, ids = [], []
        for k, i in enumerate(keys):
            words = data[offs[k] : offs[k + 1]].split()  # of bytes: at space and 9 to 13
            texts.append(stretched(words, i) if change else words)
            ids.append(np.fromiter(map(number.__getitem__, texts[-1]), np.int64, len(words)))
        first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        at, end, q = find_runs(np.concatenate(ids), first)
        order = np.lexsort((q, at))
        at, end, q = at[order], end[order], q[order]
        bounds = np.searchsorted(at, first)
        out = {n: [] for n in _NAMES}
        for k, words in enumerate(texts):
            mine = slice(bounds[k], bounds[k + 1])
            runs = list(zip((at[mine] - first[k]).tolist(), (end[mine] - at[mine]).tolist(), q[mine].tolist(), strict=True))
            best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
            dropped = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                dropped[start + period] += 1
                dropped[start + length] -= 1
            kept = np.cumsum(dropped)[:-1] == 0
            made = (
                len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
                hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()).hexdigest(),
                hashlib.sha256(b" ".join(compress(words, kept) if runs else words)).hexdigest(), int(len(words) - kept.sum()),
            )
            for name, value in zip(_NAMES, made, strict=True):
                out[name].append(value)
        yield batch_of(schema, **{key: piece.column(key)}, **out)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def word_runs(docs: DataFrame, key: str = "doc_id", stretch: bool = False) -> DataFrame:
    """Per row of ``docs``: its key, number of runs, the run of the greatest exponent, digests of all runs and of the text without the repetitions.

    Words are maximal strings of other bytes than space and 9 to 13.  A run is
    a stretch of words with smallest period q, of at least six words and four
    periods, that neither neighbour extends.  Words beyond the first q of some
    run are dropped (``n_dropped`` of them).  ``stretch`` repeats the ends of
    some texts first, as ``stretched`` says.

    Null and empty texts and texts of white space have no words and no runs.
    Equal rows give equal rows, an empty table an empty one, a null key stays
    null, other columns are not read.  Only narrow stages: a text is handled by
    one task, whose memory depends on the longest text.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`"), F.col("`text`"))
    return rows.mapInArrow(lambda batches: _scan(batches, key, stretch), f"`{key}` {kind}, {SCHEMA}")

"""Vectorised byte, word and shingle helpers used inside Arrow map functions.

Texts are handled as whole UTF-8 byte strings.  A record batch is cut into
pieces of about a megabyte so that memory depends on the longest single text
and not on the number of rows in a batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; kept for the worker's next piece."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE_BYTES + 1)
        for name, step in (("up", BASE), ("down", BASE_INVERSE)):
            column = np.full(size, step, dtype=np.uint64)
            column[0] = 1
            _powers[name] = np.multiply.accumulate(column)
        if size > 16 * PIECE_BYTES:  # one very long text must not stay in memory
            up, down = _powers.pop("up"), _powers.pop("down")
            return up[:n], down[:n]
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits (a bijection)."""
    out = h >> np.uint64(30)
    out ^= h
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


#: Caches that a worker process keeps between tasks of one operator; any other operator's scan empties them.
worker_caches: list[dict] = []


def trim() -> None:
    """Give freed memory back to the system, so that a worker that is used again, or the driver, stays small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries without it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches, column: str = "text", limit: int = PIECE_BYTES, keep_caches: bool = False):
    """Slices of record batches of at most ``limit`` text bytes, or of one row."""
    if not keep_caches:
        for cache in worker_caches:
            cache.clear()
    trim()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = column_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def prefix_hash(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers: ``(p[e] - p[s]) * inv[s]`` is the hash of bytes s to e.

    Regular byte patterns can be made to collide modulo 2**64, so this hash
    only brings candidates together; bytes or a digest decide.
    """
    up, down = powers(len(buf) + 1)
    p = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buf] * up[:-1], out=p[1:])
    return p, down


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed one by one.
_LONG = 2048


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes a step, mixed after each, so that no regular pattern of bytes cancels out."""
    size = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) + np.uint64(BASE))
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = starts[live], size[live]
    value = h[live]
    while len(live):
        value = mix(value ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        end = left <= 8
        h[live[end]] = value[end]
        more = ~end
        live, at, left, value = live[more], at[more] + 8, left[more] - 8, value[more]
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def word_spans(buf: np.ndarray, offs: np.ndarray):
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the first word of each text."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = True):
    """The words of each text: (hashes, starts, ends, first word of each text)."""
    starts, ends, first = word_spans(buf, offs)
    return span_hash(LOWER[buf] if lower else buf, starts, ends), starts, ends, first


def shingles(word_hashes: np.ndarray, first: np.ndarray, size: int = 5):
    """Shingle hashes of every text in order, and the first shingle of each text.

    A text of fewer than ``size`` words, but some, has the whole sequence as its only shingle.
    """
    count = np.diff(first)
    n = len(word_hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    factor = [np.uint64(pow(0xD1342543DE82EF95, j + 1, 1 << 64)) for j in range(size)]
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        full += word_hashes[j : j + len(full)] * factor[j]
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(made, out=out_first[1:])
    owner = np.repeat(np.arange(len(count)), made)
    at = first[owner] + np.arange(out_first[-1]) - out_first[owner]
    out = full[np.minimum(at, max(0, len(full) - 1))] if len(full) else np.zeros(len(at), np.uint64)
    for d in np.flatnonzero((count > 0) & (count < size)):
        own = word_hashes[first[d] : first[d + 1]]
        value = np.uint64(len(own))
        with np.errstate(over="ignore"):
            for j, w in enumerate(own):
                value = value + w * factor[j]
        out[out_first[d]] = value
    return mix(out), out_first


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    made = [columns[f.name] for f in schema]
    made = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(made, schema, strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


_PLACES = np.uint64(0xD6E8FEB86659FD93)


def sequence_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each run ``h[at[i]:at[i + 1]]`` of hashes by value and place; the runs cover ``h``."""
    count = np.diff(at)
    place = np.arange(len(h)) - np.repeat(at[:-1], count)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + place.astype(np.uint64) * _PLACES), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + count.astype(np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

"""Edits between one text and thousands of others at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Rows of the table in a word of a mask, and columns after which it is looked up which words are still wanted.
ROWS, EVERY = 16, 8
#: Up to so many texts four, and two, words of a mask make one: fewer steps, where a step costs more than its numbers.
FOUR, TWO = 3000, 9000
#: Bytes of masks that are kept.
KEPT = 1 << 27


class Texts:
    """Texts side by side: each is a column of 16-bit words, with a mask for each character."""

    def __init__(self, points: np.ndarray, size: np.ndarray):
        """``points``: the texts' code points, one text after another; ``size``: the length of each."""
        self.size, self.n = size.astype(np.int64), len(size)
        self.words = 4 * max(1, -(-int(self.size.max(initial=0)) // (4 * ROWS)))
        row = (np.arange(len(points)) - np.repeat(np.cumsum(self.size) - self.size, self.size)).astype(np.uint32)
        place, bit = row // ROWS * np.uint32(self.n) + np.repeat(np.arange(self.n, dtype=np.uint32), self.size), np.uint16(1) << (row % ROWS).astype(np.uint16)
        if len(points):  # small numbers are sorted by their digits
            points = points.astype(np.min_scalar_type(points.max()))
        order = np.argsort(points, kind="stable")
        self.place, self.bit = place[order], bit[order]
        self.points, first = np.unique(points[order], return_index=True)
        self.bounds = np.append(first, len(points))
        self.masks: dict[int, np.ndarray] = {}
        self.counted: dict[int, np.ndarray] = {}

    def _of(self, point: int) -> slice | None:
        k = int(np.searchsorted(self.points, point))
        return slice(self.bounds[k], self.bounds[k + 1]) if k < len(self.points) and self.points[k] == point else None

    def mask(self, point: int) -> np.ndarray | None:
        """Where each text has this character; None if no text has it."""
        if point not in self.masks and (own := self._of(point)) is not None:
            if (len(self.masks) + 1) * self.words * self.n * 2 > KEPT:
                self.masks.clear()
            bits = np.bincount(self.place[own], self.bit[own], self.words * self.n)  # a place has each bit once, so adding is or
            self.masks[point] = bits.astype(np.uint16).reshape(self.words, self.n)
        return self.masks.get(point)

    def count(self, point: int) -> np.ndarray | None:
        """How often each text has this character."""
        if point not in self.counted and (own := self._of(point)) is not None:
            if (len(self.counted) + 1) * self.n * 4 > KEPT:
                self.counted.clear()
            self.counted[point] = np.bincount(self.place[own] % self.n, minlength=self.n).astype(np.int32)
        return self.counted.get(point)

    def shared(self, points: np.ndarray) -> np.ndarray:
        """Characters that each text has in common with another, without their places."""
        out = np.zeros(self.n, np.int32)
        for p, n in zip(*np.unique(points, return_counts=True), strict=True):
            if (c := self.count(int(p))) is not None:
                out += np.minimum(c, np.int32(n))
        return out


def edits(points: np.ndarray, texts: Texts, some: np.ndarray | slice, most: np.ndarray) -> np.ndarray:
    """Edits between a text and ``some`` of ``texts``; where they are more than ``most``, any number above it.

    Bit vectors (Myers; Hyyro): a step takes one column of 16 to 64 rows of all tables.  Every
    ``EVERY`` columns, the words through which no table can stay within its ``most`` are
    left out (Ukkonen): what comes in from there is taken as too high, so numbers up to
    ``most`` are exact.
    """
    m, size = len(points), texts.size[some]
    if not m or not len(size):
        return size.copy()
    wide = np.int16 if max(m, int(size.max())) < 4000 else np.int32  # of sums of two heights of up to m + size
    n, most_, far = len(size), np.minimum(most, np.maximum(size, m)).astype(wide), (size - m).astype(wide)
    out = np.maximum(size, m) + 1 + most  # more than most
    word, joined = (np.uint64, 4) if n <= FOUR else (np.uint32, 2) if n <= TWO else (np.uint16, 1)
    rows = joined * ROWS
    words, all_, last = max(1, -(-int(size.max()) // rows)), ~word(0), word(rows - 1)

    def mask(point: int) -> np.ndarray | None:
        x = texts.mask(point)
        if x is None:
            return None
        x = x[: words * joined]
        x = x[:, some] if isinstance(some, slice) else x.take(some, axis=1)
        return x if joined == 1 else np.ascontiguousarray(np.ascontiguousarray(x.T).view(word).T)

    masks = {p: mask(p) for p in np.unique(points).tolist()}
    none = np.zeros(n, word)
    more, less = np.full((words, n), all_), np.zeros((words, n), word)
    e, a, x, h, *carry = (np.empty(n, word) for _ in range(8))
    first, end = 0, 1  # the words that are wanted
    top = np.zeros(n, wide)  # the number above the first word, less the columns so far
    bits = np.empty(n, np.uint8)

    def heights(j: int) -> list[np.ndarray]:
        """The numbers above each wanted word and below the last one."""
        own = [top + wide(j)]
        for w in range(first, end):
            below = own[-1] + np.bitwise_count(more[w], out=bits)
            below -= np.bitwise_count(less[w], out=bits)
            own.append(below)
        return own

    def dead(above: np.ndarray, below: np.ndarray, w: int, j: int) -> bool:
        """Whether no table can stay within its most through this word."""
        least = above + below
        least -= wide(rows)
        least >>= 1
        # rows from w * rows to (w + 1) * rows, the last of the word above too; what is left to its end: |size - row - (m - j)|
        least += np.maximum(np.maximum(far - wide((w + 1) * rows - j), wide(w * rows - j) - far), wide(0))
        return not (least <= most_).any()

    for j in range(m):
        if j % EVERY == 0:
            own = heights(j)
            while first < end and dead(own[0], own[1], first, j):
                # paths may still enter the next word from here on, but only through cells that are dead now
                if first + 1 == end:
                    break
                top = own[1] - wide(j)
                first, own = first + 1, own[1:]
            last_dead = dead(own[-2], own[-1], end - 1, j)
            while end - first > 1 and last_dead:
                reach = own[-2] + np.abs(far - wide((end - 1) * rows - j))
                if (reach <= most_ + wide(2 * EVERY)).any():
                    break
                own.pop()
                end -= 1
                last_dead = dead(own[-2], own[-1], end - 1, j)
            while end < words:
                reach = own[-1] + np.abs(far - wide(end * rows - j))
                if not (reach <= most_ + wide(2 * EVERY)).any():
                    if end - first == 1 and last_dead:
                        return out
                    break
                more[end], less[end] = all_, 0
                own.append(own[-1] + wide(rows))
                end, last_dead = end + 1, False
            else:
                if end - first == 1 and last_dead:
                    return out
        eq = masks[int(points[j])]
        up, down, next_up, next_down = carry
        for w in range(first, end):
            pv, mv, c = more[w], less[w], none if eq is None else eq[w]
            if w > first:
                c = np.bitwise_or(c, down, out=e)
            np.bitwise_and(c, pv, out=a)
            np.add(a, pv, out=a)
            np.bitwise_xor(a, pv, out=a)
            np.bitwise_or(a, c, out=a)
            np.bitwise_or(a, mv, out=a)  # the number is that of the cell up left
            np.bitwise_or(a, pv, out=x)
            np.subtract(x, mv, out=x)  # not one more than to the left
            np.bitwise_and(a, pv, out=h)  # one less than to the left
            if w < end - 1:
                np.right_shift(x, last, out=next_up)
                np.right_shift(h, last, out=next_down)
            np.add(x, x, out=x)
            np.add(h, h, out=h)
            if w > first:
                np.add(x, up, out=x)
                np.add(h, down, out=h)
            np.bitwise_and(a, x, out=pv)
            np.bitwise_xor(a, pv, out=mv)
            np.subtract(x, pv, out=x)
            np.add(x, h, out=pv)
            up, down, next_up, next_down = next_up, next_down, up, down
    own, ends = heights(m), np.maximum(size - 1, 0) // rows
    for w in range(first, end):
        here = np.flatnonzero(ends == w)
        if len(here):
            keep = np.where(size[here] > w * rows, all_ >> (w * rows + rows - np.maximum(size[here], w * rows + 1)).astype(word), word(0))
            found = own[w - first][here].astype(np.int64) + np.bitwise_count(more[w, here] & keep) - np.bitwise_count(less[w, here] & keep)
            out[here] = np.where(found <= most[here], found, out[here])
    return out

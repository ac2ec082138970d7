"""Runs of words against a search of every period, and the query's columns against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import repeats

from .conftest import prose


def brute(words):
    """Every stretch of words equal q places on, for every q; the smallest q of a stretch."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain(doc_id, text, stretch):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if stretch and words and h is not None and h % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, kept, len(gone))


def periodic(r, letters):
    words = [r.randrange(letters) for _ in range(r.randint(0, 60))]
    for _ in range(r.randint(0, 2)):
        unit = [r.randrange(letters) for _ in range(r.randint(1, 7))]
        words[r.randint(0, len(words)) : 0] = (unit * r.randint(2, 12))[: r.randint(1, 70)]
    return words


def test_runs_of_random_words():
    r = random.Random(11)
    for _ in range(1500):
        docs = [periodic(r, r.randint(1, 4)) for _ in range(r.randint(0, 4))]
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        at, end, q = repeats.find_runs(np.array([w for d in docs for w in d], np.int64), first)
        want = sorted((f + a, f + a + n, p) for d, f in zip(docs, first.tolist(), strict=False) for a, n, p in brute(d))
        assert sorted(zip(at.tolist(), end.tolist(), q.tolist(), strict=True)) == want


def test_fibonacci_words_and_powers():
    """Sequences with as many runs as there can be, and the deepest trees."""
    a, b = [0], [0, 1]
    for _ in range(14):
        a, b = b, b + a
    for words in (b[:900], b * 2, [0] * 3000, [0, 1] * 1500, ([0] * 7 + [1]) * 200):
        words = words[:1600]
        got = repeats.find_runs(np.array(words, np.int64), np.array([0, len(words)]))
        assert sorted((x, y - x, q) for x, y, q in zip(*(c.tolist() for c in got), strict=True)) == brute(words)


@pytest.mark.parametrize("words", [1, 40])
def test_trees_of_some_stretches_each(monkeypatch, words):
    monkeypatch.setattr(repeats, "TREE_WORDS", words)
    test_fibonacci_words_and_powers()
    test_runs_of_random_words()


@pytest.mark.parametrize("stretch", [False, True])
def test_rows(docs_of, odd, none, stretch):
    r = random.Random(2)
    rows = [(i, " ".join("wxyz"[w] + "é" * (w % 2) for w in periodic(r, 4)).replace(" ", r.choice([" ", "\n", " \t\r\n", "\xa0 "]))) for i in range(300)]
    rows += [(300 + i, prose(i, r.randint(0, 400))) for i in range(60)]
    rows += [(1000, "  a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca \x00"), (None, "x " * 9)]
    docs = docs_of(rows).unionByName(odd)
    every = [(d.doc_id, d.text) for d in docs.collect()]
    out = repeats.word_runs(docs, stretch=stretch)
    assert out.columns == ["doc_id", *repeats._NAMES]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(x) for x in out.collect()), key=key) == sorted((plain(i, t, stretch) for i, t in every), key=key)
    assert sum(x[1] > 0 for x in map(tuple, out.collect())) > 100
    assert repeats.word_runs(none).collect() == []


def test_a_long_text_of_one_word(docs_of):
    (row,) = repeats.word_runs(docs_of([(5, "ab " * 200_000)])).collect()
    assert (row.n_runs, row.start, row.length, row.period, row.n_dropped) == (1, 0, 200_000, 1, 199_999)
    assert row.collapsed_sha256 == hashlib.sha256(b"ab").hexdigest()

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import suffixes

from .conftest import prose


def brute(texts, length):
    seen = Counter(x[j : j + length] for x in texts for j in range(len(x) - length + 1))
    out = []
    for x in texts:
        gone = bytearray(len(x))
        for j in range(len(x) - length + 1):
            if seen[x[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        out.append((sum(gone), bytes(b for b, g in zip(x, gone) if not g), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))))
    return out


def run(df, **kw):
    return suffixes.remove_repeats(df, **kw)


def check(docs_of, texts, **kw):
    rows = run(docs_of(list(enumerate(texts))), **kw).orderBy("doc_id").collect()
    want = brute([(t or "").encode() for t in texts], kw["length"])
    assert [(r.n_removed, bytes(r.kept), r.n_spans) for r in rows] == want


def test_against_brute_force(docs_of):
    r = random.Random(5)
    shared = [prose(50 + k, 40) for k in range(4)]
    texts = []
    for k in range(30):
        parts = [prose(100 + k, r.randint(1, 40)), r.choice(shared), prose(200 + k, 10), r.choice(shared)[r.randint(0, 40) :]]
        t = " ".join(parts)
        i = r.randrange(len(t))
        texts.append(t[:i] + r.choice(["", "é", "Z"]) + t[i:])
    texts += ["a" * 300, "ab" * 120, "ab" * 90 + "c", None, "", texts[0], "日本語" * 40]
    check(docs_of, texts, length=80, gram=24, cell=16)


def test_edges_of_matches(docs_of):
    x = prose(7, 60).encode()[:200].decode()
    check(docs_of, ["p" + x[:80] + "q", "r" + x[:80] + "s", x[1:80] + "!!", "t" + x[:81]], length=80, gram=24, cell=16)


def test_repeated_windows_sorts_by_bytes():
    buf = np.frombuffer(b"abcdefghijabcdefghijXbcdefghij", np.uint8)
    starts = np.array([0, 10, 20, 1, 11])
    got = suffixes.repeated_windows(buf, starts, 9, np.zeros(5, np.int64))
    assert got.tolist() == [True, True, False, True, True]
    assert suffixes.repeated_windows(buf, starts, 9, np.arange(5)).tolist() == [False] * 5


def test_odd_rows(odd, none):
    out = run(odd)
    assert out.count() == odd.count() and out.where("kept is null").count() == 0
    same = {r.doc_id: r.n_removed for r in out.where("doc_id in (4, 5)").collect()}
    assert same[4] == same[5] > 0
    assert out.where("doc_id = 7").first().n_removed == 5000
    assert out.where("doc_id in (1, 2)").agg(F.sum("n_bytes")).first()[0] == 0
    assert run(none).count() == 0


def test_regular_patterns_are_told_apart(docs_of):
    """Thue-Morse strings and their complements collide under any polynomial hash modulo 2**64."""
    bits = [bin(k).count("1") & 1 for k in range(256)]
    one, two = "".join("Y-"[b] for b in bits), "".join("-Y"[b] for b in bits)
    token = prose(77, 60)[:128]
    check(docs_of, [one + token + two, two + token + one], length=400, gram=128, cell=64)


def test_copies_of_one_text_are_dealt_out(docs_of, monkeypatch):
    from millrace.llm import _store

    monkeypatch.setattr(_store, "HOT_KEYS", 1)
    x = prose(9, 80)
    rows = run(docs_of([(k % 700, x) for k in range(2500)] + [(9000, prose(10, 90))]), length=80, gram=24, cell=16).groupBy("n_removed").count().collect()
    assert {(r.n_removed, r["count"]) for r in rows} == {(len(x.encode()), 2500), (0, 1)}

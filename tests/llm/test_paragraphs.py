import itertools
import random

import numpy as np
import pytest

from millrace.llm import candidates, paragraphs

from .conftest import prose
from .test_jaccard import edited, sets


def brute(texts, min_words):
    items = [(d, p, x) for d, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if len(x.split()) >= min_words]
    s = sets([x for *_, x in items])
    group = list(range(len(items)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a, b in itertools.combinations(range(len(items)), 2):
        both = len(s[a] & s[b])
        if 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    out = [[] for _ in texts]
    for i, (d, p, _) in enumerate(items):
        if find(i) != i:
            out[d].append(p)
    return out


def test_bands_are_tuned():
    assert paragraphs.tuned_bands(80, 0.999) == 14
    assert 1 - (1 - 0.8**4) ** paragraphs.tuned_bands(80, 0.999) >= 0.999 > 1 - (1 - 0.8**4) ** 13


@pytest.mark.parametrize("often", [64, 2])
def test_against_brute_force(docs_of, monkeypatch, often):
    monkeypatch.setattr(candidates, "OFTEN", often)
    monkeypatch.setattr(candidates, "SAMPLED", 64 if often > 2 else 1)
    r = random.Random(8)
    base = [prose(k, r.choice([20, 25, 40, 90])) for k in range(8)]
    pick = lambda: r.choice([lambda: r.choice(base), lambda: edited(r.choice(base), r, 1), lambda: edited(r.choice(base), r, 3), lambda: prose(r.randrange(10**6), 25), lambda: "short one"])()
    texts = ["\n".join(pick() for _ in range(r.randint(1, 6))) for _ in range(50)]
    got = paragraphs.dedup_paragraphs(docs_of(list(enumerate(texts))), passages=False).orderBy("doc_id").collect()
    want = brute(texts, paragraphs.MIN_WORDS)
    assert [list(r.removed) for r in got] == want
    for row, t, gone in zip(got, texts, want, strict=True):
        assert bytes(row.kept).decode() == "".join(x for k, x in enumerate(t.splitlines(keepends=True)) if k not in gone)
        assert row.n_bytes - row.n_removed == len(row.kept)


def test_passages_inside_longer_paragraphs(docs_of):
    shared = [prose(500 + k, (51, 60, 120)[k]) for k in range(3)]
    texts = [f"{prose(k, 30 + k)} {shared[k % 3]} {prose(900 + k, 40)}" for k in range(12)] + [prose(2000 + k, 200) for k in range(5)]
    texts += [f"{prose(3000 + k, 60)} {prose(4000, 45)} {prose(5000 + k, 60)}" for k in range(4)]  # 45 words are no passage
    got = paragraphs.dedup_paragraphs(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert all(r.n_removed == 0 for r in got[:3] + got[12:])
    for k, r in enumerate(got[3:12], 3):
        start = len(texts[k].partition(shared[k % 3])[0])
        assert list(r.starts) == [start] and list(r.ends) == [start + len(shared[k % 3])]


def test_passages_against_brute_force(docs_of):
    """Every removed word is in a run of 50 words that an earlier place holds, and nearly all such passages of enough words go as a whole."""
    r = random.Random(5)
    bank = [prose(700 + k, 130).split() for k in range(4)]
    texts = []
    for k in range(30):
        parts = [prose(10_000 + k, r.randint(5, 40)).split()]
        for _ in range(r.randint(0, 3)):
            own = r.choice(bank)
            s = r.randrange(0, 60)
            parts += [own[s : s + r.randint(20, 110)], prose(r.randrange(10**6), r.randint(1, 30)).split()]
        texts.append(" ".join(w for p in parts for w in p))
    got = paragraphs.dedup_paragraphs(docs_of(list(enumerate(texts))), min_words=10_000).orderBy("doc_id").collect()
    words = [t.split() for t in texts]
    seen, left, whole = set(), 0, 0
    for k, w in enumerate(words):
        must = set()
        for i in range(len(w) - 49):
            g = tuple(w[i : i + 50])
            if g in seen or any(tuple(w[j : j + 50]) == g for j in range(i)):
                must.update(range(i, i + 50))
        gone, at = set(), 0
        for i, x in enumerate(w):
            if any(s <= at < e for s, e in zip(got[k].starts, got[k].ends)):
                gone.add(i)
            at += len(x) + 1
        assert gone <= must
        left, whole = left + len(must - gone), whole + len(must)
        seen |= {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
    assert whole > 500 and left <= 0.1 * whole  # a run first found elsewhere with other words around it may keep the passage's ends


def test_matches_of_different_sources_are_no_passage(docs_of):
    """Two repeated runs of 45 words side by side, each from another text, are no repeated passage; one of 55 beside one of 45 is."""
    texts = []
    for k in range(20):
        p, q, r = prose(100 + k, 45), prose(200 + k, 45), prose(300 + k, 55)
        texts += [f"{prose(400 + k, 30)} {p} {prose(500 + k, 30)}", f"{prose(600 + k, 30)} {q} {prose(700 + k, 30)}", f"{prose(800 + k, 30)} {r} {prose(900 + k, 30)}"]
        texts += [f"{prose(1000 + k, 30)} {p} {q} {prose(1100 + k, 30)}", f"{prose(1200 + k, 30)} {p} {r} {q} {prose(1300 + k, 30)}"]
    got = paragraphs.dedup_paragraphs(docs_of(list(enumerate(texts))), min_words=10_000).orderBy("doc_id").collect()
    for i, (row, text) in enumerate(zip(got, texts, strict=True)):
        r = prose(300 + i // 5, 55)
        start = text.find(r) if i % 5 == 4 else -1
        assert (list(row.starts), list(row.ends)) == (([start], [start + len(r)]) if start >= 0 else ([], [])), i


def test_selected_runs_are_in_every_common_passage():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (50, 57, 200):
        shared = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), shared, rng.integers(0, 1 << 63, 30, dtype=np.uint64)]) for n in (17, 41))
        inside = lambda x, n: {int(c) - n for c in paragraphs.selected_grams(x, np.array([0, len(x)]), 26, 50)[1] if n <= c <= n + size - 26}
        both = sorted(inside(a, 17) & inside(b, 41))
        assert both and both[0] <= 24 and size - 26 - both[-1] <= 24 and all(y - x <= 25 for x, y in zip(both, both[1:]))
    assert len(paragraphs.selected_grams(shared[:10], np.array([0, 10]), 26, 50)[0]) == 0


def test_odd_rows(odd, none):
    out = paragraphs.dedup_paragraphs(odd)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count()
    assert bytes(rows[1].kept) == b"" == bytes(rows[2].kept) and rows[2].n_paragraphs == 0 and list(rows[5].removed) == [0] and bytes(rows[5].kept) == b""
    assert list(rows[4].removed) == [] and rows[4].n_removed == 0 and rows[6].n_paragraphs == 40 and rows[6].n_removed == 0
    assert paragraphs.dedup_paragraphs(none).count() == 0


def test_runs_are_named_twice_only_where_selected(monkeypatch):
    """Second identities are made for selected runs only, and are those of the runs' words in their order."""
    hashes = np.random.default_rng(3).integers(0, 1 << 63, 40_000, dtype=np.uint64)
    mix, seen = paragraphs._text.mix, []
    monkeypatch.setattr(paragraphs._text, "mix", lambda h: seen.append(len(h)) or mix(h))
    _, at, one, two = paragraphs.selected_grams(hashes, np.array([0, 15_000, 40_000]), 26, 50)
    assert sum(seen) < 35 * len(hashes)
    step = [np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)) for j in range(26)]
    for k in (0, len(at) // 2, len(at) - 1):
        run = hashes[at[k] : at[k] + 26]
        assert one[k] == mix(np.sum(mix(run + step), keepdims=True))[0] and two[k] == mix(np.sum(mix(run ^ step), keepdims=True))[0]

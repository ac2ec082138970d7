import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ppm

from .conftest import prose


class Plain:
    """The same model with dictionaries: method C, symbol exclusion, 256 symbols."""

    def __init__(self, texts, order):
        self.order, self.count = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            s = bytes([255]) * order + t.encode() + bytes([255])
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.count[k][s[i - k : i]][s[i]] += 1

    def p(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            c = self.count[k].get(context[len(context) - k :])
            if not c:
                continue
            left = {s: n for s, n in c.items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out * left[symbol] / total
            out *= len(left) / total
            excluded |= left.keys()
        return out / (256 - len(excluded))

    def score(self, text):
        s = bytes([255]) * self.order + text.encode() + bytes([255])
        return sum(math.log10(self.p(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


@pytest.fixture(scope="module")
def texts():
    return [prose(k, 12) + ("é" if k % 5 == 0 else "") for k in range(60)] + ["", "a"]


@pytest.mark.parametrize("order", [1, 3, 4])
def test_model_against_dictionaries(docs_of, texts, order):
    train, test = texts[::2], [*texts[1::2], "ZZZ", "é", "日本"]
    trie = ppm.train(docs_of(list(enumerate(train))), order)
    plain = Plain(train, order)
    for t in test:
        b = t.encode()
        g, at = ppm.grams(np.frombuffer(b, np.uint8), np.array([0, len(b)]), order)
        assert len(g) == len(b) + 1 and at.tolist() == [0]
        assert trie.log10p(g).sum() == pytest.approx(plain.score(t))


def test_probabilities_sum_to_one(docs_of, texts):
    trie = ppm.train(docs_of(list(enumerate(texts))), 3)
    for context in (b"\xff\xff\xff", b"the", b"\xff\xffa", b"zzz", b"a e"):
        g = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10.0 ** trie.log10p(g)).sum() == pytest.approx(1)


def test_bounded_trie_still_sums_to_one(docs_of, texts):
    trie = ppm.train(docs_of(list(enumerate(texts))), 3, entries=150)
    assert all(len(g) <= 150 for g in trie.gram)
    g = np.array([int.from_bytes(b"e a" + bytes([s]), "big") for s in range(256)], np.uint64)
    assert (10.0 ** trie.log10p(g)).sum() == pytest.approx(1)


def test_table():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 5000, dtype=np.uint64))
    table = ppm.Table(keys[::2], np.arange(len(keys[::2]), dtype=float))
    values, found = table.get(keys)
    assert found.tolist() == [i % 2 == 0 for i in range(len(keys))] and values[::2].tolist() == list(range(len(keys[::2])))
    assert not ppm.Table(keys[:0], np.zeros(0)).get(keys)[1].any()


@pytest.mark.parametrize("common", [1 << 20, 0, 5])
def test_score_against_plain_counts(docs_of, texts, common):
    held = F.col("doc_id") % 3 == 1
    every = [*texts, None, "The THE the"]
    rows = ppm.score(docs_of(list(enumerate(every))), held, order=3, common_words=common).orderBy("doc_id").collect()
    low = [(t or "").lower() if (t or "").isascii() else (t or "") for t in every]
    train = [i for i in range(len(every)) if i % 3 != 1]
    c = Counter(w for i in train for w in [*low[i].split(), None])
    n, v = sum(c.values()), len(c)
    plain = Plain([every[i] or "" for i in train], 3)
    for i, r in enumerate(rows):
        tokens = [*low[i].split(), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 3 == 1, len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(plain.score(every[i] or ""))


@pytest.mark.parametrize("entries, order", [(150, 3), (1, 3), (400, 4), (30, 1)])
def test_scores_do_not_depend_on_the_bound_of_the_trie(docs_of, texts, entries, order):
    every = [*texts, "ZZZ", "日本", None]
    rows = ppm.score(docs_of(list(enumerate(every))), F.col("doc_id") % 3 == 1, order=order, entries=entries).orderBy("doc_id").collect()
    plain = Plain([every[i] or "" for i in range(len(every)) if i % 3 != 1], order)
    assert [r.score for r in rows] == pytest.approx([plain.score(t or "") for t in every])


def test_odd_rows(odd, none):
    out = ppm.score(odd, F.coalesce(F.col("doc_id") == 4, F.lit(False)))
    assert out.count() == odd.count() and out.where("score is null or base_score is null").count() == 0
    alone = ppm.score(odd, F.lit(True)).where("doc_id = 2").first()
    assert alone.score == pytest.approx(-math.log10(256)) and alone.n_known == 0 and alone.train_tokens == 0
    assert ppm.score(none, F.lit(False)).count() == 0

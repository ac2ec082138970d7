"""Token counts against the libraries' own, on texts cut into chunks of any size."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from millrace.llm import token_counts  # noqa: E402

from .conftest import prose  # noqa: E402

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
PARTS = [*"abZ9'’.,;:!?<|>%_  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0é日ا٣²½", "᠎", "　", "﻿", "​", "é", "'s", "'ll", "'ve", "<|endoftext|>", "<|endof", "  ", "\n\n"]


def library(name):
    with open(public_tokenizers.path(name), "rb") as f:
        model = token_counts.load(f.read(), name)
    if name.endswith(".model"):
        return lambda t: len(model.encode(t))
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path(FILES[0]), "rb") as f:
        data = f.read()
    return token_counts.Counter(token_counts.load(data, FILES[0]), token_counts.proven(data, FILES[0]))


def mixed(r, n, some=None):
    return "".join(r.choice(some or PARTS) for _ in range(n))


def test_units_add_up(counter):
    want, r = library(FILES[0]), random.Random(1)
    for _ in range(4000):
        text = mixed(r, r.randint(0, 40))
        assert "".join(counter.units(text)) == text
        assert counter.counts([text]) == [want(text)], text


def test_places_are_true(counter, monkeypatch):
    """Text before and after each place of a whole text has the tokens of the text."""
    monkeypatch.setattr(token_counts, "LONG", 3)
    want, r = library(FILES[0]), random.Random(2)
    for _ in range(300):
        text = mixed(r, r.randint(1, 60))
        at, before, n = counter.places(text)
        assert n == want(text) and at[0] == 0
        for a, b in zip(at.tolist(), before.tolist(), strict=True):
            assert want(text[a:]) == n - b, (text, a)


def test_only_files_that_the_proof_covers():
    read = lambda name: open(public_tokenizers.path(name), "rb").read()
    assert [token_counts.proven(read(n), n) for n in FILES] == [["<|endoftext|>"], None, None]
    assert token_counts.proven(read(FILES[0]).replace(b'"add_prefix_space": false', b'"add_prefix_space": true').replace(b'"add_prefix_space":false', b'"add_prefix_space":true'), FILES[0]) is None


@pytest.mark.parametrize("name", FILES)
def test_table(docs_of, odd, none, name):
    r = random.Random(3)
    docs = docs_of([(k, mixed(r, r.randint(0, 300))) for k in range(80)]).unionByName(odd)
    want = library(name)
    key = lambda x: tuple((v is None, v) for v in x)
    out = token_counts.count_tokens(docs, public_tokenizers.path(name), limit=100)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    every = [(d.doc_id, d.text or "") for d in docs.collect()]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((i, len(t.encode()), n := want(t), n > 100) for i, t in every), key=key)
    assert token_counts.count_tokens(none, public_tokenizers.path(name)).collect() == []


@pytest.mark.parametrize("chunk, overlap", [(300, 90), (1000, 1), (4000, 500)])
def test_huge_texts(docs_of, chunk, overlap):
    """Words, marks without white space, specials at seams, copies, and words without end that need larger overlaps."""
    r = random.Random(4)
    texts = [prose(k, 600) for k in range(6)] + [mixed(r, 5000) for _ in range(6)] + [mixed(r, 6000, ["a", "b", "'s", "<|endoftext|>", "7", "."]) for _ in range(6)]
    texts += ["x" * 9000, "ab" * 2500 + "." + "c" * 3000, "日本語" * 2000, "<|endoftext|>" * 700, " " * 5000 + "a" + "\n" * 5000, "a b" + "é" * 7000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k % 4]) for k in range(40)] + [(None, texts[0]), (7, None), (8, "short")]
    want = library(FILES[0])
    out = token_counts.count_tokens(docs_of(rows), public_tokenizers.path(FILES[0]), chunk=chunk, overlap=overlap)
    known = {t: want(t) for t in {t or "" for _, t in rows}}
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((x.doc_id, x.n_tokens) for x in out.collect()), key=key) == sorted(((i, known[t or ""]) for i, t in rows), key=key)


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("select 1L as doc_id, cast(x'61FF62' as string) as text")
    (row,) = token_counts.count_tokens(docs, public_tokenizers.path(FILES[0])).collect()
    assert (row.n_bytes, row.n_tokens) == (3, library(FILES[0])("a�b"))

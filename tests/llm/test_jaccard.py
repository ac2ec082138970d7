import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import candidates, jaccard

from .conftest import prose


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(texts, percent=80):
    s = sets(texts)
    parent = list(range(len(s)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(s)), 2):
        both = len(s[a] & s[b])
        if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [(len(x), find(i)) for i, x in enumerate(s)]


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "zz" + str(r.randrange(1000))
    return " ".join(w)


def test_against_brute_force(docs_of):
    r = random.Random(11)
    texts = []
    for k, n in enumerate((6, 7, 9, 12, 15, 20, 30, 60, 150, 400)):
        base = prose(k, n)
        texts += [base, base] + [edited(base, r, max(1, n // x)) for x in (60, 45, 35, 25, 12) for _ in range(3)] + [base + " " + prose(90 + k, max(1, n // 8))]
    texts += ["", None, " \n ", "one two", "one two", "three"]
    got = jaccard.jaccard_components(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute(texts)


@pytest.mark.parametrize("size", [5, 8, 10, 17, 24, 40, 90, 300])
def test_linked_sets_share_a_signature(size):
    """The pigeonhole holds: any two sets at the threshold have a common signature, with common elements and without."""
    rng = np.random.default_rng(size)
    plan = jaccard.Plan(1000, 80)
    hits = 0
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        other = base[rng.permutation(len(base))[: len(base) - rng.integers(0, max(1, len(base) // 9) + 1)]]
        other = np.unique(np.concatenate([other, rng.integers(0, 1 << 63, rng.integers(0, max(1, len(base) // 9) + 1), dtype=np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 100 * both < 80 * (len(base) + len(other) - both) or np.array_equal(base, other):
            continue
        hits += 1
        common = np.union1d(base, other)[:: rng.integers(1, 4)]
        at = np.array([0, len(base), len(base) + len(other)])
        values = np.concatenate([base, other])
        pairs = [x for x in jaccard.set_signatures(plan, np.array([1, 2], np.uint64), values, at, np.isin(values, common))]
        mine = {i: set(np.concatenate([s[w == i] for s, w in pairs]).tolist()) for i in (1, 2)}
        assert mine[1] & mine[2]
    assert hits or size < 9


def test_sketch_never_hides_a_link():
    rng = np.random.default_rng(2)
    for n in (3, 40, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.95) + 1], rng.integers(0, 1 << 63, n // 20, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert 100 * both < 80 * (len(a) + len(b) - both) or candidates.may_link(candidates.sketch(a), candidates.sketch(b), len(a), len(b), 80)
    assert not candidates.may_link(candidates.sketch(a), candidates.sketch(rng.integers(0, 1 << 63, 700, dtype=np.uint64)), len(a), 700, 80)


@pytest.mark.parametrize("often", [64, 1])
def test_a_text_and_many_edits(docs_of, monkeypatch, often):
    """A group whose members link only through the text they come from; with signatures that a sample finds frequent, too."""
    monkeypatch.setattr(candidates, "OFTEN", often)
    monkeypatch.setattr(candidates, "SAMPLED", 64 if often > 1 else 2)
    r = random.Random(3)
    base = prose(70, 200)
    texts = [edited(base, r, 4) for _ in range(40)] + [base] + [edited(base, r, 7) for _ in range(20)]
    got = jaccard.jaccard_components(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute(texts)


def near_rows(sets, groups, comp, mine=None, blocks=(0, 0)):
    """One table as near_pairs() deals it out: the groups (lists of set numbers) with the sets' prefixes and sketches."""
    count = np.unique(np.concatenate(sets), return_counts=True)
    often = count[0][count[1] >= 3]
    rank = np.argsort(np.argsort(count[1][count[1] >= 3], kind="stable"), kind="stable").astype(np.uint64) + np.uint64(1)
    size, name = candidates.prefixes(pa.array([x.tobytes() for x in sets], pa.binary()), often, rank, 80)
    at = np.concatenate([[0], np.cumsum(size * 20 // 100 + 1)])
    rows = [(g, *blocks, mine[i] if mine else 0, i, comp[i], int(size[i]), name[at[i] : at[i + 1]].tobytes(), candidates.sketch(sets[i], 1)) for g, x in enumerate(groups) for i in x]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["sig", "lo", "hi", "mine", "id", "c", "size", "prefix", "sketch"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@pytest.mark.parametrize("compared", [8 << 20, 400])
@pytest.mark.parametrize("tried", [1 << 20, 7])
def test_no_linked_pair_of_a_group_is_left_out(monkeypatch, compared, tried):
    monkeypatch.setattr(candidates, "COMPARED", compared)
    monkeypatch.setattr(candidates, "TRIED", tried)
    rng = np.random.default_rng(4)
    values = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    base = [values(n) for n in (1, 4, 9, 60, 60, 300)]
    sets = []
    for k in range(150):
        x = base[k % 6]
        gone = rng.integers(0, len(x) // 6 + 1)
        sets.append(np.unique(np.concatenate([x[rng.permutation(len(x))[gone:]], values(rng.integers(0, len(x) // 8 + 1))])))
    groups = [list(range(150)), list(range(0, 150, 6)), list(range(3, 150, 6))]
    comp = [k // 12 for k in range(150)]
    mine = [k % 2 for k in range(150)]

    def linked(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)

    want = {(i, j) for i, j in itertools.combinations(range(150), 2) if comp[i] != comp[j] and linked(i, j)}
    got = {(r["a"], r["b"]) for b in candidates._candidates(near_rows(sets, groups, comp), 80, PAIR) for r in b.to_pylist()}
    assert len(want) > 300 and want <= got and all(comp[i] != comp[j] for i, j in got)
    across = {(r["a"], r["b"]) for b in candidates._candidates(near_rows(sets, groups, comp, mine, (0, 1)), 80, PAIR) for r in b.to_pylist()}
    assert {x for x in want if mine[x[0]] != mine[x[1]]} <= across and all(mine[i] != mine[j] for i, j in across)


def test_edits_of_one_text_are_not_compared_pair_by_pair(monkeypatch):
    """Copies with many edits each share a signature, but none is tried with all others."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(400)[60:]], rng.integers(0, 1 << 63, 60, dtype=np.uint64)])) for _ in range(400)]
    tried = []
    possible = candidates._possible
    monkeypatch.setattr(candidates, "_possible", lambda sketches, size, i, j, percent: tried.append(len(i)) or possible(sketches, size, i, j, percent))
    rows = near_rows(sets, [list(range(400))], list(range(400)))
    assert sum(b.num_rows for b in candidates._candidates(rows, 80, PAIR)) == 0 and sum(tried) < 400


def test_blocks_of_a_group(docs_of, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK_MEMBERS", 7)
    r = random.Random(9)
    base = prose(71, 120)
    texts = [edited(base, r, 4) for _ in range(30)]
    texts += [edited(t, r, 1) for t in texts[:15]]
    got = jaccard.jaccard_components(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute(texts)


def test_odd_rows(odd, none):
    out = jaccard.jaccard_components(odd)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert out.count() == odd.count() and rows[1] == (0, 1) and rows[2] == (0, 2) and rows[5][1] == rows[4][1] == 4 and rows[None][1] is None
    assert jaccard.jaccard_components(none).count() == 0


def test_one_of_each_group_stays(spark):
    """Null ids, repeated rows, another text of an id that goes, clashing columns."""
    a, b, c = prose(1, 90), prose(2, 90), prose(3, 90)
    rows = [(1, a), (2, a + " x"), (2, b), (2, b), (None, a), (None, c), (None, c + " y"), (3, None), (4, ""), (4, " "), (5, b)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id long, own_d long")
    out = jaccard.one_of_each(docs)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    either = c if (None, c) in got else c + " y"
    assert got == sorted([(1, a), (2, b), (2, b), (None, either), (3, None), (4, ""), (4, " ")], key=str)
    assert out.columns == docs.columns and jaccard.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("n", range(13))
def test_shingles_of_pieces_of_few_words(n, several):
    """A piece of any number of words, in one text or spread over several."""
    from millrace.llm import _text

    names = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cuts = sorted({0, *(([1, 3, 4] if several else [])), n} - {x for x in (1, 3, 4) if x > n})
    for size in (1, 2, 3, 5, 7):
        s, first = _text.shingles(names, np.array(cuts if n else [0, 0], np.int64), size)
        sets = [names[a:b] for a, b in zip(cuts, cuts[1:])] if n else [names]
        assert np.diff(first).tolist() == [max(len(x) - size + 1, min(len(x), 1)) for x in sets]
        for k, x in enumerate(sets):  # each text gives what it gives alone
            alone = _text.shingles(np.concatenate([x, np.arange(9, dtype=np.uint64)]), np.array([0, len(x), len(x) + 9]), size)
            assert s[first[k] : first[k + 1]].tolist() == alone[0][: alone[1][1]].tolist()


@pytest.mark.parametrize("texts", [["zz yy xx"], ["ab cd", "ef", None]])
def test_tables_of_few_words(docs_of, spark, texts):
    """Tables whose only batch holds very few words, here and in the other users of shingles."""
    import corpus_pipeline
    from millrace.llm import decontaminate, paragraphs

    docs = docs_of(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (int(bool(t)), texts.index(t) if t else i) for i, t in enumerate(texts)}
    items = spark.createDataFrame([(9, "zz yy xx")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated_pairs(docs, items).collect()] == [(i, 9, 1, 1) for i, t in enumerate(texts) if t == "zz yy xx"]
    assert paragraphs.dedup_paragraphs(docs).count() == len(texts)
    assert corpus_pipeline.ngram_jaccard(spark, docs, "").count() == len({t for t in texts if t}) + texts.count(None)

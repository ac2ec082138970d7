import random

from millrace.llm import lines

from .conftest import prose


def brute(texts, min_words):
    """Texts without later copies of runs of lines that reach min_words words; copies in the order of the list."""
    split = []
    for t in texts:
        x = t.split("\n") if t else []
        split.append(x[:-1] if x and x[-1] == "" else x)
    first, gone = {}, [set() for _ in texts]
    for d, x in enumerate(split):
        for p in range(len(x)):
            n, words = 0, 0
            while p + n < len(x) and words < min_words:
                words += len(x[p + n].split())
                n += 1
            if words < min_words:
                continue
            if first.setdefault(tuple(x[p : p + n]), (d, p)) < (d, p):
                gone[d] |= set(range(p, p + n))
    return [("\n".join(y for k, y in enumerate(t.split("\n")) if k not in g) if g else t, len(g)) for t, g in zip(texts, gone, strict=True)]


def check(docs_of, texts, n):
    got = lines.dedup_lines(docs_of(list(enumerate(texts))), n, details=True).orderBy("doc_id").collect()
    assert [(r.text, r.n_removed) for r in got] == brute(texts, n)


def test_against_brute_force(docs_of):
    r = random.Random(9)
    pool = [prose(k, r.choice([1, 1, 2, 3, 8])) for k in range(12)] + [""]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 25))) + r.choice(["", "\n"]) for _ in range(60)]
    for n in (1, 6, 15):
        check(docs_of, texts, n)


def test_long_runs_of_short_lines(docs_of):
    run = [str(k % 7) for k in range(40)]
    check(docs_of, ["\n".join(run), "x\n" + "\n".join(run[3:35]) + "\ny", "\n".join(run[:10]), "\n".join(run)], 20)


def brute_maximal(texts, min_words):
    """Lines of each text inside any later copy of a run of any length of at least min_words words."""
    split = [t.split("\n") for t in texts]
    first, gone = {}, [set() for _ in texts]
    for d, x in enumerate(split):
        for p in range(len(x)):
            for e in range(p + 1, len(x) + 1):
                if sum(len(y.split()) for y in x[p:e]) >= min_words and first.setdefault(tuple(x[p:e]), (d, p)) < (d, p):
                    gone[d] |= set(range(p, e))
    return [(len(g), "\n".join(y for k, y in enumerate(x) if k not in g)) for x, g in zip(split, gone, strict=True)]


def test_whole_maximal_runs_go(docs_of):
    r = random.Random(4)
    a, b = prose(1, 60), prose(2, 30)
    pool = [prose(k, r.choice([1, 2, 3, 9])) for k in range(30)]
    runs = [[r.choice(pool) for _ in range(9)] for _ in range(6)]
    texts = [f"{a}\n{b}\n{prose(3, 9)}", f"{a}\n{b}\n{prose(4, 9)}", f"{a}\n{b}"]
    texts += ["\n".join([r.choice(pool), *r.choice(runs)[r.randrange(3) :], r.choice(pool), *r.choice(runs)]) for _ in range(30)]
    for n in (12, 50):
        got = lines.dedup_lines(docs_of(list(enumerate(texts))), n, details=True, whole_runs=True).orderBy("doc_id").collect()
        assert [(x.n_removed, x.text) for x in got] == brute_maximal(texts, n)


def test_every_line_stays_somewhere(docs_of):
    r = random.Random(2)
    texts = ["\n".join(prose(r.randrange(6), 12) for _ in range(8)) for _ in range(30)]
    got = lines.dedup_lines(docs_of(list(enumerate(texts))), 12).collect()
    assert {x for t in texts for x in t.split("\n")} == {x for g in got for x in g.text.split("\n") if x}


def test_odd_rows(odd, none):
    out = lines.dedup_lines(odd, details=True)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and out.columns[: len(odd.columns)] == odd.columns
    assert rows[1].text is None and rows[2].text == "" and rows[4].n_removed == 0 and rows[5].text == "" and rows[7].n_removed == 0
    assert lines.dedup_lines(none).count() == 0


def test_columns_with_clashing_names(spark):
    a = prose(1, 60)
    names = ["doc_id", "text", "d", "th", "pos", "len", "n_removed", "own_d", "begin", "__th", "r"]
    docs = spark.createDataFrame([(i, t, *"abcdefghi") for i, t in ((1, a), (2, f"{a}\nx"), (None, f"y\n{a}"))], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names[2:]))
    out = lines.dedup_lines(docs, details=True, whole_runs=True)
    assert out.columns == [*names, "n_lines", "_n_removed", "n_spans"]
    assert {r.doc_id: (r.text, r.th, r.n_removed, r._n_removed) for r in out.collect()} == {1: (a, "b", "e", 0), 2: ("x", "b", "e", 1), None: ("y", "b", "e", 1)}


def test_ranks_are_places_in_the_suffix_array(docs_of):
    """Ranks of repeated line runs are the starts of their intervals in the sorted list of all repeated ones."""
    r = random.Random(7)
    texts = ["\n".join(prose(r.randrange(5), 3) for _ in range(12)) for _ in range(9)]
    frame = docs_of(list(enumerate(texts))).selectExpr("doc_id as d", "0L as th", "posexplode(split(text, '\\n')) as (pos, h)")
    got = {(x.d, x.pos): x.r for x in lines.ranked(frame, ["h"], 1000).collect()}
    every = sorted(h for t in texts for h in t.split("\n"))
    want = {(d, p): every.index(h) for d, t in enumerate(texts) for p, h in enumerate(t.split("\n")) if every.count(h) > 1}
    assert got == want

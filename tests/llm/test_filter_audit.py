"""The audit against five filters applied one after another, in every order, to every document."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from millrace.llm import filter_audit

from .conftest import prose


def applied(docs, labels):
    """{(part, order, step): counts}; each filter sees what the ones before it left."""
    texts = {}
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    bad = {i for i, _, x in labels if i is not None and x == 1}
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and texts[t] < i}
        rows.append((s or "", i, {f for f, x in fails.items() if x}))
    out, share = {}, Counter()
    for order in permutations("ABCDE"):
        left = list(rows)
        for step, f in enumerate(order, 1):
            gone = [x for x in left if f in x[2]]
            left = [x for x in left if f not in x[2]]
            for part in {x[0] for x in rows}:
                mine = [x for x in gone if x[0] == part]
                share[part, f] += len(mine)
                failing = [x for x in rows if x[0] == part and f in x[2]]
                out[part, "".join(order), step] = (
                    sum(x[0] == part for x in left), len(mine), sum(bool(x[2] & set(order[: step - 1])) for x in failing), sum(x[2] == {f} for x in failing),
                    sum(x[1] in good for x in mine), sum(x[1] in bad for x in mine),
                )
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def table(spark, docs):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, 3) for i, t, s in docs], "doc_id long, text string, source string, mask int, part string, n long, digest int")


def marks(spark, rows):
    return spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, quality int, toxic int, n int")


def result(out):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order(spark, seed):
    r = random.Random(seed)
    pool = [prose(k, r.choice([10, 49, 50, 60, 90])) for k in range(12)]
    pool += [p.upper()[: r.randint(1, 40)] + p for p in pool[:6]] + [p + r.choice(" # $ % & * |".split()) for p in pool[:6]] + [" ".join([p] * 3) for p in pool[:3]]
    pool += [None, "", " \n\x0b", "É " * 60, "A\x1cb\xa0c " * 50, "😀A" * 9]
    docs = [(i, r.choice(pool), r.choice(["a", "b", "", None])) for i in range(160)]
    docs += [docs[3], docs[3], (3, pool[0], "b"), (None, pool[0], "a"), (None, pool[0], "a"), (None, "", None), (500, pool[0], "only"), (-4, pool[1], "a")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = result(filter_audit.audit(table(spark, docs), marks(spark, labels)))
    want = applied(docs, labels)
    assert got == want and len(got) == 600 * len({s or "" for _, _, s in docs})


def test_empty_tables(spark):
    none = table(spark, [])
    assert filter_audit.audit(none, marks(spark, [])).collect() == []
    got = result(filter_audit.audit(table(spark, [(1, "x", None)]), marks(spark, [])))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_thousands_of_copies_in_many_parts(spark):
    docs = [(i, "same", f"p{i % 30}") for i in range(3000)]
    got = result(filter_audit.audit(table(spark, docs), marks(spark, [(i, 1, 0) for i in range(3000)])))
    assert got["p0", "EABCD", 1] == (1, 99, 0, 0, 99, 0, 99 * 60) and got["p1", "EABCD", 1][:2] == (0, 100)
    assert sum(v[1] for k, v in got.items() if k[1:] == ("EABCD", 1)) == 2999


def test_native_plan(spark):
    plan = filter_audit.audit(table(spark, [(1, "x", "s")]), marks(spark, [(1, 1, 1)]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))

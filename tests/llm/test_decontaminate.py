import random

import pytest

from millrace.llm import decontaminate

from .conftest import prose
from .test_jaccard import edited, sets


def brute(texts, items, percent=80):
    a, b = sets([(t or "").lower() for t in texts]), sets([(t or "").lower() for t in items])
    return sorted((i, j, len(y), len(x & y)) for i, x in enumerate(a) for j, y in enumerate(b) if y and 100 * len(x & y) >= percent * len(y))


@pytest.fixture(scope="module")
def case(spark, docs_of):
    r = random.Random(6)
    items = [prose(k, r.randint(5, 60)) for k in range(30)] + ["", None, "one two", prose(0, 20)]
    texts = [" ".join([prose(900 + k, r.randint(0, 400)), r.choice([r.choice(items) or "", edited(items[k % 30], r, 1), edited(items[k % 30], r, 4), items[k % 30][20:]]).title(), prose(800 + k, 30)]) for k in range(80)]
    texts += ["one two", None, ""]
    frame = spark.createDataFrame([(j, t, j) for j, t in enumerate(items)], "item_id long, text string, doc_id long")
    return docs_of(list(enumerate(texts))), frame, brute(texts, items)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_against_brute_force(case, limit):
    docs, items, want = case
    assert want
    got = sorted(tuple(r) for r in decontaminate.contaminated_pairs(docs, items, broadcast_shingles=limit).select("doc_id", "item_id", "n_item", "n_shared").collect())
    assert got == want
    kept = {r.doc_id for r in decontaminate.decontaminated(docs, items, broadcast_shingles=limit).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {w[0] for w in want}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_odd_rows(spark, odd, none, limit):
    items = spark.createDataFrame([(1, odd.where("doc_id = 5").first().text), (None, "x y z w v u"), (1, None)], "item_id long, text string")
    got = decontaminate.contaminated_pairs(odd, items, broadcast_shingles=limit)
    assert sorted(r.doc_id for r in got.select("doc_id").distinct().collect()) == [4, 5]
    clean = decontaminate.decontaminated(odd, items, broadcast_shingles=limit)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 3
    assert decontaminate.contaminated_pairs(none, items, broadcast_shingles=limit).count() == 0
    assert decontaminate.decontaminated(odd, items.limit(0), broadcast_shingles=limit).count() == odd.count()


def test_both_ways_give_the_same_rows(spark, docs_of):
    """Null ids, repeated rows, different texts of one id, clashing columns, repeated items."""
    item = prose(900, 30)
    first, second = " ".join(item.split()[:16]), " ".join(item.split()[14:])
    docs = docs_of([(None, f"{prose(1, 9)} {item}"), (1, item), (1, item), (2, first), (2, second), (3, None), (4, ""), (2, f"x {item}"), (None, None), (5, prose(5, 200))])
    items = spark.createDataFrame([(7, item, 1), (7, item, 2), (8, None, 3), (None, first, 4)], "item_id long, text string, doc_id long")
    ways = [sorted(decontaminate.contaminated_pairs(docs, items, broadcast_shingles=n).collect(), key=str) for n in (1_000_000, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 13
    left = [sorted(decontaminate.decontaminated(docs, items, broadcast_shingles=n).collect(), key=str) for n in (1_000_000, 0)]
    assert left[0] == left[1] and sorted(str(r.doc_id) for r in left[0]) == ["2", "3", "4", "5", "None"]
    assert decontaminate.decontaminated(docs, items, broadcast_shingles=0).columns == docs.columns

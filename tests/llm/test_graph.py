import random

import pytest

from millrace.llm import _graph


def brute(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(label[u], label[v])
            if label[u] != low or label[v] != low:
                label[u] = label[v] = low
                changed = True
    return {u: v for u, v in label.items() if u != v}


@pytest.mark.parametrize("small", [100_000, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(_graph, "SMALL", small)
    r = random.Random(1)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(200, 200 + k) for k in range(1, 30)]
    loose = [(r.randrange(300, 360), r.randrange(300, 360)) for _ in range(45)]
    edges = path + star + [e for e in loose if e[0] != e[1]]
    r.shuffle(edges)
    frame = spark.createDataFrame([*edges, (5, 5), (None, 3)], "u long, v long").repartition(5)
    assert {x.u: x.v for x in _graph.components(frame).collect()} == brute(edges)
    assert _graph.components(frame.limit(0)).count() == 0

import numpy as np
import pytest

from millrace.llm import neighbours


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, point long, n string")


def brute(ids, x, labels, cosine=0.93):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= cosine) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], np.iinfo(np.int64).max).min(1))
        if (new == comp).all():
            return near.sum(1), comp
        comp = new


@pytest.mark.parametrize("bounds", [{}, {"group": 600, "hold": 500, "block": 100, "sample": 1000}])
def test_recall_and_components(spark, bounds):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 32))
    x = np.concatenate([rng.normal(size=(3000, 32)), *(base + 0.12 * rng.normal(size=base.shape) for _ in range(6)), np.repeat(base[:1], 40, 0)]).astype(np.float32).astype(float)
    ids = rng.permutation(len(x)).astype(np.int64)
    labels = np.concatenate([rng.integers(0, 2, 3000), np.tile(np.arange(60) % 2, 6), np.zeros(40, int)])
    got = neighbours.near_duplicates(frame(spark, [(int(i), [float(c) for c in v], int(g), 0, "x") for i, v, g in zip(ids, x, labels)]), leaf=150, **bounds).toPandas().set_index("vec_id").loc[ids]
    links, comp = brute(ids, x, labels)
    assert (got.n_links.to_numpy() <= links).all()
    assert got.n_links.sum() >= 0.95 * links.sum()
    assert (got.kept.to_numpy() == (got.component_id.to_numpy() == ids)).all()
    assert (got.component_id.to_numpy() == comp).mean() > 0.98


def test_large_leaves_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 4)).astype(np.float32)
    out = neighbours.near_duplicates(frame(spark, [(i, v.tolist(), 1, 0, "") for i, v in enumerate(x)]), leaf=100_000, cosine=0.9999)
    links, _ = brute(np.arange(5000), x.astype(float), np.ones(5000), 0.9999)
    got = out.toPandas().set_index("vec_id").loc[range(5000)]
    assert (got.n_links.to_numpy() == links).all()


def test_odd_vectors(spark):
    a, inf, nan = [1.0, 2.0, 3.0], float("inf"), float("nan")
    rows = [(1, a, 1, 0, ""), (1, a, 1, 0, ""), (2, [2.0, 4.0, 6.0], 1, 0, ""), (3, a, 2, 0, ""), (4, a, None, 0, ""), (5, a, None, 0, ""), (6, None, 1, 0, ""), (7, [], 1, 0, ""),
            (8, [0.0, 0.0, 0.0], 1, 0, ""), (9, [0.0, 0.0, 0.0], 1, 0, ""), (10, [1.0, None, 3.0], 1, 0, ""), (11, [inf, 1.0, 1.0], 1, 0, ""), (12, [nan, 1.0, 1.0], 1, 0, ""),
            (13, [1.0, 2.0], 1, 0, ""), (None, [-3.0, 1.0, 0.0], 1, 0, ""), (14, [1e38, 2e38, 3e38], 1, 0, "")]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(frame(spark, rows)).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == len(rows) and by[1][1:] == (3, 1, True) and by[2][1:] == (3, 1, False) and by[14][1:] == (3, 1, False)
    assert all(by[i][1:] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)) and by[None][1:] == (0, None, False)
    assert neighbours.near_duplicates(frame(spark, [])).count() == 0


def test_close_vectors_are_counted_once(spark):
    """One tight group of a third of all vectors meets in leaves of every tree; its links count once."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(800, 16)), rng.normal(size=16) + 0.02 * rng.normal(size=(500, 16)), rng.normal(size=(40, 16)).repeat(3, 0)]).astype(np.float32)
    got = neighbours.near_duplicates(frame(spark, [(i, v.tolist(), 1, 0, "") for i, v in enumerate(x)]), leaf=60, block=64).toPandas().set_index("vec_id").loc[range(len(x))]
    links, comp = brute(np.arange(len(x)), x.astype(float), np.ones(len(x)))
    assert (got.n_links.to_numpy() <= links).all() and got.n_links.sum() >= 0.99 * links.sum()
    assert (got.component_id.to_numpy() == comp).mean() > 0.99

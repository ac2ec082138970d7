import os
import random

import pytest

from millrace.llm import quality

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        good = r.random() < 0.8
        rows.append((i, prose(i, 80) if good else " ".join(w.upper() + "!!" for w in prose(i, 80).split())))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t.islower() for i, t in rows}


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == len(truth)
    unseen = [r for r in out if r.doc_id % 2 == 0]
    assert sum(r.kept == truth[r.doc_id] for r in unseen) / len(unseen) > 0.98
    assert sum(not r.kept for r in unseen if truth[r.doc_id]) <= 2


def view(spark, rows):
    return spark.createDataFrame([(i, t, "en", src, len(t or ""), 1) for i, t, src in rows], "doc_id long, text string, lang string, source string, n_chars long, th long")


def test_pseudo_labels_reach_the_other_view(spark):
    """Sources that no label covers get weights from rows that the text view is sure of, wherever they are in the table."""
    r = random.Random(9)
    rows = []
    for i in range(1500):
        bad = r.random() < 0.3
        text = " ".join(w.upper() + "!!" for w in prose(i, 40).split()) if bad else prose(i, 40)
        rows.append((i, text, ("dirty" if bad else "clean") if i >= 500 else "known"))
    labels = spark.createDataFrame([(i, int(t.islower()), 0) for i, t, _ in rows[:500]], "doc_id long, quality int, toxic int")
    docs = view(spark, rows)
    models = [quality.fit(docs, labels, rounds=k) for k in (0, 3)]
    blank = view(spark, [(1, prose(7, 5), "clean"), (2, prose(7, 5), "dirty")])
    scores = [{x.doc_id: x.meta_score for x in quality.score(blank, m).collect()} for m in models]
    assert abs(scores[0][1] - scores[0][2]) < 0.05 and scores[1][1] > scores[1][2] + 0.1


def test_toxic_words_are_learnt(spark):
    r = random.Random(3)
    bad = ["grubby", "vile", "rotten", "foul"]
    rows, toxic = [], {}
    for i in range(1200):
        words = prose(i % 400, 60).split()
        toxic[i] = r.random() < 0.15
        if toxic[i]:
            words[r.randrange(60) : 0] = r.sample(bad, 2)
        rows.append((i, " ".join(words), "s"))
    labels = spark.createDataFrame([(i, int(i % 9 > 0), int(toxic[i])) for i in range(700)], "doc_id long, quality int, toxic int")
    docs = view(spark, rows)
    got = {x.doc_id: x for x in quality.score(docs, quality.fit(docs, labels)).collect()}
    unseen = range(700, 1200)
    assert sum(got[i].toxic for i in unseen if toxic[i]) >= 0.95 * sum(toxic[i] for i in unseen)
    assert sum(got[i].toxic for i in unseen if not toxic[i]) <= 5 and not any(got[i].kept for i in unseen if got[i].toxic)


def test_samples_are_bounded_by_rows(spark, labelled):
    """Texts of one id and copies: at most ``max_labelled`` rows are taken, and a copied row counts once."""
    docs, labels, truth = labelled
    copies = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id = 1").withColumn("text", docs["source"]))
    model = quality.fit(copies, labels, max_labelled=120, handed=20)
    out = quality.score(docs, model).collect()
    assert sum(r.kept == truth[r.doc_id] for r in out) / len(out) > 0.95


def test_without_labels_everything_stays(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, labels) is None
    assert quality.score(odd, None).where("kept and score = 0.5").count() == odd.count()
    one = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, one) is None and quality.fit(none, one) is None
    assert quality.score(none, None).count() == 0


def test_odd_rows(labelled, odd):
    docs, labels, _ = labelled
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in quality.score(odd, model).collect()}
    assert rows[1].kept and rows[2].kept and rows[3].kept and len(rows) == 10
    kept = quality.score(odd, model, keep_columns=True)
    assert kept.columns == odd.columns and {1, 2, 3} <= {r.doc_id for r in kept.collect()}


def test_cheapest_cut():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(2, 30))
        score, bad = r.integers(0, 8, n) / 2.0, r.random(n) < 0.4
        t = quality.cheapest_cut(score, bad)
        cost = lambda t: quality.GOOD_COST * ((score > t) & ~bad).sum() + ((score <= t) & bad).sum()
        assert cost(t) == min(cost(x) for x in score) and t <= score.max()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_labels_that_the_fit_has_not_seen(spark):
    """Fitted on every other label of the real table, judged on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rest = labels.where("doc_id % 2 = 1").select("doc_id", "quality", (labels["toxic"] == 1).alias("is_toxic"))
    rows = quality.score(docs, model).join(rest, "doc_id").collect()
    share = lambda of, hit: sum(map(hit, own := [r for r in rows if of(r)])) / len(own)
    assert share(lambda r: r.quality == 1, lambda r: r.score < model.threshold) <= 0.005
    assert share(lambda r: r.quality == 0, lambda r: r.score < model.threshold) >= 0.88
    assert share(lambda r: r.is_toxic, lambda r: r.toxic) >= 0.75 and share(lambda r: not r.is_toxic, lambda r: r.toxic) <= 0.01


def test_texts_without_words_teach_nothing():
    """Only white texts on the side of the others: no lexicon, no fault."""
    import numpy as np

    none = np.zeros(0, np.uint32)
    for toxic in (1.0, 0.0):
        y = np.array([toxic if i % 2 else 1 - toxic for i in range(40)])
        words = [np.array([7, 9], np.uint32) if v == 1 else none for v in y]
        lexicon = quality.Lexicon(words, y)
        assert lexicon.score(np.array([7], np.uint32), np.array([0, 1])).tolist() == [0.0]
        assert quality.Lexicon([none] * 40, y).threshold == np.inf

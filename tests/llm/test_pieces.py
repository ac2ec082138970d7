import itertools
import os
import random

import pytest

from millrace.llm import pieces

from .conftest import prose

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(MODEL)


def every(v, segment):
    """All segmentations: (score, ids)."""
    if not segment:
        return [(0.0, ())]
    out = []
    for n in range(1, len(segment) + 1):
        if segment[:n] in v.arc:
            i, score = v.arc[segment[:n]]
            own = (i,)
        elif n == 1:
            own, score = v.fallback(segment[0]), v.unknown
        else:
            continue
        out += [(score + x, (*own, *ids)) for x, ids in every(v, segment[n:])]
    return out


def same_best(got, want, n):
    """The n best scores, each with ids of a segmentation of that score, none twice."""
    ids, scores = got
    assert scores == pytest.approx([x for x, _ in want[:n]])
    assert len(set(ids)) == len(ids)
    by = dict((i, x) for x, i in want)
    assert [by[i] for i in ids] == pytest.approx(scores)


def test_nbest_against_all_segmentations(vocabulary):
    r = random.Random(3)
    for _ in range(60):
        word = "▁" + "".join(r.choice("thereandingé日.") for _ in range(r.randint(1, 9)))
        want = sorted(every(vocabulary, word), reverse=True)
        for n in (1, 3, 5):
            ids, scores = vocabulary.nbest(word, n)
            same_best((ids, scores), want, n)
            best, top, loss = vocabulary.best(word)
            assert tuple(best) == ids[0] and top == pytest.approx(scores[0])
            assert loss == (pytest.approx(want[0][0] - want[1][0]) if len(want) > 1 else float("inf"))
            assert all(vocabulary.decode(i) == word[1:] for i in ids)


def test_ids_of_the_nbest_of_texts_against_all_segmentations(spark, vocabulary):
    texts = ["the end.", "a b, c", "on\nit", "é 日x", "aa aa", "x"]
    out = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL, n=5)
    rows = out.withColumn("every", pieces.segmentations()).collect()
    for row in rows:
        text = texts[row.doc_id]
        want = sorted(every(vocabulary, "▁" + text.replace(" ", "▁")), reverse=True)
        ids = list(map(tuple, row.every))
        assert ids[0] == tuple(row.ids) and len(row.others) == len(ids) - 1
        same_best((ids, list(row.scores)), want, 5)
        assert all(vocabulary.decode(i) == text for i in ids)


def test_segments_hold_no_piece_across(vocabulary):
    text = "Hello, world!! it's (a) test.\nnew  line — 50%% ***end*** a.b,c"
    segments = vocabulary.segments(text)
    assert "".join(segments) == "▁" + text.replace(" ", "▁")
    whole = vocabulary.nbest("▁" + text.replace(" ", "▁"), 3)[1]
    parts = pieces.document_nbest([vocabulary.nbest(s, 3)[1] for s in segments], 3)
    assert [x for x, _ in parts] == pytest.approx(whole)


def test_document_nbest():
    lists = [[0.0, -3.0, -4.0], [0.0, -1.0], [0.0, -2.0]]
    want = sorted((sum(x) for x in itertools.product(*lists)), reverse=True)
    got = pieces.document_nbest(lists, 5)
    assert [x for x, _ in got] == want[:5] and all(sum(o[k] for o, k in zip(lists, way)) == x for x, way in got)


def test_a_cache_that_starts_anew_changes_nothing(spark, docs_of, monkeypatch, vocabulary):
    texts = [prose(k, 40) for k in range(30)]
    one, two = pieces.Encoder(vocabulary, 4), pieces.Encoder(vocabulary, 4)
    whole = one.encode(texts)
    monkeypatch.setattr(pieces, "CACHE_BYTES", 1000)
    single = [two.encode([t]) for t in texts]
    assert whole[0].tolist() == [i for x in single for i in x[0].tolist()] and whole[2] == [x[2][0] for x in single]
    assert whole[3] == [y for x in single for y in x[3]]


def test_encode_and_decode(spark, odd, none, vocabulary):
    out = pieces.encode(odd, MODEL)
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.round_trip for r in rows)
    empty = [r for r in rows if r.doc_id in (1, 2)]
    assert all(list(r.ids) == [] and list(r.scores) == [0.0] for r in empty)
    one = next(r for r in rows if r.doc_id == 5)
    text = odd.where("doc_id = 5").first().text
    best = sum(vocabulary.nbest(s, 1)[1][0] for s in vocabulary.segments(text))
    assert one.scores[0] == pytest.approx(best) and list(one.scores) == sorted(one.scores, reverse=True)
    back = {r.doc_id: r.text for r in pieces.decode(out, MODEL).collect()}
    assert back[5] == text and back[9] == odd.where("doc_id = 9").first().text.replace("▁", " ")
    assert pieces.encode(none, MODEL).count() == 0

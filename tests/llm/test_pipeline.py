"""The pipeline against plain Python, stage by stage and as a whole, and its stages on odd rows."""

import os
import random

import pytest

import corpus_pipeline
from millrace.llm import pieces, quality

from .conftest import prose
from .test_decontaminate import brute as brute_leaks
from .test_jaccard import brute as brute_groups
from .test_jaccard import edited
from .test_lines import brute_maximal
from .test_pieces import MODEL

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with junk, repeated lines, near copies and benchmark items."""
    top = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(12)
    shared = ["\n".join(prose(500 + 10 * k + j, 13) for j in range(5)) for k in range(4)]
    items = [prose(800 + k, r.randint(8, 40)) for k in range(12)]
    texts = []
    for i in range(260):
        kind = i % 13
        body = "\n".join(prose(1000 + 10 * i + j, 18) for j in range(4))
        if kind in (3, 7):
            body = " ".join(w.upper() + "!!" for w in body.split())
        elif kind == 5:
            body = f"{body}\n{shared[i % 4]}\n{prose(i, 9)}"
        elif kind == 8:
            body = edited(texts[r.randrange(len(texts))].replace("\n", " "), r, 1)
        elif kind == 10:
            body = f"{body} {items[i % 12]} {prose(3000 + i, 20)}"
        texts.append(body)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{top}/documents.parquet")
    labels = [(i, int(not t.isupper() and "!!" not in t), 0) for i, t in enumerate(texts) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, texts, items


def plain(texts, kept, items):
    """{doc_id: text} after the stages that have one right answer."""
    ids = sorted(kept)
    cut = brute_maximal([texts[i] for i in ids], 50)
    left = {i: t for i, (n, t) in zip(ids, cut, strict=True) if not (n and not t.strip())}
    ids = sorted(left)
    groups = brute_groups([left[i].lower() for i in ids])
    left = {i: left[i] for k, i in enumerate(ids) if groups[k][1] == k}
    ids = sorted(left)
    leaks = {ids[x[0]] for x in brute_leaks([left[i] for i in ids], items)}
    return {i: t for i, t in left.items() if i not in leaks}


def test_run_against_plain_python(spark, folder):
    if not os.path.exists(MODEL):
        pytest.skip("no model file")
    top, texts, items = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    kept = {r.doc_id for r in STAGES["quality_classifier"](spark, docs, top).collect()}
    junk = {i for i, t in enumerate(texts) if "!!" in t}
    assert len(junk - kept) >= 0.95 * len(junk) and len(kept) >= 0.99 * (len(texts) - len(junk))
    want = plain(texts, kept, items)
    out = corpus_pipeline.run(spark, top)
    v = pieces.Vocabulary(MODEL)
    got = {r.doc_id: v.decode(r.ids) for r in out.collect()}
    assert got == want and len(want) < len(kept) and out.where("not round_trip").count() == 0


def odd_rows(a):
    long = "\n".join(prose(40 + k, 50) for k in range(60))
    return [(1, None), (2, ""), (3, " \n "), (4, a), (4, a), (4, prose(6, 80)), (5, a), (None, a), (None, prose(7, 70)), (None, None), (8, long), (9, "y" * 30000), (10, "\n\n")]


WANT = {
    "quality_classifier": lambda rows, a: rows,
    "line_dedup": lambda rows, a: [(i, t) for i, t in rows if not (t == a and i != 4)],
    "ngram_jaccard": lambda rows, a: [(i, t) for i, t in rows if not (t == a and i != 4)],
    "benchmark_decontamination": lambda rows, a: [(i, t) for i, t in rows if t != a],
}


@pytest.mark.parametrize("name", list(WANT))
def test_stages_on_odd_rows(spark, tmp_path, name):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns, an empty table."""
    a = prose(1, 120)
    extra = ["d", "th", "id", "n_removed", "own_d", "x", "kept"]
    ddl = COLUMNS + "".join(f", {c} string" for c in extra)
    rows = odd_rows(a)
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s", None if k % 4 else 5, *extra) for k, (i, t) in enumerate(rows)], ddl)
    spark.createDataFrame([(4, 1, 0), (None, 0, None), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, a), (None, None), (2, ""), (3, "zz yy xx ww vv uu")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = STAGES[name](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(WANT[name](rows, a), key=str)
    none = STAGES[name](spark, docs.limit(0), str(tmp_path))
    assert none.columns == docs.columns and none.count() == 0


def test_last_stage_on_odd_rows(spark, tmp_path):
    if not os.path.exists(MODEL):
        pytest.skip("no model file")
    rows = odd_rows(prose(1, 120))
    docs = spark.createDataFrame([(i, t, None, None, None, 7, "x") for i, t in rows], COLUMNS + ", ids long, scores string")
    got = STAGES["sentencepiece_encoding"](spark, docs, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got) and sum(not r.ids for r in got) == 3
    assert STAGES["sentencepiece_encoding"](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_no_model_without_two_classes(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 20), "en", "s", 1) for i in range(30)], COLUMNS)
    assert quality.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")) is None

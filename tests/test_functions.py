import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import deck as D
from millrace.functions import hashing as H
from millrace.functions import taxonomy as X
from millrace.functions import text as T
from millrace.functions.python import drop_one_line_digests, edit_distance, tree_facts


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def odd_strings(n=300):
    r = random.Random(4)
    return ["".join(r.choice("ab  \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85  é日") for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_python_lines_and_strip(spark):
    texts = odd_strings()
    assert apply(spark, texts, T.splitlines) == [t.splitlines() for t in texts]
    assert apply(spark, texts, T.strip) == [t.strip() for t in texts]
    assert apply(spark, texts, T.words) == [t.split() for t in texts]


def test_source_normalisation(spark):
    good = "+ 1 2 3 4 5\n\n7 Y7 z  c9 s y7 F\n0020+ t y7 ff\nignored"
    packed = "+" + "".join(f"{n:010d}" for n in (1, 2, 3, 4, 5)) + "\n1 a ff"
    cases = [good, packed, "", "x y", "+ 1 2 3 4 5\n+ 1", "+ 1 2 3 4 5\nwhat", "+ 1 2 3 4 5\n1 a f"]
    out = apply(spark, cases, T.normalise_source)
    assert out[0].text == "+ 1 2 3 4 5\n0007+ y7 z c9 s y7 f\n0020+ t y7 ff\n" and out[0].error is None
    assert out[1].text == "+ 1 2 3 4 5\n0001+ a ff\n"
    assert [o.error for o in out[2:]] == ["empty", "header", "continuation", "statement", "unterminated"]


def test_source_normalisation_works_out_each_step_once(spark):
    rows = spark.createDataFrame([("+ 1 2 3 4 5\n1 a ff",)], "v string").select(T.normalise_source(F.col("v")).alias("o")).select("o.text", "o.error")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and len(plan) < 20_000


def test_alpha_and_shape(spark):
    texts = ["0007+ y7 z c9 s y7 f\n0020+ t y7 ff\n", "+ 1 2\n5 g 9 ci1 i1k i3 f", None, " +7 y2\n12345 y2 y4\n\n7", "y3 y1\n+ y3\ni9 y1 c2 i9"]
    want = ["0001+ y1 z c1 s y1 f\n0002+ t y1 ff\n", "+ 1 2\n0001+ g 9 ci1 i1k i1 f\n", None, "+7 y1\n12345 y1 y2\n\n0001+\n", "y1 y2\n+ y3\ni1 y2 c1 i1\n"]
    assert apply(spark, texts, T.alpha_normalise) == want
    assert apply(spark, ["+ 1\n0007+ y7 z 12 9j f"], T.shape_normalise) == ["+ header\nstmt+ var z int float f\n"]


def test_counts_and_buckets(spark):
    assert apply(spark, ["+ h\na\n\n b\n", ""], T.statement_count) == [2, 0]
    assert apply(spark, [1, 3, 4, 20, 21], T.count_bucket, "int") == ["1_3", "1_3", "4_8", "9_20", "21_plus"]


def test_digests_of_shrink_candidates(spark):
    texts = [None, "", "a", "a\nb", "a\nb\nc\nd", "\n\n\n", *odd_strings(60), *("é\n\n日本\r\n" * n for n in range(1, 9))]
    want = apply(spark, texts, lambda c: F.transform(T.drop_one_line(c), lambda x: F.sha2(F.array_join(x, "\n"), 256)))
    assert [x or [] for x in apply(spark, texts, drop_one_line_digests)] == [x or [] for x in want]
    # 20,000 lines: their candidates together hold 400 million lines
    assert len(set(apply(spark, ["\n".join(map(str, range(20_000)))], drop_one_line_digests)[0])) == 19_998


def test_completions_and_prompts(spark):
    cases = ["x <PIT>\n  a\nb\n</PIT> y", "<PIT>\n    a\nb", "plain\n", "a</PIT>b"]
    assert apply(spark, cases, T.completion_deck) == ["  a\nb", "    a\nb", "plain", "a"]
    assert apply(spark, ["think <PIT>a", "none"], T.thinking_trace) == ["think", ""]
    assert apply(spark, ["a\n", " <PIT>\na\n</PIT> "], T.ensure_wrapped) == ["<PIT>\na\n</PIT>"] * 2
    p = apply(spark, ["src\n"], lambda c: T.prompt(c, "sys"))[0]
    assert p == "sys\n\nUser:\n<IT>\nsrc\n</IT>\n\nAssistant:\n" and apply(spark, [p, "x"], T.source_of_prompt) == ["src", None]
    row = spark.sql("select 's' as s, array(struct('q' as source_text, 'd' as completion)) as e")
    few = row.select(T.few_shot_prompt("s", "e", "sys").alias("o")).first().o
    assert few == "sys\n\nUser:\n<IT>\nq\n</IT>\n\nAssistant:\n<PIT>\nd\n</PIT>\n\nUser:\n<IT>\ns\n</IT>\n\nAssistant:\n"
    assert [m.role for m in row.select(T.chat_messages("s", "sys", "e").alias("o")).first().o] == ["system", "user", "assistant", "user"]


def test_small_parsers(spark):
    assert apply(spark, ["123-", "7+", "x", " 9 "], T.signed_accumulator) == [-123, 7, None, 9]
    assert apply(spark, ["1/4\n2/4 and 3/4\nend", "none"], T.last_progress) == [(3, 4), None]
    assert apply(spark, ["a\nb\nc\nd", "a"], T.drop_one_line) == [[["a", "c", "d"], ["a", "b", "d"]], []]


def test_decks(spark):
    r = random.Random(2)
    pool = ["a  b ", "", "  ", "c", "dd", "e"]
    pairs = [([r.choice(pool) for _ in range(r.randint(0, 6))], [r.choice(pool) for _ in range(r.randint(0, 6))]) for _ in range(80)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    rows = df.select("i", D.per_line_exact("a", "b").alias("p"), D.diff_indices("a", "b").alias("d"), D.canonical("a").alias("c"), D.canonical("a", False, True).alias("k"), D.split_tail("a", 3).alias("t")).orderBy("i").collect()
    for (a, b), row in zip(pairs, rows, strict=True):
        n = max(len(a), len(b))
        same = [k < len(a) and k < len(b) and a[k] == b[k] for k in range(n)]
        assert row.p == sum(same) / max(n, 1) and list(row.d) == [k for k in range(n) if not same[k]]
        c = [x.rstrip() for x in a]
        assert list(row.k) == [re.sub(" {2,}", " ", x) if x.strip() else "" for x in c]
        while c and not c[0].strip():
            c.pop(0)
        while c and not c[-1].strip():
            c.pop()
        assert list(row.c) == c
        assert row.t is None if len(a) < 3 else (list(row.t.body), list(row.t.tail)) == (a[:-3], a[-3:])


def test_edit_distance_is_difflib(spark):
    r = random.Random(6)
    pairs = [("".join(r.choice("abc \n") for _ in range(r.randint(0, 260))), "".join(r.choice("abc \n") for _ in range(r.randint(0, 260)))) for _ in range(30)] + [("x", "x"), ("", "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [x.o for x in df.select("i", edit_distance("a", "b").alias("o")).orderBy("i").collect()]
    assert got == pytest.approx([1 - difflib.SequenceMatcher(a=a, b=b).ratio() for a, b in pairs])


def test_failure_classes(spark):
    ten = [f"{k}  x" for k in range(10)]
    cases = [
        (ten, True, False, False, None, "bad", "evaluator_invariant_failure"), (ten, True, False, False, None, None, "exact_match"),
        ([*ten, "User: x"], False, True, True, None, None, "malformed_source_echo_in_output"),
        (["+ 1 2 3 4 5", "0001+ a f", "z"], False, True, True, None, None, "returned_it_source_instead_of_pit"), (ten[:9], False, True, True, None, None, "malformed_pit_card"),
        (ten, False, False, True, "assemble_error", None, "wrong_reservation_handling_or_symbolic_output"), (ten, False, None, None, "ok", None, "unassemblable_output"),
        (ten, False, True, True, None, None, "functional_success_exact_failure"), (ten, False, True, False, None, None, "assembles_but_misexecutes"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, cards array<string>, e boolean, a boolean, f boolean, s string, v string, want string")
    for r in df.select("want", X.classify_failure("cards", "e", "a", "f", "s", "v").alias("got"), X.worth_assembling("cards", "e").alias("w")).collect():
        assert r.got == r.want


def test_review_categories(spark):
    ref = [f"b{k} x" for k in range(30)]
    change = lambda **k: [k.get(f"_{i}", x) for i, x in enumerate(ref)]
    cases = [
        (change(_3="b3 tra"), "wrong_transfer_target", "non_tail_divergence"), (change(_3="b3 y"), "assembles_but_misexecutes_small_diff", "non_tail_divergence"),
        (change(_25="b25 y"), "symbolic_tail_or_reservation_drift", "tail_only_other"), (ref, "functional_success_exact_failure", "functional_success_exact_failure"),
        (change(_29="q s00"), "symbolic_tail_or_reservation_drift", "partial_dictionary_tail_truncation"), (["  b0 x", *ref[1:]], "assembles_but_misexecutes_small_diff", "functional_success_exact_failure"),
    ]
    df = spark.createDataFrame([(i, ref, c, a, b) for i, (c, a, b) in enumerate(cases)], "i int, r array<string>, c array<string>, one string, two string")
    yes, no = F.lit(True), F.lit(False)
    for r in df.select("one", "two", X.tail_category("r", "c", no, no, yes).alias("x"), X.band_category("r", "c", no, no, yes).alias("y")).collect():
        assert (r.x, r.y) == (r.one, r.two)


def test_trees():
    tree = '{"statements": [{"target": {"cls": "y", "index": {"value": 1}}, "expr": {"lhs": {"lhs": 1, "rhs": 2}, "rhs": {"cls": "c", "index": {"lhs": 1, "rhs": 2}}}}, {"end_stmt": 3, "loop_var": "i1"}]}'
    assert tree_facts(tree) == (3, True, True) and tree_facts("") == (None, False, False) and tree_facts("{") == (None, False, False)


def test_hashes(spark):
    from hashlib import sha256

    want = [int(sha256(v.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF for v in ("a", "é")]
    assert apply(spark, ["a", "é"], H.unit_hash) == want
    row = spark.sql("select 'B1' as b, 7 as s, 'x' as h").select(H.record_id("b", "s", "h", "h", "h").alias("o")).first().o
    assert row == sha256(b"B1\n7\nx\nx\nx").hexdigest()

"""Streams that go on from checkpoints, admission by rounds, digests of sorted rows, deep rewriting, file trees and the bound index."""

import difflib
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import edits, hashing
from millrace.operators import admit, retrieve, sft
from millrace.sources import records, trees
from millrace.streaming import admission, incremental, ledger


def in_order(rows, quotas):
    """(place of accepted rows, reasons by place), one row after another."""
    seen, taken, out = set(), {}, {}
    for p, b, k in rows:
        if taken.get(b, 0) >= quotas.get(b, 0):
            out[p] = "quota_reached"
        elif k in seen:
            out[p] = "duplicate"
        else:
            seen.add(k)
            taken[b] = taken.get(b, 0) + 1
            out[p] = None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_admission_of_keys_shared_by_bands(spark, seed):
    """Chains: whether a key is taken in one band depends on what other bands took before."""
    r = random.Random(seed)
    rows = [(p, r.choice("ABCD"), r.choice([None, *range(r.choice([4, 30]))])) for p in range(250)]
    quotas = {"A": 3, "B": r.randint(0, 9), "C": 20}
    df = spark.createDataFrame(rows, "seed int, band string, alpha_hash int")
    got = {x.seed: (x.reason, x.ordinal) for x in admit.admit(df, quotas, order=["seed"]).collect()}
    want = in_order(rows, quotas)
    assert {p: x[0] for p, x in got.items()} == want
    assert [p for p, x in sorted(got.items(), key=lambda x: x[1][1] or 0) if x[1]] == [p for p in sorted(want) if want[p] is None]


def test_admission_without_python(spark):
    df = spark.createDataFrame([(1, "A", "x")], "seed int, band string, alpha_hash string")
    assert "Pandas" not in admit.admit(df, {"A": 1}, order=["seed"])._jdf.queryExecution().toString()


def test_a_chain_through_many_bands(spark):
    """Each decision waits for the one before it."""
    rows = [(2 * k + j, f"b{k + j}", f"k{k}") for k in range(12) for j in (0, 1)]
    quotas = {f"b{k}": 1 for k in range(13)}
    df = spark.createDataFrame(rows, "seed int, band string, alpha_hash string")
    assert {x.seed: x.reason for x in admit.admit(df, quotas, order=["seed"]).collect()} == in_order(sorted(rows), quotas)


def test_stateful_admission_goes_on_from_its_checkpoint(spark, tmp_path):
    r = random.Random(3)
    rows = [(p, r.choice("ABC"), f"k{r.randrange(40)}" if r.random() > 0.1 else None) for p in range(400)]
    folder, schema = f"file://{tmp_path}", "seed long, band string, alpha_hash string, other int"
    seen, want = {}, []
    for k in range(4):  # each time another start; the third finds nothing new
        part = [(*x, 0) for x in rows[k * 100 : (k + 1) * 100]] if k != 2 else []
        if part:
            spark.createDataFrame(part, schema).repartition(2).write.parquet(f"{folder}/in/{k}")
        stream = incremental.read_folder(spark, f"{folder}/in/*", schema)
        admission.run(spark, admission.admitted(stream, {"A": 5, "B": 1000}, default=2), f"{folder}/out", f"{folder}/checkpoint")
        for p, b, key, _ in part:
            mine = seen.setdefault(b, [])
            if str(key or "null") not in mine and len(mine) < {"A": 5, "B": 1000}.get(b, 2):
                mine.append(str(key or "null"))
                want.append((b, mine[-1], p, len(mine)))
    got = spark.read.parquet(f"{folder}/out")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_a_batch_is_appended_once(spark, tmp_path):
    """A stop between the files of a batch and its entry: nothing of it is read, and the next start writes it once."""
    folder = f"file://{tmp_path}"
    schema = "id long, v string"

    def put(k):
        spark.createDataFrame([(i, f"v{i}") for i in range(10 * k, 10 * k + 10)], schema).write.parquet(f"{folder}/in/{k}")
        return incremental.read_folder(spark, f"{folder}/in/*", schema)

    def stop(number):
        raise KeyError("stopped here")

    ids = lambda: sorted(r.id for r in ledger.read(spark, f"{folder}/out", schema).collect())
    assert ids() == []
    ledger.append_once(put(0), f"{folder}/out", f"{folder}/checkpoint")
    with pytest.raises(Exception, match="stopped here"):
        ledger.append_once(put(1), f"{folder}/out", f"{folder}/checkpoint", before_entry=stop)
    assert ids() == list(range(10)) and (tmp_path / "out" / "batches" / "1").exists()
    ledger.append_once(put(2), f"{folder}/out", f"{folder}/checkpoint")
    assert ids() == list(range(30))
    ledger.append_once(incremental.read_folder(spark, f"{folder}/in/*", schema), f"{folder}/out", f"{folder}/checkpoint")
    assert ids() == list(range(30))


def test_digest_of_groups_of_any_size(spark):
    r = random.Random(5)
    files = [(g, s, f"p{i:05d}" if i else None, f"text {r.random()}" if i % 9 else None) for g, s, n in ((1, "a", 2500), (1, "b", 3), (None, "a", 2), (2, "é", 1)) for i in range(n)]
    df = spark.createDataFrame(files, "g int, s string, path string, content string")
    want = {}
    for g, s in {(g, s) for g, s, *_ in files}:
        mine = sorted((p or "", c or "") for x, y, p, c in files if (x, y) == (g, s))
        want[g, s] = (len(mine), hashlib.sha256("".join(f"{p}\0{c}\0" for p, c in mine).encode()).hexdigest())
    out = hashing.fileset_digest(df, ["g", "s"])
    assert out.columns == ["g", "s", "n_files", "digest"]
    assert {(x.g, x.s): (x.n_files, x.digest) for x in out.collect()} == want
    cut = df.select("g", "s", "path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "")).alias("k", "content"))
    assert {(x.g, x.s): (x.n_files, x.digest) for x in hashing.fileset_digest(cut.repartition(5), ["g", "s"], piece="k").collect()} == want
    assert hashing.fileset_digest(df.limit(0), ["g"]).collect() == []


def test_every_string_leaf_is_rewritten(spark):
    schema = "a string, n int, b struct<c:string,d:array<struct<e:string,f:map<string,array<string>>>>>, g array<array<string>>, `x.y` string, z struct<n:int>"
    rows = [("/old/1", 1, (None, [("/old", {"/old/k": ["/old/2", None, "x/old"]}), None]), [["/old/3"], None], "/old/4", (5,)), (None, None, None, None, None, None)]
    got = records.rewrite_strings(spark.createDataFrame(rows, schema), "/old", "/new").collect()
    first = json.loads(json.dumps(got[0].asDict(True)))
    assert first == {"a": "/new/1", "n": 1, "b": {"c": None, "d": [{"e": "/new", "f": {"/old/k": ["/new/2", None, "x/old"]}}, None]}, "g": [["/new/3"], None], "x.y": "/new/4", "z": {"n": 5}}
    assert tuple(got[1]) == (None,) * 6


def test_every_string_of_json_is_rewritten(spark):
    def change(x):
        if isinstance(x, str):
            return "C:\\n$1" + x[4:] if x.startswith('/o"+') else x
        if isinstance(x, list):
            return [change(y) for y in x]
        return {k: change(v) for k, v in x.items()} if isinstance(x, dict) else x

    r = random.Random(1)
    leaf = lambda: r.choice(['/o"+', '/o"+/x', ' /o"+', ':/o"+', '"', ',"', ':"/o\\"+', "\\", "é", 1, None, True, "["])
    tree = lambda n: leaf() if n == 0 or r.random() < 0.3 else [tree(n - 1) for _ in range(r.randint(0, 4))] if r.random() < 0.5 else {r.choice(['/o"+', "k", ":", "b"]): tree(n - 1) for _ in range(3)}
    docs = [tree(4) for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, "{broken"), (-2, None)], "i int, t string")
    got = {x.i: x.t for x in df.select("i", records.rewrite_json("t", '/o"+', "C:\\n$1").alias("t")).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    assert {i: json.loads(t) for i, t in got.items()} == {i: change(d) for i, d in enumerate(docs)}


def test_many_folders_share_partitions(spark, tmp_path):
    names = [f"c{k:03}" if k % 3 else f"n/{k}/o" for k in range(400)]
    df = spark.createDataFrame([(n, {".meta": n, "a/b.txt": n * 2}) for n in names], "folder string, files map<string,string>")
    trees.write_tree(df, str(tmp_path / "t"))
    read = trees.read_tree(spark, str(tmp_path / "t"))
    assert read.rdd.getNumPartitions() < 30  # one for each folder before
    assert {r.name: bytes(r.content).decode() for r in read.collect()} == {f"{n}/{x}": t for n in names for x, t in ((".meta", n), ("a/b.txt", n * 2))}


def test_trees_are_written_as_a_whole(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    rows = [(f"d{k}/x", {"a.txt": f"é{k}", ".hid": "", "sub/_b": None}) for k in range(30)]
    df = spark.createDataFrame(rows, "folder string, files map<string,string>").repartition(4)
    trees.write_tree(df, target)
    got = {r.name: bytes(r.content) for r in trees.read_tree(spark, target).collect()}
    assert got == {f"{d}/{n}": (t or "").encode() for d, f in rows for n, t in f.items()}
    assert {r.name for r in trees.read_tree(spark, str(tmp_path / "t"), ".h*").collect()} == {f"d{k}/x/.hid" for k in range(30)}
    # a task that fails leaves nothing, what was there stays
    bad = df.select("folder", F.when(F.col("folder") == "d7/x", F.map_from_arrays(F.array(F.lit("../up")), F.array(F.lit("x")))).otherwise(F.create_map(F.lit("a.txt"), F.lit("new"))).alias("files"))
    with pytest.raises(Exception, match="no name of a file"):
        trees.write_tree(bad, target)
    assert {r.name: bytes(r.content) for r in trees.read_tree(spark, target).collect()} == got and not (tmp_path / "t" / trees.ATTEMPTS).exists()
    with pytest.raises(Exception, match="several rows have one folder"):
        trees.write_tree(df.unionByName(df), target)
    # a folder that is written again is replaced
    trees.write_tree(df.where("folder = 'd3/x'").select("folder", F.create_map(F.lit("only"), F.lit("é")).alias("files")), target, latin1=True)
    again = {r.name: bytes(r.content) for r in trees.read_tree(spark, target).collect()}
    assert again == {k: v for k, v in got.items() if not k.startswith("d3/")} | {"d3/x/only": b"\xe9"}
    assert trees.read_tree(spark, f"{target}/none").collect() == []


def test_the_first_base_that_has_a_path(spark, tmp_path):
    for name in ("one/a", "two/a", "two/b"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    df = spark.createDataFrame([(x,) for x in ("a", "b", "c", str(tmp_path / "two/b"), "/none", None)], "p string")
    got = [r.place for r in trees.first_existing(df, "p", [f"{tmp_path}/one/", f"{tmp_path}/two"], "place").collect()]
    assert got == [f"{tmp_path}/one/a", f"{tmp_path}/two/b", f"{tmp_path}/one/c", f"{tmp_path}/two/b", "/none", None]


def test_edits_of_many_texts_at_once(spark):
    r = random.Random(8)
    text = lambda most: "".join(r.choice("ab é日") for _ in range(r.randint(0, most)))
    texts = ["", *(text(most) for most in (3, 70, 200) for _ in range(15))]
    pairs = [(q, t) for q in ["", "a" * 64, "b" * 63, "ab" * 64, "x" * 65, text(200), text(10)] for t in texts]
    rows = spark.createDataFrame(pairs, "q string, t string").select("q", "t", F.levenshtein("q", "t").alias("n")).collect()
    want = {(x.q, x.t): x.n for x in rows}
    alphabet, codes = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
    size = np.array([len(t) for t in texts])
    for q in {q for q, _ in pairs}:
        assert retrieve._edits(q, alphabet, codes, np.cumsum(size) - size, size).tolist() == [want[q, t] for t in texts]


@pytest.mark.parametrize("mode, grams", [("compat", 0), ("compat", 4), ("levenshtein", 0), ("levenshtein", 4)])
def test_nearest_against_all_pairs(spark, monkeypatch, mode, grams):
    monkeypatch.setattr(retrieve, "QUERIES", 7)
    monkeypatch.setattr(retrieve, "EXAMPLES", 9)
    r = random.Random(6)
    text = lambda: " ".join(r.choice(["to", "add", "é", "日本", "loop", "x" * 40, "sum", "b2"]) for _ in range(r.randint(0, 12)))
    examples = [(i, text()) for i in range(120)] + [(500, None), (501, "")]
    queries = [(k, text()) for k in range(25)] + [(100, None), (101, ""), (102, examples[5][1])]

    def score(a, b):
        if mode == "compat":
            return 1.0 if a == b else difflib.SequenceMatcher(a=a, b=b).ratio()
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b), 1)

    want = {}
    for k, q in queries:
        if q is not None:
            same = [i for i, e in examples if e == q]
            want[k] = (min(same), 1.0) if same else max(((i, score(q, e)) for i, e in examples if e is not None), key=lambda x: (x[1], x[0]))
    q, e = spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(examples, "example_id int, text string")
    out = retrieve.nearest(q, e, grams=grams, mode=mode, details=True).collect()
    assert {x.query_id: (x.example_id, pytest.approx(x.score)) for x in out} == want
    if grams or mode == "compat":
        assert sum(x.compared for x in out) < 0.7 * len(queries) * len(examples)
    assert retrieve.nearest(q, e.limit(0), mode=mode).collect() == [] and retrieve.nearest(q.limit(0), e, mode=mode).collect() == []


def _all_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("four, two", [(0, 0), (0, 99), (99, 99)])
def test_edits_up_to_a_most(monkeypatch, four, two):
    """Exact up to ``most``, above it elsewhere, with words of 16, 32 and 64 rows and most words left out."""
    monkeypatch.setattr(edits, "FOUR", four)
    monkeypatch.setattr(edits, "TWO", two)
    r, points = random.Random(3), lambda t: np.array([ord(c) for c in t], np.uint32)
    for letters, most_chars in (("ab", 150), ("abcdefghijkl", 150), ("ab é日", 70), ("abc", 9)):
        text = lambda most: "".join(r.choice(letters) for _ in range(r.randint(0, most)))  # noqa: E731, B023
        q = text(most_chars) + "a"
        texts = ["", q, q[::-1], *(q[: (k := r.randint(0, len(q)))] + text(3) + q[k + 2 :] for _ in range(6)), *(text(2 * most_chars) for _ in range(12))]
        held, want = edits.Texts(points("".join(texts)), np.array([len(t) for t in texts])), np.array([_all_edits(q, t) for t in texts])
        for most in (want, np.maximum(want - 1, 0), want + 3, np.full(len(texts), 5), np.full(len(texts), len(q) // 3)):
            for some in (slice(None), np.array([1, 4, 9, 20])):
                got, n, m = edits.edits(points(q), held, some, most[some]), want[some], most[some]
                assert (np.where(n <= m, got == n, got > m)).all()


def test_nearest_in_small_packs_of_one_length(spark, monkeypatch):
    """Some examples first, many packs, several lots in a pack: the same as all pairs, with few pairs compared and ties to the larger id."""
    for name, n in (("FIRST", 4), ("FIRST_LEAST", 4), ("CHARS", 900), ("AT_ONCE", 5)):
        monkeypatch.setattr(retrieve, name, n)
    r = random.Random(5)
    text = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.choice([3, 12, 40, 90])))
    examples = [(i, text()) for i in range(150)] + [(900, "x" * 700), (901, ""), (902, None)]
    queries = [(k, text()) for k in range(6)] + [(k, t[:-3] + "yz") for k, t in examples[50:62]] + [(300, ""), (301, "日" * 9)]
    want = {}
    for k, q in queries:
        top = max((1 - _all_edits(q, e) / max(len(q), len(e), 1), i) for i, e in examples if e is not None)
        want[k] = top[1], pytest.approx(top[0])
    q, e = spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(examples, "example_id int, text string")
    out = retrieve.nearest(q, e, grams=5, mode="levenshtein", details=True).collect()
    assert {x.query_id: (x.example_id, x.score) for x in out} == want
    assert sum(x.compared for x in out) < 0.3 * len(queries) * len(examples)


def test_training_rows_have_all_columns(spark):
    df = spark.createDataFrame([("i", "B1", "+ 1 i1\n1+ y3 z c2 f\n", "\nline\n")], "id string, band string, s string, t string")
    out = sft.training_rows(df, "s", "t", "sys", {"B1": 2})
    assert out.columns == ["prompt", "completion", "target_text", "id", "source_text", "source_alpha", "band", "repeat_index"]
    a, b = sorted(out.collect(), key=lambda x: x.repeat_index)
    assert (a.completion, a.target_text, b.repeat_index) == ("<PIT>\nline\n</PIT>", "\nline\n", 1) and a.source_alpha == b.source_alpha

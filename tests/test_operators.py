import random
from collections import defaultdict, deque
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from millrace.operators import admit, dedupe, monitor, order, report, retrieve, review, sample, sft, split


def records(spark, sizes, extra=0):
    rows = [(f"{b}-{i}", b, f"h{b}{i}", i) for b, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, band string, alpha_hash string, seed long")


def counts(df):
    return {r.band: r.n for r in df.groupBy("band").agg(F.count("*").alias("n")).collect()}


def test_round_robin_is_even(spark):
    assert counts(sample.round_robin(records(spark, {"B0": 4, "B1": 4, "B2": 4}), 6, "s")) == {"B0": 2, "B1": 2, "B2": 2}


def test_weighted_turns(spark):
    df = records(spark, {"B0": 4, "B1": 4, "B2": 4})
    assert counts(sample.weighted_round_robin(df, 6, "s", {"b0": 3})) == {"B0": 4, "B1": 1, "B2": 1}
    df = records(spark, {f"B{k}": 5 for k in range(6)})
    assert counts(sample.weighted_round_robin(df, 12, "s", {"B0": 4, "B1": 4})) == {"B0": 4, "B1": 4, "B2": 1, "B3": 1, "B4": 1, "B5": 1}


def queue_model(rows, limit, weights, salt="s"):
    queues = defaultdict(list)
    for r in rows:
        queues[r[1]].append(r)
    queues = {b: deque(sorted(q, key=lambda r: (sha256(f"{salt}:{r[1]}:{r[2]}:{r[0]}".encode()).hexdigest(), r[0]))) for b, q in queues.items()}
    out = []
    while len(out) < limit and any(queues.values()):
        for b in sorted(queues):
            for _ in range(weights.get(b, 1)):
                if queues[b] and len(out) < limit:
                    out.append(queues[b].popleft()[0])
    return out


def test_turns_against_queues(spark):
    r = random.Random(1)
    for _ in range(4):
        sizes = {f"B{k}": r.randint(1, 9) for k in range(r.randint(1, 5))}
        weights = {b: r.randint(1, 4) for b in sizes}
        df = records(spark, sizes)
        rows = [tuple(x) for x in df.collect()]
        limit = r.randint(1, len(rows))
        got = [x.id for x in sample.weighted_round_robin(df, limit, "s", weights).collect()]
        assert sorted(got) == sorted(queue_model(rows, limit, weights))


def test_stable_limit_edges(spark):
    df = records(spark, {"B0": 5})
    assert sample.stable_limit(df, 0, "s").count() == 0 and sample.stable_limit(df, 99, "s").count() == 5
    first = [r.id for r in sample.stable_limit(df, 3, "s").collect()]
    assert first == [r.id for r in sample.stable_limit(df.orderBy(F.desc("id")), 3, "s").collect()]


def test_bands_without_a_name_take_no_turn(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "B0")], "id string, band string").withColumn("alpha_hash", F.col("id"))
    assert [r.id for r in sample.round_robin(df, 3, "s").collect()] == ["c"]


def test_exact_splits(spark):
    df = records(spark, {"B0": 6, "B1": 6, "B2": 6, "gold": 2})
    out = split.exact_splits(df, {"train": 12, "dev": 3, "test": 3}, golden="gold")
    got = {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 12, "dev": 3, "test": 3, "gold": 2}
    with pytest.raises(ValueError):
        split.exact_splits(df, {"train": 1})


def test_allocate():
    assert split.allocate({"a": 5, "b": 5, "c": 1}, 6) == {"a": 3, "b": 3, "c": 0}
    assert split.allocate({}, 0) == {}
    with pytest.raises(ValueError):
        split.allocate({"a": 1}, 2)


def test_numbered_is_row_number(spark):
    df = records(spark, {"B0": 700, "B1": 3}).withColumn("_rank", F.sha2("alpha_hash", 256))
    rows = split.numbered(df, "band", "id").collect()
    for band in ("B0", "B1"):
        own = sorted((r for r in rows if r.band == band), key=lambda r: (r._rank, r.id))
        assert [r._rn for r in own] == list(range(1, len(own) + 1))


def admission_model(rows, quotas):
    seen, taken, out = set(), defaultdict(int), {}
    for key, band, h, seed in sorted(rows, key=lambda r: (r[3], r[1])):
        if taken[band] >= quotas.get(band, 0):
            out[key] = "quota_reached"
        elif h in seen:
            out[key] = "duplicate"
        else:
            out[key] = None
            seen.add(h)
            taken[band] += 1
    return out


@pytest.mark.parametrize("across", [False, True])
def test_admission(spark, across):
    r = random.Random(5)
    rows = [(f"{b}{i}", b, f"{'' if across else b}{r.randint(0, 8)}", i) for b in ("B0", "B1", "B2") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, band string, alpha_hash string, seed long")
    quotas = {"B0": 3, "B1": 6, "B2": 30}
    out = admit.admit(df, quotas)
    assert {x.id: x.reason for x in out.collect()} == admission_model(rows, quotas)
    taken = [x.ordinal for x in out.where("status = 'accepted'").collect()]
    assert sorted(taken) == list(range(1, len(taken) + 1))


def test_admission_of_many(spark):
    """More keys than the quotas let the ordered pass see, keys in several bands, a band without a quota, null keys."""
    r = random.Random(9)
    rows = [(f"x{i}", r.choice(["B0", "B1", "B2", "B9"]), r.choice([None, *(f"k{j}" for j in range(60))]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, band string, alpha_hash string, seed long")
    for quotas in ({"B0": 5, "B1": 2, "B2": 9}, {"B0": 30, "B1": 30, "B2": 30}, {"B1": 0}, {}):
        assert {x.id: x.reason for x in admit.admit(df, quotas).collect()} == admission_model(rows, quotas)


def test_places_and_novelty(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, r.choice("abcdefgh") + r.choice(["", "x"]) * r.randint(0, 4)) for i in r.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "pos long, k string").repartition(5)
    ordered = sorted(rows)
    got = {x.pos: x.at for x in order.numbered(df, ["pos"], "at", 7).collect()}
    assert got == {p: i for i, (p, _) in enumerate(ordered)}
    assert {x.pos: x.at for x in order.numbered(df, ["k", "pos"], "at").collect()} == {p: i for i, (k, p) in enumerate(sorted((k, p) for p, k in rows))}
    for run, trailing in ((10, 40), (100, 40), (64, 1), (10**6, 1000)):
        monkeypatch.setattr(admit, "RUN", run)
        out = {x.pos: (x.first_seen, round(x.novelty, 9)) for x in admit.novelty(df, "k", ["pos"], trailing).collect()}
        seen, flags, want = set(), [], {}
        for p, k in ordered:
            flags.append(int(k not in seen))
            seen.add(k)
            last = flags[-trailing:]
            want[p] = (flags[-1], round(sum(last) / len(last), 9))
        assert out == want
    assert order.numbered(df.limit(0), ["pos"], "at").count() == 0
    down = order.numbered(df, [F.desc("k"), "pos"], "at", 3).collect()
    assert {x.pos: x.at for x in down} == {p: i for i, (p, _) in enumerate(sorted(sorted(rows), key=lambda x: x[1], reverse=True))}


def test_dedupe_and_upsert(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 3), (4, None, 4)], "pos int, k string, v int")
    assert sorted(r.pos for r in dedupe.keep_first(df, ["k"], ["pos"]).collect()) == [1, 3]
    assert sorted(r.pos for r in dedupe.keep_last(df, ["k"], ["pos"]).collect()) == [2, 4]
    new = spark.createDataFrame([(1, "z", 9), (7, "y", 9)], "pos int, k string, v int")
    assert sorted((r.pos, r.v) for r in dedupe.upsert(df, new, ["pos"]).collect()) == [(1, 9), (2, 2), (3, 3), (4, 4), (7, 9)]
    assert dedupe.union_first([df, new], ["pos"]).where("pos = 1").first().v == 1


def test_report_of_nothing(spark):
    df = spark.createDataFrame([], "band string, exact_match boolean, assemblable boolean, functional boolean, per_card_exact double, normalized_edit_distance double")
    rows = report.bucket_report(df, ["band"]).collect()
    assert [(r.dim, r.n, r.exact_match) for r in rows] in ([], [("overall", 0, 0.0)])


def test_timings(spark):
    df = spark.createDataFrame([(2.0, 0.5), (4.0, 1.5), (6.0, 2.5), (None, None)], "g double, e double").withColumn("k", F.lit(1))
    g, e = report.timing_stats(df, "g", ["k"]).first(), report.timing_stats(df, "e", ["k"]).first()
    t = report.timing_stats(df.withColumn("t", F.col("g") + F.col("e")), "t", ["k"]).first()
    assert (g.median, e.mean, t.median, g.n) == (4.0, 1.5, 5.5, 3)


def test_medians_of_a_hot_group(spark):
    """Most rows are in one group, most of these alike; unrounded values, null groups and values."""
    from statistics import median

    r = random.Random(8)
    rows = [("hot", r.choice([0.1, 0.1, 0.1, r.random()])) for _ in range(3001)] + [(r.choice(["a", "b", None]), r.choice([None, r.random()])) for _ in range(60)] + [("none", None)]
    want = {}
    for k, v in rows:
        want.setdefault(k, [])
        want[k] += [] if v is None else [v]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x.k: (x.n, x["median"]) for x in report.timing_stats(df, "v", ["k"]).collect()}
    assert got == {k: (len(v), median(v) if v else None) for k, v in want.items()}
    assert report.timing_stats(df.limit(0), "v", ["k"]).count() == 0
    assert report.timing_stats(df, "v", []).first()["median"] == median(v for _, v in rows if v is not None)


def test_fill_keeps_types(spark):
    jobs = spark.createDataFrame([("a", None, ""), ("b", 7, "x"), ("c", 0, None)], "key string, n long, name string")
    meta = spark.createDataFrame([("a", 3, "m"), ("b", 4, None), ("c", 5, "z")], "key string, n int, name string")
    got = monitor.fill_from(jobs, meta, "key", ["n", "name"])
    assert got.schema == jobs.schema
    assert {x.key: (x.n, x.name) for x in got.collect()} == {"a": (3, "m"), "b": (7, "x"), "c": (0, "z")}


def test_selection(spark):
    df = spark.createDataFrame([("a", 0.65, 0.45, 0.84, 0.97), ("b", 0.6, 0.4, 0.86, 0.99), ("c", 0.9, 0.9, 0.9, 0.5)], "run string, functional double, exact_match double, per_card_exact double, assemblability double")
    s = df.withColumn("s", review.selection_score())
    pair = s.alias("x").crossJoin(s.alias("y")).select(F.col("x.run").alias("p"), F.col("y.run").alias("q"), review.compare_scores(F.col("x.s"), F.col("y.s")).alias("r"))
    got = {(r.p, r.q): r.r for r in pair.collect()}
    assert got["a", "b"] == 1 and got["b", "a"] == -1 and got["a", "a"] == 0 and got["c", "b"] == -1 and got["c", "c"] == 0


def test_representatives(spark):
    r = random.Random(3)
    rows = [(f"c{i:02d}", r.choice(["x", "y", "z"]), r.random(), r.randint(0, 9), r.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, category string, normalized_edit_distance double, diff_count int, per_card_exact double")
    worst = sorted(rows, key=lambda c: (c[2], c[3], 1 - c[4], c[0]), reverse=True)
    chosen = [c for cat, n in (("x", 3), ("y", 2)) for c in [w for w in worst if w[1] == cat][:n]]
    chosen += [w for w in worst if w not in chosen][: 10 - len(chosen)]
    got = [x.id for x in review.representatives(df, [("x", 3), ("y", 2)], review.case_order(), 10).collect()]
    assert got == [c[0] for c in sorted(chosen, key=lambda c: (c[2], c[3], 1 - c[4], c[0]), reverse=True)[:10]]


def test_zero_fill_and_grid(spark):
    some = spark.createDataFrame([("b", 2)], "category string, n long")
    assert [(r.category, r.n) for r in report.zero_filled(some, ["a", "b"]).orderBy("ord").collect()] == [("a", 0), ("b", 2)]
    assert report.grid(spark, a=[1, 2], b=["x"]).count() == 2


def test_sft(spark):
    df = spark.createDataFrame([("p", "c", "1", "B0"), ("p", "c", "2", "B9")], "p string, c string, id string, band string")
    out = sft.sft_rows(df, F.col("p"), F.col("c"), {"B0": 3, "B1": 0})
    assert sorted((r.id, r.repeat_index) for r in out.collect()) == [("1", 0), ("1", 1), ("1", 2), ("2", 0)]
    assert sft.parse_band_numbers("B0=2, b1=3") == {"B0": 2, "B1": 3} and sft.parse_bands(" b1, B3,") == ["B1", "B3"]
    with pytest.raises(ValueError):
        sft.parse_bands(" , ")


def test_retrieval(spark):
    q = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon zeta eta"), (3, "nothing shared")], "query_id int, text string")
    e = spark.createDataFrame([(10, "alpha beta gamma"), (9, "alpha beta gamma"), (11, "delta epsilon zeta theta"), (12, "delta x")], "example_id int, text string")
    got = {r.query_id: (r.example_id, r.score) for r in retrieve.nearest(q, e).collect()}
    assert got[1] == (9, 1.0) and got[2][0] == 11 and got[3][0] == 11
    shots = retrieve.few_shot(e, 2, ["example_id"]).first().shots
    assert [s.example_id for s in shots] == [9, 10]


@pytest.mark.parametrize("mode, grams", [("compat", 0), ("compat", 8), ("levenshtein", 0), ("levenshtein", 4)])
def test_nearest_of_all_examples(spark, monkeypatch, mode, grams):
    """Against a comparison of every pair, in several blocks of queries; ties go to the larger id, null texts match nothing."""
    import difflib

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, left[j] + 1, left[j - 1] + (x != y)))
        return row[-1]

    def score(a, b):
        return difflib.SequenceMatcher(a=a, b=b).ratio() if mode == "compat" else 1 - levenshtein(a, b) / max(len(a), len(b), 1)

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    examples = [(i, " ".join(word() for _ in range(r.randint(1, 8)))) for i in range(60)]
    examples += [(100 + i, t) for i, t in examples[:10]]
    queries = [(i, r.choice([" ".join(word() for _ in range(4)), examples[i][1], examples[i][1] + " x"])) for i in range(20)] + [(99, None), (98, ""), (97, "zzz")]
    monkeypatch.setattr(retrieve, "QUERIES", 8)
    q = spark.createDataFrame(queries, "query_id int, text string")
    e = spark.createDataFrame([*examples, (500, None)], "example_id int, text string")
    got = {x.query_id: (x.example_id, round(x.score, 9)) for x in retrieve.nearest(q, e, grams=grams, mode=mode).collect()}
    want = {}
    for i, t in queries[:-3] + queries[-2:]:
        same = [j for j, x in examples if x == t]
        best = max((score(t, x), j) for j, x in examples)
        want[i] = (min(same), 1.0) if same else (best[1], round(best[0], 9))
    assert got == want


def test_monitor(spark):
    jobs = spark.createDataFrame([("k1", "", "p1"), ("k2", "x", None)], "key string, name string, pod string")
    meta = spark.createDataFrame([("k1", "old", 1), ("k1", "new", 2), ("k2", "y", 1)], "key string, name string, pos int")
    assert {r.key: r.name for r in monitor.fill_from(jobs, meta, "key", ["name"], ["pos"]).collect()} == {"k1": "new", "k2": "x"}
    assert {r.key: r.name for r in monitor.fill_from(jobs, meta, "key", ["name"], ["pos"], force=True).collect()} == {"k1": "new", "k2": "y"}
    pods = spark.createDataFrame([("p1", "zzz", "A"), ("p2", "x", "B")], "pid string, pname string, gpu string")
    assert {r.key: r.gpu for r in monitor.prioritised(jobs, pods, ("pod", "pid"), ("name", "pname"), ["gpu"]).collect()} == {"k1": "A", "k2": "B"}

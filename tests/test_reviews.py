"""Composed reviews, archives, phases, command lines, curriculum, stages and the command line."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.functions import taxonomy as X
from millrace.functions import text as T
from millrace.functions import tokens
from millrace.operators import monitor, report
from millrace.plans import corpus, curriculum, reviews
from millrace.sources import oracle, records, sinks

PREDICTION = (
    "id string, band string, failure_type string, exact_match boolean, per_card_exact double, normalized_edit_distance double, assemblable boolean, functional boolean, "
    "candidate_cards array<string>, pos long"
)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    refs, preds = [], []
    for k in range(80):
        deck = [f"{i:04d} {r.choice('xyz')} {r.randrange(99)}" for i in range(20)]
        features = r.sample(["goto", "iterate", "punch"], r.randint(0, 2))
        refs.append((f"r{k:02d}", deck, features))
        other = list(deck)
        for _ in range(r.randint(0, 3)):
            other[r.choice([0, 3, 9, 15, 18, 19])] = r.choice(["  " + deck[0], "a 1 2", "tra 5", "4         a", "x s00", "zzz"])
        exact = other == deck
        there = r.random() < 0.85
        kind = "exact_match" if exact and there else r.choice(["assembles_but_misexecutes", "unassemblable_output", None])
        preds.append((f"r{k:02d}" if k % 11 else f"q{k}", f"B{1 + k % 3}", kind, exact if there else None, r.random(), r.random(), r.choice([True, False, None]), r.choice([True, False, None]), other if there else None, k))
    return spark.createDataFrame(preds, PREDICTION).cache(), spark.createDataFrame(refs, "id string, reference_cards array<string>, features array<string>").cache()


def worst_first(rows):
    return sorted(rows, key=lambda r: (r["normalized_edit_distance"], r["diff_count"], 1 - r["per_card_exact"], r["id"]), reverse=True)


def plain_cases(tables, keep):
    preds, refs = ({r.id: r.asDict() for r in t.collect()} for t in tables)
    out = []
    for p in preds.values():
        if p["id"] in refs and keep(p):
            deck, other = refs[p["id"]]["reference_cards"], p["candidate_cards"]
            diffs = [] if other is None else [i for i in range(max(len(deck), len(other))) if deck[i : i + 1] != other[i : i + 1]]
            out.append(p | {"features": refs[p["id"]]["features"], "diffs": diffs, "deck": deck})
    return out


def test_tail_review(spark, tables):
    found = reviews.tail_review(*tables)
    want = plain_cases(tables, lambda p: p["band"] == "B1" and not p["exact_match"] and p["candidate_cards"] is not None)
    got = {r.id: r for r in found.cases.collect()}
    assert {i: (r.diff_count, r.first_diff_index) for i, r in got.items()} == {w["id"]: (len(w["diffs"]), w["diffs"][0] if w["diffs"] else None) for w in want}
    counts = [(r.category, r.n) for r in found.counts.orderBy("ord").collect()]
    assert [c for c, _ in counts] == X.TAIL_CATEGORIES and Counter(r.category for r in got.values()) == Counter({c: n for c, n in counts if n})
    rows = worst_first([r.asDict() for r in got.values()])
    chosen = [r for c, n in reviews.review.TAIL_PLAN for r in [x for x in rows if x["category"] == c][:n]]
    chosen += [r for r in rows if r not in chosen][: max(0, 10 - len(chosen))]
    want_names = [f"{k:04d}_{r['id']}" for k, r in enumerate(worst_first(chosen)[:10], 1)]
    assert [r.name for r in found.chosen.orderBy("name").collect()] == want_names


def test_band_review(spark, tables, tmp_path):
    bands = ["B2", "B3"]
    found = reviews.band_review(*tables, bands)
    want = plain_cases(tables, lambda p: p["band"] in bands and p["failure_type"] != "exact_match")
    got = {r.id: r for r in found.cases.collect()}
    assert set(got) == {w["id"] for w in want}
    for w in want:
        diffs = [d for d in w["diffs"] if not (d == 0 and w["candidate_cards"][0].lstrip() == w["deck"][0].lstrip())]
        assert got[w["id"]].diff_count == len(diffs) and (got[w["id"]].category == "candidate_missing") == (w["candidate_cards"] is None)
    features = Counter((w["band"], f) for w in want for f in w["features"])
    assert {(r.band, r.feature): r.n for r in found.features.collect()} == dict(features)
    rows = worst_first([r.asDict() for r in got.values()])
    chosen = [r for b in bands for r in [x for x in rows if x["band"] == b][:4]]
    for c, n in reviews.review.BAND_PLAN:
        chosen += [r for r in rows if r["category"] == c and r not in chosen][:n]
    chosen += [r for r in rows if r not in chosen][: max(0, 12 - len(chosen))]
    assert [r.name for r in found.chosen.orderBy("name").collect()] == [f"{k:04d}_{r['id']}" for k, r in enumerate(worst_first(chosen), 1)]
    text = reviews.write_review(found, f"file://{tmp_path}/review", "B2/B3 Failure Review", X.BAND_CATEGORIES, bands, ["More."])
    assert f"- Non-exact cases: {len(want)}" in text and "## Feature Footprint" in text and text.count("diff_count=") == len(chosen)


@pytest.mark.parametrize("limit", [None, 5])
def test_failure_archive(spark, tables, limit):
    want = sorted(plain_cases(tables, lambda p: p["failure_type"] not in (None, "exact_match")), key=lambda p: p["pos"])[:limit]
    cases = reviews.failure_cases(*tables, ["pos"], limit)
    assert sorted(r.name for r in cases.collect()) == [f"{k:04d}_{w['id']}" for k, w in enumerate(want, 1)]
    assert {r.failure_type: r.n for r in reviews.failure_manifest(cases).collect()} == {None: len(want)} | Counter(w["failure_type"] for w in want)


def test_sinks(spark, tmp_path):
    top = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "train"), (2, "dev"), (3, "train")], "id long, split string")
    assert sinks.write_splits(df, f"{top}/s") == {"train": 2, "dev": 1, "test": 0, "golden": 0, "adversarial_test": 0}
    assert sorted(r.id for r in spark.read.json(f"{top}/s/train").collect()) == [1, 3]
    with pytest.raises(ValueError):
        sinks.write_splits(df, f"{top}/s", names=("train",))
    assert [sinks.append_new(df, f"{top}/a", "id"), sinks.append_new(df.unionByName(df.selectExpr("id + 9 as id", "split")), f"{top}/a", "id"), spark.read.parquet(f"{top}/a").count()] == [3, 3, 6]
    (tmp_path / "x.txt").write_text("hello")
    assert sinks.copy_files(spark, [f"{top}/x.txt", f"{top}/none.txt"], f"{top}/copy") == [f"{top}/copy/x.txt"] and sinks.read_text(spark, f"{top}/copy/x.txt") == "hello"


def test_training_report(spark, tmp_path):
    rows = [("zero_shot", True, "exact_match"), ("zero_shot", False, None), ("fine_tuned", True, "exact_match"), ("other", True, "x")]
    scored = spark.createDataFrame(rows, "mode string, exact_match boolean, failure_type string").withColumns({"assemblable": F.col("exact_match"), "functional": F.col("exact_match"), "per_card_exact": F.lit(0.5), "normalized_edit_distance": F.lit(0.25)})
    got = {r["mode"]: r for r in reviews.mode_rates(scored).collect()}
    assert set(got) == {"zero_shot", "fine_tuned"} and got["fine_tuned"].delta_exact_match == 0.5 and got["zero_shot"].delta_exact_match is None
    assert got["zero_shot"].failures == {"exact_match": 1, "unclassified": 1}
    scored.write.parquet(f"file://{tmp_path}/s")
    (tmp_path / "t.json").write_text('{"train_examples": 9}')
    cli.main(["write-research-report", "--predictions", f"file://{tmp_path}/s", "--training", f"file://{tmp_path}/t.json", "--output", f"file://{tmp_path}/r.md"], spark)
    text = (tmp_path / "r.md").read_text()
    assert "- train_examples: 9" in text and "exact=0.500, assemblability=0.500" in text and "- exact_match: value=1.0, delta_vs_zero_shot=0.5" in text and "### few_shot" in text
    assert "delta" not in reviews.training_report(scored.where("mode = 'fine_tuned'"), "x", {}).split("## Baseline Delta")[1]


def test_saved_jobs_manifests_and_dataset_archives(spark, tmp_path):
    top = f"file://{tmp_path}"
    for k, body in enumerate(['{"local_output": "a", "name": "old", "limit": 3}', '{"local_output": "a", "name": "new", "status": "running"}', "{broken", '{"name": "none"}', '{"local_output": "b"}']):
        (tmp_path / "jobs" / f"j{k}").mkdir(parents=True)
        (tmp_path / "jobs" / f"j{k}" / ".runpod_job.json").write_text(body)
    got = {r.local_output: r for r in records.job_metadata(spark, f"{top}/jobs").collect()}
    assert set(got) == {"a", "b"} and (got["a"].name, got["a"].status, got["a"].limit) == ("new", "running", None)
    df = spark.createDataFrame([(i, f"t{i}", None) for i in range(20)], "id long, text string, other string")
    folder = sinks.archive_dataset({"train": df, "dev": df.limit(3)}, ["id", "text"], f"{top}/arch")
    assert sinks.archive_dataset({"dev": df.limit(3), "train": df.repartition(3)}, ["id", "text"], f"{top}/arch") == folder
    assert sinks.archive_dataset({"train": df.where("id > 0"), "dev": df.limit(3)}, ["id", "text"], f"{top}/arch") != folder
    assert records.read_manifest(spark, f"{folder}/manifest.json")["rows"] == {"dev": 3, "train": 20} and spark.read.parquet(f"{folder}/train").columns == ["id", "text"]
    with pytest.raises(FileNotFoundError):
        records.read_manifest(spark, f"{top}/none.json")


def test_report_pieces(spark):
    df = spark.createDataFrame([(3, "b", "z"), (1, "b", None), (2, "b", ""), (4, "a", "q"), (5, "a", "r")], "pos int, k string, mode string")
    assert {r.k: r.mode for r in report.first_value(df, "mode", ["pos"], ["k"]).collect()} == {"a": "q", "b": "z"} and report.first_value(df, "mode", ["pos"]).first().mode == "z"
    chunks = report.amortised(report.chunked(df, ["pos"], 2).withColumn("s", F.lit(6.0)), "chunk", "s", "each")
    assert {r.pos: (r.chunk, r.each) for r in chunks.collect()} == {1: (0, 3.0), 2: (0, 3.0), 3: (1, 3.0), 4: (1, 3.0), 5: (2, 6.0)}
    row = spark.sql("select timestamp'2024-01-02 03:04:05.5' as a, timestamp'2024-01-02 03:04:07' as b")
    got = row.select(report.elapsed("a", "b").alias("e"), report.iso_seconds("a").alias("i"), report.total_seconds(F.lit(1.5), F.lit(None)).alias("t")).first()
    assert (got.e, got.i, got.t) == (1.5, "2024-01-02T03:04:05Z", 1.5)
    modes = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.1)], "mode string, exact_match double")
    assert [(r.mode, r.exact_match) for r in report.mode_metrics(modes, ["a", "b"], ("exact_match",)).collect()] == [("a", 0.5)]
    assert [T.rate_slug(x) for x in (0.0002, 1e-5, 2.0)] == ["0p0002", "1em05", "2"]
    cards = spark.createDataFrame([("x 1234 60 0001 0002 ",), ("1234 6 0001 0002",), (None,)], "c string")
    assert [r.o for r in cards.select(T.symbolic_location("c").alias("o")).collect()] == [1234, None, None]


def test_phases(spark):
    base = {"error": None, "status": None, "progress": None, "process": None, "bootstrap_process": None, "training": None, "repo_exists": True, "output_exists": True, "active_process": False, "phase": None}
    p = lambda **m: {k: {"lines": a, "expected": b} for k, (a, b) in m.items()}
    cases = [
        (None, None, None), (base | {"error": "x"}, "failed", None), (base | {"status": "failed"}, "failed", None), (base | {"progress": p(few_shot=(2, 9))}, "remote_generate", "few_shot"),
        (base | {"process": "python -m x.cli run-inference --a"}, "remote_generate", None), (base | {"process": "cli overfit-sanity"}, "remote_train", None),
        (base | {"training": {"current": 3, "total": 9}}, "remote_train", "train 3/9"), (base | {"bootstrap_process": "pip install z"}, "remote_bootstrap", None),
        (base | {"repo_exists": False}, "remote_bootstrap", None), (base | {"output_exists": None}, "remote_train", None), (base | {"active_process": True}, "training", "training"),
        (base | {"progress": p(fine_tuned=(0, 9))}, "remote_complete", None), (base, "remote_complete", None),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], f"i int, r {monitor.REMOTE}")
    got = rows.select("i", monitor.remote_phase("r").alias("p"), monitor.remote_step("r").alias("s")).orderBy("i").collect()
    assert [(x.p, x.s) for x in got] == [c[1:] for c in cases]
    jobs = [
        (base | {"active_process": True, "phase": "remote_eval"}, "failed", True, None, None, "remote_eval"), (base | {"active_process": True}, None, True, None, None, "remote_generate"),
        (None, "complete", False, None, 5, "complete"), (None, None, False, None, 5, "remote_bootstrap"), (None, "pending", False, None, None, "launching"),
        (base | {"error": "e"}, None, True, None, None, "failed"), (base, None, False, True, None, "local_reevaluate"), (base, None, False, None, None, "remote_generate"),
    ]
    rows = spark.createDataFrame([(i, *j[:5]) for i, j in enumerate(jobs)], f"i int, r {monitor.REMOTE}, l string, d boolean, s boolean, a bigint")
    assert [x.p for x in rows.select("i", monitor.job_phase("r", "l", "d", "s", "a").alias("p")).orderBy("i").collect()] == [j[5] for j in jobs]
    outputs = [("failed", True, 3, 3, "failed"), ("running", True, 3, 3, "local_reevaluate"), (None, True, 3, 3, "complete"), (None, False, 1, 3, "local_reevaluate"), (None, False, 0, 3, "pending")]
    rows = spark.createDataFrame([(i, *o) for i, o in enumerate(outputs)], "i int, s string, e boolean, r int, x int, want string")
    assert rows.where(monitor.output_phase("s", "e", "r", "x") != F.col("want")).count() == 0
    assert [spark.range(1).select(monitor.phase_class(F.lit(x)).alias("c")).first().c for x in ("complete", "remote_train", "failed", "launching")] == ["good", "accent", "bad", "warn"]


def test_process_lists(spark):
    lines = [
        "  12  01:02:03 python /x/run_job.py --name 'a b' --run-mode few --limit 5 --detach-remote --max-examples 7", "bad line", "13 00:01 python other.py --name z",
        "14 10:00 python run_job.py stray --name one --name two --pod-id p1 --local-output out/x y",
    ]
    got = {r.pid: r for r in monitor.process_table(spark.createDataFrame([(x,) for x in lines], "value string"), "run_job.py").collect()}
    assert set(got) == {12, 14} and (got[12].name, got[12].run_mode, got[12].limit, got[12].example_count, got[12].detached) == ("a b", "few", 5, 7, True)
    assert (got[14].name, got[14].pod_id_arg, got[14].local_output, got[14].detached) == ("two", "p1", "out/x y", False)
    saved = spark.createDataFrame([("out/x", "running"), ("out/z", None), ("out/q", "complete"), (None, "running")], "local_output string, status string")
    active = spark.createDataFrame([("out/x",)], "local_output string")
    assert [r.local_output for r in monitor.detached(saved, active).collect()] == ["out/z"]


def test_waiting_and_snapshots():
    now, made = [0.0], []
    asked = iter([None, None, "ready"])
    assert monitor.wait_until(lambda: next(asked), 100, 10, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)) == "ready" and now[0] == 20
    with pytest.raises(TimeoutError):
        monitor.wait_until(lambda: None, 25, 10, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    snap = monitor.Snapshot(lambda: made.append(1) or len(made), 5, lambda: now[0])
    assert [snap.get(), snap.get()] == [1, 1]
    now[0] += 5
    assert snap.get() == 2


def test_curriculum(spark, tmp_path):
    rows = spark.createDataFrame([(f"{b}{i}", f"B{b}", f"h{b}{i}") for b in range(3) for i in range(60)], "id string, band string, alpha_hash string")
    steps = [curriculum.Step(20, 6, {"B0": 4}), curriculum.Step(40, 9, {"B0": 4, "B1": 4})]
    counts = curriculum.prepare(steps, rows, [rows.where("id like '%1'"), rows.where("id like '%2'")], f"file://{tmp_path}/d", "s")
    got = {(r.slug, r.part, r.band): r.n for r in counts.collect()}
    assert got["s20_b0_e6", "train", "B0"] == 14 and got["s20_b0_e6", "eval", "B1"] == 2 and got["s40_b0_b1_e9", "train", "B2"] == 4
    assert [s.slug for s in curriculum.STEPS][1] == "s300_b0_b1_e36"
    tried = []

    def work(step, folder):
        tried.append(step.slug)
        if len(tried) == 2:
            raise OSError("lost")
        return {"train": step.train}

    target = f"file://{tmp_path}/runs"
    with pytest.raises(OSError):
        curriculum.run(spark, steps, target, work)
    assert json.loads(sinks.read_text(spark, f"{target}/manifest.json"))[1]["status"] == "failed"
    assert [d["status"] for d in curriculum.run(spark, steps, target, work)] == ["kept", "complete"] and tried == ["s20_b0_e6", "s40_b0_b1_e9", "s40_b0_b1_e9"]


def test_stages(spark):
    assert oracle.render("{% if a %}x {{ a }}{% else %}none{% endif %} {{ b }}", {"a": 5, "b": "z"}) == "x 5 z" and oracle.render("{% if a %}x{% endif %}y", {}) == "y"
    with pytest.raises(KeyError):
        oracle.render("{{ c }}", {})
    upper = ["sh", "-c", "tr a-z A-Z < {input} > {output}; if grep -q bad {input}; then echo 'acc 12-'; else echo acc 0; fi"]
    rows = spark.createDataFrame([("good", "\n".join(f"l{i}" for i in range(12))), ("short", "l1\nl2"), ("wrong", "bad\n" * 12), ("empty", "")], "id string, source string")
    commands = {"translate": upper, "assemble": ["sh", "-c", "cat {input} > {output}"], "run": ["sh", "-c", "echo {steps} > {output}; grep -c . {input} >> {output}"]}
    got = {r.id: r for r in oracle.pipeline(rows, commands, ["dict"], ["load"], steps="9M").collect()}
    assert {k: r.status for k, r in got.items()} == {"good": "ok", "short": "skipped", "wrong": "compile_error", "empty": "compile_error"}
    good = got["good"]
    assert (good.upper_acc, got["wrong"].upper_acc, good.translate_log.strip(), got["short"].run_log) == (0, -12, "acc 0", None) and good.pit_raw.startswith("L0\n")
    assert good.reservation_cards == [f"L{i}" for i in range(2, 12)] and good.phase2_cards == [*good.reservation_cards, "dict", "L0", "L1"] and good.output_cards == ["9M", "14"]


def test_records(spark):
    made = corpus.candidates(spark, {"B1": 1}, 3).withColumn("pit_hash", F.lit("p"))
    out = corpus.records(made)
    assert {f.name for f in out.schema} == {f.name for f in spark.createDataFrame([], records.REFERENCE).schema}
    row = out.first()
    assert len(row.id) == 64 and row.source.header.n_pkg == 265 and row.hashes.alpha_hash and row.generator.features
    assert row.reference.translate.reservation_cards is None and row.provenance.simh_source is None
    deck = made.withColumns({"pit_cards": F.array(*(F.lit(f"c{i}") for i in range(11))), "translate_log": F.lit("acc 0"), "run_log": F.lit("r")})
    row = corpus.records(oracle.assembly_input(deck, ["d"]), provenance={"simh_source": "s", "normalizer_version": "n"}).first()
    t = row.reference.translate
    assert t.translation_body == "c0\n" and t.reservation_cards.split() == [f"c{i}" for i in range(1, 11)] and (t.stdout_log, t.console_log) == ("acc 0", None)
    assert row.reference.assemble.pit_phase2_input_p1.endswith("c10\nd\nc0\n") and row.reference.run.stdout_log == "r"
    assert (row.provenance.simh_source, row.provenance.normalizer_version, row.provenance.generator_version) == ("s", "n", None)


def test_tokens(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer(tokenizers.models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    model.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    model.save(f"{tmp_path}/t.json")
    df = spark.createDataFrame([("a b", "b"), ("a a a a", "b"), (None, "a")], "prompt string, completion string")
    assert [r.n for r in df.select(tokens.n_tokens("prompt", f"{tmp_path}/t.json").alias("n")).collect()] == [2, 4, None]
    rows = tokens.training_rows(df, f"{tmp_path}/t.json", 4, end=" ?").collect()
    assert [(list(r.input_ids), list(r.labels)) for r in rows] == [([0, 1, 1, 2], [-100, -100, 1, 2])]


def test_command_line(spark, tables, tmp_path):
    top = f"file://{tmp_path}"
    tables[0].write.json(f"{top}/p.json")
    tables[1].write.parquet(f"{top}/r")
    run = lambda *words: cli.main(list(words), spark)
    assert "# B1 Failure Review" in run("review-b1-failures", "--predictions", f"{top}/p.json", "--references", f"{top}/r", "--output", f"{top}/b1")["report"]
    manifest = run("archive-failures", "--predictions", f"{top}/p.json", "--references", f"{top}/r", "--limit", "4", "--order", "pos", "--output", f"{top}/a")
    assert manifest["count"] == 4 and json.loads(sinks.read_text(spark, f"{top}/a/manifest.json")) == manifest
    made = run("build-pilot-corpus", "--bands", "B0=4,B1=3", "--output", f"{top}/c")
    assert made["bands"] == {"B0": 4, "B1": 3} and sum(made["splits"].values()) == 7
    run("generate-sample", "--band", "B2", "--count", "3", "--output", f"{top}/g")
    run("build-record", "--input", f"{top}/g", "--output", f"{top}/rec")
    assert spark.read.parquet(f"{top}/rec").count() == 3
    (tmp_path / "ps.txt").write_text("7 00:10 python job.py --name x\n")
    assert run("dashboard", "--processes", f"{top}/ps.txt", "--script", "job.py")["jobs"][0]["name"] == "x"
    assert len(cli.COMMANDS) >= 24
    with pytest.raises(SystemExit):
        run("nothing")

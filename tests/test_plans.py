from pyspark.sql import functions as F

from millrace.plans import corpus, evaluate


def test_stage_quotas(spark):
    s = corpus.stage(spark, "2k")
    assert s.bands == {"B0": 200, "B1": 500, "B2": 400, "B3": 400, "B4": 300, "B5": 200} and s.splits == {"dev": 200, "test": 200, "train": 1600}
    for name, (total, _) in corpus.STAGES.items():
        assert sum(corpus.stage(spark, name).bands.values()) == total


def test_fair_scheduler():
    quotas = {"B0": 2, "B1": 2}
    assert corpus.next_band({}, quotas) == "B0" and corpus.next_band({"B0": (1, 1)}, quotas) == "B1"
    assert corpus.next_band({"B0": (2, 2), "B1": (9, 1)}, quotas) == "B1" and corpus.next_band({"B0": (2, 2), "B1": (9, 2)}, quotas) is None


def test_corpus_and_resume(spark):
    quotas = {"B0": 6, "B1": 4, "B5": 3}
    made = corpus.candidates(spark, quotas, 12).withColumn("id", F.concat("band", F.lit("-"), "seed")).cache()
    accepted, rejected = corpus.build(made, quotas)
    assert {r.band: r.n for r in accepted.groupBy("band").agg(F.count("*").alias("n")).collect()} == quotas
    assert accepted.count() + rejected.count() == made.count() and accepted.select("alpha_hash").distinct().count() == 13
    first = accepted.where("seed <= 2").cache()
    again, _ = corpus.build(made.where("seed > 2"), quotas, first.drop("ordinal"))
    assert {(r.band, r.seed) for r in again.collect()} == {(r.band, r.seed) for r in accepted.collect()}
    parts = corpus.split_corpus(accepted, {"train": 9, "dev": 2, "test": 2})
    assert {r.split: r.n for r in parts.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 9, "dev": 2, "test": 2}
    assert corpus.split_corpus(accepted).count() == 13
    bad = made.withColumn("status", F.when(F.col("seed") == 1, "compile_error").otherwise("ok"))
    ok, no = corpus.build(bad, quotas, status="status")
    assert ok.where("seed = 1").count() == 0 and no.where("reason = 'compile_error'").count() == 3


def test_reevaluation(spark):
    deck, out = [f"{k} card" for k in range(12)], ["7"]
    refs = spark.createDataFrame([(k, deck, out) for k in "abcdef"], "id string, reference_cards array<string>, reference_output array<string>")
    other = [*deck[:11], "x"]
    preds = spark.createDataFrame([
        ("a", deck, "ok", "ok", out), ("b", deck, "assemble_error", None, None), ("c", deck, "ok", "ok", ["8"]), ("d", other, "ok", "ok", out), ("e", None, None, None, None),
        ("f", deck[:5], "ok", "ok", out), ("z", deck, "ok", "ok", out),
    ], "id string, candidate_cards array<string>, assemble_status string, run_status string, output_cards array<string>")
    rows = {r.id: r for r in evaluate.reevaluate(preds, refs).collect()}
    assert rows["a"].failure_type == "exact_match" and rows["a"].functional and rows["a"].normalized_edit_distance == 0.0
    assert rows["b"].evaluator_invariant == "exact_match_failed_to_assemble" and rows["b"].failure_type == "evaluator_invariant_failure"
    assert rows["c"].evaluator_invariant == "exact_match_failed_functional_check"
    assert rows["d"].failure_type == "functional_success_exact_failure" and rows["d"].per_card_exact == 11 / 12
    assert rows["e"].assemble_status == "candidate_missing" and rows["e"].normalized_edit_distance == 1.0
    assert rows["f"].assemble_status == "precheck_skipped" and rows["f"].failure_type == "malformed_pit_card"
    assert rows["z"].failure_type is None and rows["z"].exact_match is None
    scored = evaluate.reevaluate(preds, refs).withColumn("band", F.lit("B1"))
    tables = evaluate.full_report(scored, ["band"])
    assert tables["rates"].where("dim = 'overall'").first().n == 7 and evaluate.failures(scored).count() == 5
    assert evaluate.inexact(scored, ["b1"]).count() == 4

"""Scoring predictions against references: metrics, recorded oracle results, failure classes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import deck as D
from millrace.functions import taxonomy as X
from millrace.functions.python import edit_distance
from millrace.operators import report
from millrace.operators.dedupe import keep_last


def prediction_metrics(pairs: DataFrame, reference: str = "reference_cards", candidate: str = "candidate_cards") -> DataFrame:
    """Adds exact_match, per_card_exact, normalized_edit_distance; a missing candidate scores false, 0 and 1.

    Equal decks never reach the similarity function.
    """
    there = F.col(candidate).isNotNull()
    exact = F.coalesce(D.exact(reference, candidate), F.lit(False))
    joined = lambda c: F.array_join(c, "\n")
    distance = F.when(exact, F.lit(0.0)).when(there, edit_distance(joined(reference), F.when(there & ~exact, joined(candidate)))).otherwise(1.0)
    return pairs.withColumns({
        "exact_match": exact, "per_card_exact": F.when(there, D.per_line_exact(reference, candidate)).otherwise(0.0), "normalized_edit_distance": distance,
    })


def reevaluate(predictions: DataFrame, references: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Predictions with metrics, assemblable, functional, evaluator_invariant and failure_type.

    ``predictions``: id, candidate_cards, assemble_status, run_status,
    output_cards; ``references``: id, reference_cards, reference_output, both
    with one row for each id (the last by ``order``).  Oracle results come
    recorded.  A prediction without a reference keeps its row, unscored.
    """
    refs = keep_last(references, [key], order) if order else references
    rows = prediction_metrics(predictions.join(refs.withColumn("_known", F.lit(True)), key, "left"))
    worth = X.worth_assembling(F.coalesce("candidate_cards", F.array().cast("array<string>")), "exact_match")
    there = F.col("candidate_cards").isNotNull()
    status = F.when(~there, "candidate_missing").when(~worth, "precheck_skipped").otherwise(F.col("assemble_status"))
    assemblable = F.coalesce(status == "ok", F.lit(False))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    functional = assemblable & (F.col("run_status") == "ok") & some("output_cards") & some("reference_output") & (F.col("output_cards") == F.col("reference_output"))
    rows = rows.withColumns({"assemble_status": status, "assemblable": assemblable, "functional": F.coalesce(functional, F.lit(False))})
    invariant = (
        F.when(F.col("exact_match") & ~F.col("assemblable"), "exact_match_failed_to_assemble")
        .when(F.col("exact_match") & some("reference_output") & ~F.col("functional"), "exact_match_failed_functional_check")
    )
    rows = rows.withColumn("evaluator_invariant", invariant)
    failure = X.classify_failure(F.coalesce("candidate_cards", F.array().cast("array<string>")), "exact_match", "assemblable", "functional", "assemble_status", "evaluator_invariant")
    rows = rows.withColumn("failure_type", failure)
    scored = ("exact_match", "per_card_exact", "normalized_edit_distance", "assemblable", "functional", "evaluator_invariant", "failure_type")
    return rows.withColumns({c: F.when(F.col("_known"), F.col(c)) for c in scored}).drop("_known")


def full_report(scored: DataFrame, dims: list[str], features: str | None = None) -> dict[str, DataFrame]:
    """Tables of a report: rates by dimension, by feature, and the taxonomy."""
    out = {"rates": report.bucket_report(scored, dims), "taxonomy": report.taxonomy(scored)}
    if features:
        out["features"] = report.feature_report(scored, features)
    return out


def failures(scored: DataFrame) -> DataFrame:
    """Cases with a failure type other than exact_match; unscored rows are no cases."""
    return scored.where(F.col("failure_type") != "exact_match")


def inexact(scored: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """Cases that are not exact, rows without the metric included; of some bands if given."""
    rows = scored.where(~F.coalesce(F.col("exact_match"), F.lit(False)))
    return rows.where(F.col("band").isin([b.upper() for b in bands])) if bands else rows

"""Failure reviews as plans: cases with categories, counts, representatives, archives and reports.

``predictions`` has id, band, failure_type, exact_match, per_card_exact,
normalized_edit_distance, assemblable, functional, candidate_cards (null where
the candidate is missing); ``references`` has id, reference_cards and, for the
band review, features.  Both have one row for each id.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import deck as D
from millrace.functions import taxonomy as X
from millrace.operators import report, review
from millrace.sources.sinks import read_text, write_text

#: Columns of a case.
CASE = ["id", "band", "category", "failure_type", "exact_match", "per_card_exact", "normalized_edit_distance", "assemblable", "functional", "diff_count", "first_diff_index"]


@dataclass(frozen=True)
class Review:
    """All cases, their counts by category (and by band), feature counts, and the chosen cases numbered worst first."""

    cases: DataFrame
    counts: DataFrame
    by_band: DataFrame | None
    features: DataFrame | None
    chosen: DataFrame


def _diffs(df: DataFrame, indices) -> DataFrame:
    df = df.withColumn("_diffs", indices)
    return df.withColumns({"diff_count": F.coalesce(F.size("_diffs"), F.lit(0)), "first_diff_index": F.try_element_at("_diffs", F.lit(1))}).drop("_diffs")


def _flags(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("assemblable", "functional")})


def _numbered(chosen: DataFrame) -> DataFrame:
    return review.numbered_names(chosen, review.case_order(), "id")  # a few rows


def tail_review(predictions: DataFrame, references: DataFrame, band: str = "B1", total: int = 10) -> Review:
    """Cases of one band that are not exact, have a reference and a candidate; planned representatives filled up to ``total``."""
    rows = predictions.where((F.col("band") == band) & ~F.coalesce(F.col("exact_match"), F.lit(False)))
    rows = _flags(rows.where(F.col("candidate_cards").isNotNull())).join(references.select("id", "reference_cards"), "id")
    rows = _diffs(rows, D.diff_indices("reference_cards", "candidate_cards"))
    cases = rows.withColumn("category", X.tail_category("reference_cards", "candidate_cards", "functional", "exact_match", "assemblable")).select(*CASE)
    counts = report.zero_filled(cases.groupBy("category").agg(F.count("*").alias("n")), X.TAIL_CATEGORIES)
    chosen = review.representatives(cases, review.TAIL_PLAN, review.case_order(), total)
    return Review(cases, counts, None, None, _numbered(chosen))


def band_review(predictions: DataFrame, references: DataFrame, bands: list[str], per_band: int = 4, total: int = 12) -> Review:
    """Cases of some bands whose failure is not exact_match; a missing candidate is a category of its own.

    Features are counted for every such case, with those that name a feature
    twice counted twice.
    """
    rows = predictions.where(F.col("band").isin(bands) & F.coalesce(F.col("failure_type") != "exact_match", F.lit(True)))
    rows = _flags(rows).join(references.select("id", "reference_cards", "features"), "id")
    there = F.col("candidate_cards").isNotNull()
    rows = _diffs(rows, F.when(there, X.band_diffs("reference_cards", "candidate_cards")))
    sizes = {"candidate_lines": F.when(there, F.size("candidate_cards")).otherwise(0), "reference_lines": F.when(there, F.size("reference_cards")).otherwise(0)}
    category = X.band_category("reference_cards", "candidate_cards", "functional", "exact_match", "assemblable")
    rows = rows.withColumns(sizes | {"category": category})
    cases = rows.select(*CASE, "candidate_lines", "reference_lines")
    features = rows.select("band", F.explode("features").alias("feature")).groupBy("band", "feature").agg(F.count("*").alias("n"))
    chosen = review.band_representatives(cases, review.BAND_PLAN, review.case_order(), per_band, total)
    by_band = cases.groupBy("band", "category").agg(F.count("*").alias("n"))
    return Review(cases, by_band.groupBy("category").agg(F.sum("n").alias("n")), by_band, features, _numbered(chosen))


# The headings and bullets of the reports.
def markdown(found: Review, title: str, categories: list[str], bands: list[str] | None = None, advice: list[str] = ()) -> str:
    """The report of a review: its counts are a few rows, its cases at most the chosen ones."""
    counts = {r.category: r.n for r in found.counts.collect()}
    chosen = found.chosen.orderBy("name").collect()
    lines = [f"# {title}", "", f"- Non-exact cases: {sum(counts.values())}", f"- Selected representative failures: {len(chosen)}", "", "## Category Counts"]
    lines += [f"- `{c}`: {counts[c]}" for c in categories if bands is None or c in counts]
    if bands is not None:
        by = {(r.band, r.category): r.n for r in found.by_band.collect()}
        features = {(r.band, r.feature): r.n for r in found.features.collect()}
        lines += ["", "## By Band"]
        for b in bands:
            lines += [f"- `{b}`:"] + [f"  - `{c}`: {by[b, c]}" for c in categories if (b, c) in by]
        lines += ["", "## Feature Footprint"]
        lines += [f"- `{b}` features: " + ", ".join(f"{f} {n}" for (x, f), n in sorted(features.items()) if x == b) for b in bands]
        if advice:
            lines += ["", "## Recommendations", *(f"- {a}" for a in advice)]
    lines += ["", "## Selected Cases"]
    more = ("candidate_lines", "reference_lines") if bands is not None else ("functional",)
    lines += [f"- `{r.id}` ({r.band}): `{r.category}` · " + " · ".join(f"{c}={r[c]}" for c in ("diff_count", "first_diff_index", *more)) for r in chosen]
    return "\n".join(lines) + "\n"


def write_review(found: Review, target: str, title: str, categories: list[str], bands: list[str] | None = None, advice: list[str] = ()) -> str:
    """Cases and chosen cases as tables below ``target``, the report as review.md; returns the report."""
    found.cases.write.mode("overwrite").json(f"{target}/cases")
    found.chosen.write.mode("overwrite").partitionBy("name").json(f"{target}/selected_failures")
    write_text(found.cases.sparkSession, f"{target}/review.md", markdown(found, title, categories, bands, advice))
    return read_text(found.cases.sparkSession, f"{target}/review.md")


def failure_cases(predictions: DataFrame, references: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Predictions that failed joined to their references, the first ``limit`` in file order, named ``0001_id``."""
    failed = predictions.where(F.col("failure_type").isNotNull() & (F.col("failure_type") != "exact_match"))
    names = [c for c in references.columns if c == "id" or c not in predictions.columns]
    rows = failed.join(references.select(*names), "id")
    if limit is not None:
        return review.numbered_names(rows.orderBy(*order).limit(limit), order, "id")
    from millrace.operators.order import numbered

    return numbered(rows, order, "_n").withColumn("name", F.format_string("%04d_%s", F.col("_n") + 1, F.col("id").cast("string"))).drop("_n")


def failure_manifest(cases: DataFrame) -> DataFrame:
    """(failure_type, n), with the number of all cases where failure_type is null."""
    return cases.rollup("failure_type").agg(F.count("*").alias("n"))


#: Modes in the order of reports, the base of the differences, and short names of the rates (fixed values).
REPORT_MODES, BASE_MODE = ("zero_shot", "few_shot", "fine_tuned"), "zero_shot"
RATES = {"exact": "exact_match", "assemblability": "assemblable", "functional": "functional", "per_card": "per_card_exact", "edit_distance": "normalized_edit_distance"}


def mode_rates(scored: DataFrame, modes: tuple[str, ...] = REPORT_MODES) -> DataFrame:
    """(mode, n, rates, differences to the base mode, failures: failure_type -> n) of scored predictions with a mode."""
    rows = scored.where(F.col("mode").isin(list(modes)))
    kind = F.coalesce("failure_type", F.lit("unclassified"))
    kinds = rows.groupBy("mode", kind.alias("kind")).agg(F.count("*").alias("k")).groupBy("mode").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "k")))).alias("failures"))
    rates = rows.groupBy("mode").agg(F.count("*").alias("n"), *(report.rate(m).alias(m) for m in RATES.values()))
    base = rates.where(F.col("mode") == BASE_MODE).count()  # one row or none
    rates = report.deltas(rates, "mode", BASE_MODE, list(RATES.values())) if base else rates
    return rates.join(kinds, "mode")


def training_report(scored: DataFrame, title: str, training: dict[str, object], modes: tuple[str, ...] = REPORT_MODES) -> str:
    """Markdown: what was trained, each mode's rates and failures, and the differences to the base mode; one row for each mode."""
    rows = {r["mode"]: r.asDict() for r in mode_rates(scored, modes).collect()}
    lines = [f"# {title}", "", "## Training", "", *(f"- {k}: {v}" for k, v in training.items()), "", "## Mode Metrics", ""]
    for m in modes:
        r = rows.get(m, {})
        shown = ", ".join(f"{short}={r.get(c) or 0.0:.3f}" for short, c in RATES.items())
        lines += [f"### {m}", "", f"- predictions: {r.get('n', 0)}", f"- metrics: {shown}", f"- failure_taxonomy: {json.dumps(r.get('failures') or {}, sort_keys=True)}", ""]
    lines += ["## Baseline Delta", ""]
    for m in modes:
        r = rows.get(m, {})
        lines += [f"### {m}", ""] + [f"- {c}: value={r.get(c)}, delta_vs_{BASE_MODE}={r.get(f'delta_{c}')}" for c in RATES.values() if f"delta_{c}" in r] + [""]
    return "\n".join(lines)

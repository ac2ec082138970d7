"""Failure classes and review categories as one CASE expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import deck as D
from millrace.functions.text import lstrip, strip

#: Echo marks, line forms and the least number of lines of a deck (fixed values).
ECHO = ("<IT>", "User:", "Assistant:")
HEADER_LINE = r"^\+\s+\d+\s+\d+\s+\d+\s+\d+\s+\d+\s*$"
STATEMENT_LINE = r"(?i)^\d{4}\+\s+.+\s+f{1,2}\s*$"
LEAST_LINES = 10
TRANSFERS = ("tra", "tze", "tnz", "nze")

TAIL_CATEGORIES = ["symbolic_tail_or_reservation_drift", "wrong_constant_card", "wrong_transfer_target", "assembles_but_misexecutes_small_diff", "malformed_pit", "functional_success_exact_failure"]
BAND_CATEGORIES = ["partial_dictionary_tail_truncation", "final_a_dictionary_drop", "tail_only_other", "candidate_missing", "non_tail_divergence", "malformed_pit", "functional_success_exact_failure"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def looks_like_source(lines) -> Column:
    """At least half of the lines, and two, are headers or statements."""
    lines = _col(lines)
    hits = F.size(F.filter(lines, lambda x: strip(x).rlike(HEADER_LINE) | strip(x).rlike(STATEMENT_LINE)))
    return (F.size(lines) > 0) & (hits >= F.greatest(F.lit(2), F.floor(F.size(lines) / 2)))


def classify_failure(lines, exact, assemblable, functional, status=None, invariant=None) -> Column:
    """The first of nine outcomes that holds."""
    lines = _col(lines)
    exact, assemblable, functional = (F.coalesce(_col(c), F.lit(False)) for c in (exact, assemblable, functional))
    status = F.lit(None).cast("string") if status is None else _col(status)
    invariant = F.lit(None).cast("string") if invariant is None else _col(invariant)
    echo = F.exists(lines, lambda x: x.contains(ECHO[0]) | x.contains(ECHO[1]) | x.contains(ECHO[2]))
    return (
        F.when(F.coalesce(invariant, F.lit("")) != "", "evaluator_invariant_failure")
        .when(exact, "exact_match")
        .when(echo, "malformed_source_echo_in_output")
        .when(looks_like_source(lines), "returned_it_source_instead_of_pit")
        .when(F.size(lines) < LEAST_LINES, "malformed_pit_card")
        .when(~assemblable & (status == "assemble_error"), "wrong_reservation_handling_or_symbolic_output")
        .when(~assemblable, "unassemblable_output")
        .when(functional, "functional_success_exact_failure")
        .otherwise("assembles_but_misexecutes")
    )


def worth_assembling(lines, exact) -> Column:
    """Cheap test before the expensive stage: exact, or none of the malformed classes."""
    cheap = classify_failure(lines, F.lit(False), F.lit(False), F.lit(False))
    return F.coalesce(_col(exact), F.lit(False)) | ~cheap.isin("malformed_source_echo_in_output", "returned_it_source_instead_of_pit", "malformed_pit_card")


def label(line) -> Column:
    """First word in lower case, empty for a blank line."""
    return F.regexp_extract(F.lower(strip(line)), r"^(\S+)", 1)


def tail_category(reference, candidate, functional, exact, assemblable) -> Column:
    """Category of one non-exact case by where and what its lines differ."""
    functional, exact, assemblable = (F.coalesce(_col(c), F.lit(False)) for c in (functional, exact, assemblable))
    diffs, size = D.diff_indices(reference, candidate), D.longest(reference, candidate)

    def at(i):
        r, c = D.line_at(reference, i), D.line_at(candidate, i)
        name = F.when(label(r) != "", label(r)).otherwise(label(c))
        text = F.lower(F.concat(r, F.lit("\n"), c))
        return F.struct(name.startswith("a").alias("a"), text.alias("text"), i.alias("i"))

    seen = F.transform(diffs, at)
    transfer = F.exists(seen, lambda x: x["text"].rlike("|".join(TRANSFERS)))
    constant = (F.size(diffs) <= 2) & F.forall(seen, lambda x: x["a"])
    tail = F.exists(seen, lambda x: x["a"] | (x["i"] >= size - 10))
    return (
        F.when(functional & ~exact, "functional_success_exact_failure").when(~assemblable, "malformed_pit")
        .when(F.size(diffs) == 0, "functional_success_exact_failure").when(transfer, "wrong_transfer_target")
        .when(constant, "wrong_constant_card").when(tail, "symbolic_tail_or_reservation_drift")
        .otherwise("assembles_but_misexecutes_small_diff")
    )


def band_diffs(reference, candidate) -> Column:
    """Positions that differ; the first line does not where only its leading blanks do."""
    reference, candidate = _col(reference), _col(candidate)
    indent = lstrip(D.line_at(reference, F.lit(0))) == lstrip(D.line_at(candidate, F.lit(0)))
    both = (F.size(reference) > 0) & (F.size(candidate) > 0)
    return F.filter(D.diff_indices(reference, candidate), lambda i: ~((i == 0) & both & indent))


def band_category(reference, candidate, functional, exact, assemblable) -> Column:
    """Category of one non-exact case by whether only its last lines differ, and how its last line ends; no candidate is a category."""
    functional, exact, assemblable = (F.coalesce(_col(c), F.lit(False)) for c in (functional, exact, assemblable))
    reference, candidate = _col(reference), _col(candidate)
    diffs = band_diffs(reference, candidate)
    size = D.longest(reference, candidate)
    last = strip(F.coalesce(F.try_element_at(candidate, F.lit(-1)), F.lit("")))
    partial = last.rlike(r"(?:s00|s0| 00|i)$") | last.contains(" u0") | (last == "3         s")
    dropped = last.startswith("4         a") | last.startswith("3         a")
    return (
        F.when(candidate.isNull(), "candidate_missing").when(functional & ~exact, "functional_success_exact_failure")
        .when(~assemblable, "malformed_pit").when(F.size(diffs) == 0, "functional_success_exact_failure")
        .when(~F.forall(diffs, lambda i: i >= size - 12), "non_tail_divergence")
        .when(partial, "partial_dictionary_tail_truncation").when(dropped, "final_a_dictionary_drop").otherwise("tail_only_other")
    )

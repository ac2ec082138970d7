"""Operator 12: what five filters remove in every order, from a histogram of the filters that each document fails.

Built-in expressions give each text a mask of five bits; the last one, equality
with the text of a smaller doc_id, comes from the smallest doc_id of each text
(named by MD5).  Documents then shrink to 32 cells for each part of the table,
and all orders are read off the cells: a filter removes a document if it fails
it and no earlier one, so what a step does depends on the filter and on the set
of those before it, which has 80 values, not on their order.
"""

from __future__ import annotations

import json
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_CELL = ("n", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3 of the mask: filters A to D on a text that is not null."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    n = F.size(words)
    failed = (
        n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        text.contains("#") | text.contains("$") | text.contains("%") | text.contains("&") | text.contains("*") | text.contains("|"),
    )
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failed)), F.lit(0))


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def _steps() -> Column:
    """Each filter with each set of filters before it, and the orders in which that happens: 80 entries with 600 places in all."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    made = []
    for f in FILTERS:
        rest = FILTERS.replace(f, "")
        for before in (set(c) for k in range(len(FILTERS)) for c in combinations(rest, k)):
            places = [{"filter_order": o, "step": len(before) + 1} for o in orders if o[len(before)] == f and set(o[: len(before)]) == before]
            made.append({"f": _bit(f), "before": sum(map(_bit, before)), "places": places})
    return F.from_json(F.lit(json.dumps(made)), "array<struct<f:int,before:int,places:array<struct<filter_order:string,step:int>>>>")


def _cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask`` and the number of documents, of good ones and of toxic ones."""
    text = F.coalesce(F.col("`text`"), F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce(F.col("`source`").cast("string"), F.lit("")).alias("part"), text_mask(text).cast("byte").alias("mask"),
        F.unhex(F.md5(text)).alias("digest"),
    )
    # equal rows of a document once with their number, beside its labels
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    rows = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "bad")})
    # cells of each text: all its documents, and those of the cell's smallest doc_id
    cells = rows.groupBy("digest", "part", "mask", "good", "bad").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    smallest = cells.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    cells = cells.join(smallest, "digest")
    kept = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), kept.alias("n")), F.struct((F.col("mask") + _bit("E")).cast("byte").alias("mask"), (F.col("n") - kept).alias("n")))
    cells = cells.select("part", "good", "bad", F.inline(both)).where("n > 0")
    return cells.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters A to E and step: what the step's filter keeps and removes.

    The filters fail texts of under 50 words (A), with less than 65 % distinct
    words (B), with more than 5 % capital letters A to Z (C), with one of
    ``#$%&*|`` (D), or equal to the text of a smaller doc_id anywhere (E).

    Null texts are empty ones, null sources the empty part.  Rows of one doc_id
    are not copies of each other, rows without doc_id neither copies nor
    originals.  A document is good or toxic if some row of ``labels`` says so;
    labels without doc_id are of no document.  Empty tables give no rows;
    columns other than doc_id, text and source are not read.

    Texts never leave the scan: shuffled are doc_id, part, mask and digest,
    then cells of texts.  Copies are counted before the shuffle by text, so a
    text with any number of them is as many rows as it has parts and labels.
    """
    hit = (F.col("c.mask").cast("int").bitwiseAND(F.col("s.f")) != 0)
    early = F.col("c.mask").cast("int").bitwiseAND(F.col("s.before")) != 0
    # each cell against each of the 80 pairs of a filter and those before it; a part has at most 32 cells
    pairs = _cells(docs, labels).select("part", F.struct("mask", *_CELL).alias("c"), F.explode(_steps()).alias("s"))

    def total(column: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(f"c.{column}")).otherwise(F.lit(0))).cast("long")

    orders = 120 / F.bit_count(F.col("c.mask").cast("int"))  # in which one of the failed filters comes first
    sums = pairs.groupBy("part", "s.f", "s.before").agg(
        total("n", ~hit & ~early).alias("kept"), total("n", hit & ~early).alias("removed"), total("n", hit & early).alias("redundant"),
        total("n", F.col("c.mask").cast("int") == F.col("s.f")).alias("unique_fails"), total("good", hit & ~early).alias("good_lost"),
        total("toxic", hit & ~early).alias("toxic_lost"), F.sum(F.when(hit, F.col("c.n") * orders).otherwise(F.lit(0.0))).cast("long").alias("shapley"),
        F.first("s.places").alias("places"),
    )
    return sums.select("part", F.explode("places").alias("p"), *_OUT).select("part", "p.filter_order", "p.step", *_OUT)


_OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

"""Representative cases, gates and the choice of the best run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many cases of each category stand for it (fixed values).
TAIL_PLAN = [("symbolic_tail_or_reservation_drift", 3), ("assembles_but_misexecutes_small_diff", 3), ("functional_success_exact_failure", 2)]
BAND_PLAN = [("partial_dictionary_tail_truncation", 4), ("final_a_dictionary_drop", 2), ("tail_only_other", 2), ("candidate_missing", 1)]


def case_order(distance: str = "normalized_edit_distance", diffs: str = "diff_count", per_line: str = "per_card_exact", ident: str = "id") -> list[Column]:
    """Worst case first: distance, number of differences, share of wrong lines, id, all descending."""
    return [F.desc(distance), F.desc(diffs), (1 - F.col(per_line)).desc(), F.desc(ident)]


def top_per_group(df: DataFrame, group: str, plan: dict[str, int] | int, order: list[Column]) -> DataFrame:
    """The first rows of each group: a number for all groups or one for each."""
    n = F.lit(plan) if isinstance(plan, int) else F.create_map(*[F.lit(x) for k, v in plan.items() for x in (k, v)])[F.col(group)]
    w = Window.partitionBy(group).orderBy(*order)
    most = plan if isinstance(plan, int) else max(plan.values(), default=0)
    # the constant bound lets Spark keep only that many rows of a group before the shuffle
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).where(F.col("_rn") <= n).drop("_rn")


def representatives(df: DataFrame, plan: list[tuple[str, int]], order: list[Column], total: int, category: str = "category", key: str = "id") -> DataFrame:
    """Planned numbers of each category, filled up to ``total`` from the rest, in order and cut."""
    chosen = top_per_group(df.where(F.col(category).isin([c for c, _ in plan])), category, dict(plan), order)
    rest = df.join(chosen.select(key), key, "left_anti").orderBy(*order).limit(total)
    both = chosen.withColumn("_fill", F.lit(0)).unionByName(rest.withColumn("_fill", F.lit(1)))
    filled = both.orderBy("_fill", *order).limit(total)  # a few rows from here on
    return filled.orderBy(*order).select(*df.columns)


def band_representatives(df: DataFrame, plan: list[tuple[str, int]], order: list[Column], per_band: int = 4, total: int = 12, band: str = "band", category: str = "category", key: str = "id") -> DataFrame:
    """Top cases of each band, then planned numbers of each category not chosen yet, then a fill up to ``total``; no final cut."""
    chosen = top_per_group(df, band, per_band, order)
    more = df.where(F.col(category).isin([c for c, _ in plan])).join(chosen.select(key), key, "left_anti")
    chosen = chosen.unionByName(top_per_group(more, category, dict(plan), order))
    left = F.greatest(F.lit(0), F.lit(total) - F.count("*"))
    room = chosen.agg(left.alias("_room"))
    rest = df.join(chosen.select(key), key, "left_anti").orderBy(*order).limit(total)
    rest = rest.withColumn("_rn", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(room)).where("_rn <= _room")
    return chosen.unionByName(rest.select(*df.columns))


def gates(df: DataFrame, functional: str, exact: str, band_functional: str) -> DataFrame:
    """Gate columns: overall functional 0.70, overall exact 0.50, band functional 0.40, and all three."""
    at = lambda c, x: F.coalesce(F.col(c), F.lit(0.0)) >= F.lit(x)
    a, b, c = at(functional, 0.70), at(exact, 0.50), at(band_functional, 0.40)
    return df.withColumns({"functional_ok": a, "exact_ok": b, "band_ok": c, "passes": a & b & c})


def selection_score(functional: str = "functional", exact: str = "exact_match", per_line: str = "per_card_exact", assemblability: str = "assemblability", least: float = 0.95) -> Column:
    """struct of three rates, null below the least assemblability; structs compare field by field."""
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return F.when(value(assemblability) >= least, F.struct(value(functional).alias("functional"), value(exact).alias("exact"), value(per_line).alias("per_line")))


def compare_scores(a, b) -> Column:
    """1, 0 or -1; no score is the lowest."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a > b, 1).otherwise(-1)


def best(df: DataFrame, by: list[str], value: str, score: list, position: str) -> DataFrame:
    """The value with the highest score of each group; the first by position on a tie."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*score, (-F.col(position)).alias("_p"))).alias(value))


def numbered_names(df: DataFrame, order: list, ident: str = "id") -> DataFrame:
    """Adds name: four-digit place in order, underscore, id."""
    rn = F.row_number().over(Window.orderBy(*order))
    return df.withColumn("name", F.format_string("%04d_%s", rn, F.col(ident).cast("string")))

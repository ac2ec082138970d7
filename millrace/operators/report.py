"""Joins of predictions to references and the reports over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.dedupe import keep_last
from millrace.operators.order import numbered

METRICS = ("exact_match", "assemblable", "functional", "per_card_exact", "normalized_edit_distance")


def scored(references: DataFrame, predictions: DataFrame, key: str = "id", order: list[str] | None = None, how: str = "inner") -> DataFrame:
    """References joined to the last prediction of each id."""
    last = keep_last(predictions, [key], order) if order else predictions
    return references.join(last, key, how)


def reevaluated(predictions: DataFrame, references: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Every prediction with its reference's columns, null where there is none."""
    last = keep_last(references, [key], order) if order else references
    return predictions.join(last, key, "left")


def missing(references: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return references.join(done.select(key).distinct(), key, "left_anti")


def existing(predictions: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    return predictions.join(listing.select(key).distinct(), key, "left_semi")


def rate(c) -> Column:
    """Mean of a boolean or number, nulls as zero, 0.0 for no rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), F.lit(0.0))


def bucket_report(df: DataFrame, dims: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(dim, bucket, n, one rate for each metric): all rows, and every bucket of every dimension, in one pass.

    Grouping sets expand the rows once, after the columns are cut to what is
    counted, and partial sums go through one shuffle.
    """
    rows = df.select(*(F.col(d).cast("string").alias(d) for d in dims), *(F.col(m).cast("double").alias(m) for m in metrics))
    sets = [[]] + [[F.col(d)] for d in dims]
    level = F.grouping_id()
    full = (1 << len(dims)) - 1
    out = rows.groupingSets(sets, *(F.col(d) for d in dims)).agg(level.alias("_g"), F.count("*").alias("n"), *(rate(m).alias(m) for m in metrics))
    dim, bucket = F.lit("overall"), F.lit("all")
    for i, d in enumerate(dims):
        here = F.col("_g") == F.lit(full ^ (1 << (len(dims) - 1 - i)))
        dim, bucket = F.when(here, d).otherwise(dim), F.when(here, F.col(d)).otherwise(bucket)
    return out.select(dim.alias("dim"), bucket.alias("bucket"), "n", *metrics)


def feature_report(df: DataFrame, features: str, metrics: tuple[str, ...] = METRICS, empty: str = "no_feature_tags") -> DataFrame:
    """The same for a row's distinct tags: a row counts in each of them, one without tags under ``empty``."""
    tags = F.when(F.size(F.coalesce(F.col(features), F.array())) == 0, F.array(F.lit(empty))).otherwise(F.array_distinct(features))
    return df.withColumn("bucket", F.explode(tags)).groupBy("bucket").agg(F.count("*").alias("n"), *(rate(m).alias(m) for m in metrics))


def taxonomy(df: DataFrame, failure: str = "failure_type", default: str = "unclassified") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(failure), F.lit(default)).alias(failure)).agg(F.count("*").alias("n"))


def category_counts(df: DataFrame, band: str, category: str) -> DataFrame:
    """Counts by band and category with each category's total (band null)."""
    return df.rollup(category, band).agg(F.count("*").alias("n")).where(F.col(category).isNotNull())


def zero_filled(counts: DataFrame, categories: list[str], category: str = "category", n: str = "n") -> DataFrame:
    """One row for each category in its fixed order, 0 where there is none."""
    spark = counts.sparkSession
    fixed = spark.createDataFrame(list(enumerate(categories)), f"ord int, {category} string")
    return fixed.join(counts.select(category, n), category, "left").select("ord", category, F.coalesce(n, F.lit(0)).alias(n))


def medians(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, median): the exact median of each group that has a value; no task holds a group.

    Values are numbered in order over all groups, so a group's first place and
    size name its middle places, and a join by place, a key without repeats,
    fetches them.  A random number behind equal values spreads them over parts.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_value"), F.rand(0).alias("_spread"))
    placed = numbered(rows, [*by, "_value", "_spread"], "_at")
    groups = placed.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    middle = F.array_distinct(F.array(F.expr("_first + (_n - 1) div 2"), F.expr("_first + _n div 2")))
    wanted = groups.where("_n > 0").select(*by, F.explode(middle).alias("_at"))
    return placed.select("_at", "_value").join(wanted, "_at").groupBy(*by).agg(((F.min("_value") + F.max("_value")) / 2).alias("median"))


def timing_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, total, mean, median): nulls are skipped; the median is exact, the mean of both middle values."""
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    middle = medians(df, value, by).select(*(F.col(b).alias(f"_b_{b}") for b in by), "median")
    same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by), F.lit(True))
    return stats.join(middle, same, "left").select(*by, "n", "total", "mean", "median")


def budget_report(df: DataFrame, ident: str, tokens: str, cap: int, order: list[str]) -> DataFrame:
    """(n, n_over, longest) and, as rows of their own through over_budget(), the ids above the cap."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(tokens) > cap).alias("n_over"), F.max(tokens).alias("longest"))


def over_budget(df: DataFrame, ident: str, tokens: str, cap: int) -> DataFrame:
    return df.where(F.col(tokens) > cap).select(ident, tokens)


def deltas(df: DataFrame, mode: str, base: str, metrics: list[str]) -> DataFrame:
    """Rows with delta_<metric> against the row whose mode is ``base``; null for that row; no rows without it."""
    one = df.where(F.col(mode) == base).select(*(F.col(m).alias(f"_b_{m}") for m in metrics)).limit(1)
    joined = df.crossJoin(F.broadcast(one))  # one row
    return joined.select(*df.columns, *(F.when(F.col(mode) != base, F.col(m) - F.col(f"_b_{m}")).alias(f"delta_{m}") for m in metrics))


def pair_deltas(df: DataFrame, by: str, flag: str, metrics: list[str]) -> DataFrame:
    """(by, on - off of each metric) for a two-valued flag."""
    side = lambda v, m: F.max(F.when(F.col(flag) == v, F.col(m)))
    return df.groupBy(by).agg(*((side(True, m) - side(False, m)).alias(f"delta_{m}") for m in metrics))


def grid(spark, **axes: list) -> DataFrame:
    """Every combination of the given values, one column for each axis."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], [name])
        out = axis if out is None else out.crossJoin(axis)
    return out


def first_value(df: DataFrame, value: str, order: list, by: list[str] = ()) -> DataFrame:
    """(by, value): the first value in order that is neither null nor empty."""
    there = df.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "")
    return there.groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value))


def chunked(df: DataFrame, order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """Adds the number, from 0, of the run of ``size`` rows in order that a row is in."""
    return numbered(df, order, "_at").withColumn(name, F.floor(F.col("_at") / size)).drop("_at")


def amortised(df: DataFrame, chunk: str, seconds: str, name: str) -> DataFrame:
    """Adds each row's even share of its chunk's time."""
    sizes = df.groupBy(chunk).agg(F.count("*").alias("_n"))  # a chunk is a few rows, so this is no hot key
    return df.join(sizes, chunk).withColumn(name, F.col(seconds) / F.col("_n")).drop("_n")


def elapsed(start, end) -> Column:
    """Seconds between two timestamps, with or without a time zone, as a double."""
    start, end = ((F.col(c) if isinstance(c, str) else c).cast("timestamp") for c in (start, end))
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def total_seconds(generation, evaluation) -> Column:
    """Sum of both times; null only if both are."""
    g, e = (F.col(c) if isinstance(c, str) else c for c in (generation, evaluation))
    return F.when(g.isNotNull() | e.isNotNull(), F.coalesce(g, F.lit(0.0)) + F.coalesce(e, F.lit(0.0)))


def iso_seconds(time) -> Column:
    """A timestamp in the session's time zone, to the second, with its offset."""
    return F.date_format((F.col(time) if isinstance(time, str) else time).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")


def mode_metrics(df: DataFrame, modes: list[str], metrics: tuple[str, ...] = METRICS, mode: str = "mode") -> DataFrame:
    """(mode, metrics) of the given modes that have a report, that is any metric at all."""
    some = F.coalesce(*(F.col(m).cast("string") for m in metrics)).isNotNull()
    return df.where(F.col(mode).isin(modes) & some).select(mode, *metrics)

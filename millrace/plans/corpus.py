"""Building a stage corpus: quotas, programs, recorded oracle results, hashes, admission, splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import hashing as H
from millrace.functions import text as T
from millrace.operators import admit, split
from millrace.operators.dedupe import keep_first
from millrace.sources.programs import generate_programs
from millrace.sources.records import deck_text

#: Sizes and band weights of the stages (fixed values).
STAGES = {
    "2k": (2000, {"B0": 10, "B1": 25, "B2": 20, "B3": 20, "B4": 15, "B5": 10}),
    "5k": (5000, {"B0": 8, "B1": 22, "B2": 20, "B3": 20, "B4": 18, "B5": 12}),
    "10k": (10000, {"B0": 5, "B1": 18, "B2": 20, "B3": 20, "B4": 22, "B5": 15}),
    "20k": (20000, {"B0": 5, "B1": 15, "B2": 18, "B3": 20, "B4": 25, "B5": 17}),
    "25k": (25000, {"B0": 4, "B1": 14, "B2": 18, "B3": 20, "B4": 26, "B5": 18}),
}


@dataclass(frozen=True)
class Stage:
    """How many records each band and each split of a stage gets."""

    bands: dict[str, int]
    splits: dict[str, int]


def stage(spark: SparkSession, name: str) -> Stage:
    """Quotas of a stage by name: a tenth each for dev and test, bands by largest remainder."""
    if name not in STAGES:
        raise KeyError(f"unknown stage: {name}")
    total, weights = STAGES[name]
    table = spark.createDataFrame(sorted(weights.items()), "name string, weight long")
    bands = {r[0]: r[1] for r in split.largest_remainder(table, total).collect()}
    return Stage(bands, {"dev": total // 10, "test": total // 10, "train": total - 2 * (total // 10)})


def next_band(progress: dict[str, tuple[int, int]], quotas: dict[str, int]) -> str | None:
    """The band to try next: of those below their quota the one with the fewest (attempts, accepted), the first by name."""
    open_bands = [b for b in sorted(quotas) if progress.get(b, (0, 0))[1] < quotas[b]]
    return min(open_bands, key=lambda b: progress.get(b, (0, 0)), default=None)


def with_hashes(df: DataFrame, source: str = "source", deck: str | None = None) -> DataFrame:
    """Adds surface, alpha and shape hash of the canonical source (the text as it is where it has no canonical form), and of the deck."""
    canonical = F.coalesce(T.normalise_source(F.col(source))["text"], F.col(source))
    out = df.withColumn("_canonical", canonical)
    out = out.withColumns({"surface_hash": H.sha256("_canonical"), "alpha_hash": H.sha256(T.alpha_normalise("_canonical")), "shape_hash": H.sha256(T.shape_normalise("_canonical"))})
    return (out.withColumn("pit_hash", H.sha256(deck)) if deck else out).drop("_canonical")


def candidates(spark: SparkSession, quotas: dict[str, int], seeds_per_band: int, first_seed: dict[str, int] | None = None) -> DataFrame:
    """Programs of the next seeds of every band, with their hashes."""
    start = first_seed or {}
    bands = spark.createDataFrame([(b, start.get(b, 1)) for b in sorted(quotas)], "band string, start long")
    seeds = bands.crossJoin(spark.range(seeds_per_band)).select("band", (F.col("start") + F.col("id")).alias("seed"))  # a few bands
    return with_hashes(generate_programs(seeds))


def build(candidates: DataFrame, quotas: dict[str, int], done: DataFrame | None = None, status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of candidates in order of (seed, band).

    ``done`` is what an earlier run accepted: its rows keep their places,
    their keys count as seen and its counts against the quotas.  A ``status``
    column other than ok rejects before admission.
    """
    good = candidates if status is None else candidates.where(F.col(status) == "ok")
    failed = candidates.limit(0) if status is None else candidates.where(F.coalesce(F.col(status) != "ok", F.lit(True)))
    names = candidates.columns
    old = F.lit(0)
    rows = good.withColumn("_new", F.lit(1))
    if done is not None:
        rows = done.select(*(F.col(c) if c in done.columns else F.lit(None).alias(c) for c in names)).withColumn("_new", old).unionByName(rows)
    judged = admit.admit(rows, quotas, order=["_new", "seed", "band"])
    accepted = judged.where("status = 'accepted'").drop("_new", "reason", "status")
    rejected = judged.where("status = 'rejected'").select("band", "seed", "reason")
    other = failed.select("band", "seed", F.lit("error").alias("reason") if status is None else F.col(status).alias("reason"))
    return accepted, rejected.unionByName(other)


def split_corpus(accepted: DataFrame, counts: dict[str, int] | None = None, key: str = "id") -> DataFrame:
    """Exact stratified splits where counts are given, else by hash of alpha_hash."""
    rows = keep_first(accepted, ["alpha_hash"], ["ordinal"])
    if counts:
        return split.exact_splits(rows, counts, key=key)
    return rows.withColumn("split", H.hash_split("alpha_hash"))


def records(df: DataFrame, package: str = "P1", version: str = "it_text_v1", provenance: dict[str, str] | None = None) -> DataFrame:
    """Nested records of accepted rows, in the schema of sources.records.REFERENCE.

    ``df``: band, seed, source, header (JSON), tree (JSON), features, the four
    hashes, and the columns of the oracle's stages where they are there: decks
    become text, a stage's log its stdout_log.  ``provenance``: where programs,
    oracle and hashes come from; what it lacks is null.
    """
    there, known = set(df.columns), provenance or {}
    text = lambda c: (F.col(c) if c in there else F.lit(None)).cast("string")
    cards = lambda c: F.when(F.col(c).isNotNull(), deck_text(c)) if c in there else F.lit(None).cast("string")
    logs = lambda stage: [text(f"{stage}_{k}").alias(n) for k, n in (("console_log", "console_log"), ("log", "stdout_log"), ("print_log", "print_log"))]
    header = F.from_json("header", "struct<n_i:int,n_y:int,n_c:int,n_s:int,n_pkg:int,N:int>")
    hashes = ("surface_hash", "alpha_hash", "shape_hash", "pit_hash")
    translate = F.struct(
        text("translate_status").alias("status"), text("upper_acc").cast("bigint").alias("upper_acc"), text("pit_raw").alias("pit_raw"),
        cards("pit_cards").alias("pit_raw_canonical"), cards("reservation_cards").alias("reservation_cards"), cards("translation_body").alias("translation_body"), *logs("translate"),
    )
    assemble = F.struct(text("assemble_status").alias("status"), cards("phase2_cards").alias("pit_phase2_input_p1"), cards("soap_cards").alias("soap_output"), *logs("assemble"))
    run = F.struct(text("run_status").alias("status"), cards("input_cards").alias("input_deck"), cards("spit_cards").alias("spit_p1"), cards("output_cards").alias("output_deck"), *logs("run"))
    origin = ("simh_source", "simh_commit_or_checksum", "generator_version", "normalizer_version")
    return df.select(
        H.record_id("band", "seed", "surface_hash", "alpha_hash", F.coalesce(text("pit_hash"), F.lit(""))).alias("id"), "band", F.col("seed").cast("bigint").alias("seed"),
        F.lit(package).alias("runtime_package"), F.lit(version).alias("source_format"), F.struct(F.col("source").alias("it_text_v1"), header.alias("header")).alias("source"),
        F.struct(*(text(h).alias(h) for h in hashes)).alias("hashes"), F.struct(translate.alias("translate"), assemble.alias("assemble"), run.alias("run")).alias("reference"),
        F.struct(text("tree").alias("ast_json"), text("header").alias("bounds_json"), F.col("features")).alias("generator"),
        F.struct(*(F.lit(known.get(x)).cast("string").alias(x) for x in origin)).alias("provenance"),
    )

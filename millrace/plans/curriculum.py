"""A staged curriculum: growing training samples that weigh some bands more, each with a balanced evaluation sample."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.sample import round_robin, weighted_round_robin
from millrace.sources.records import exists
from millrace.sources.sinks import read_text, write_text

#: Training rows, evaluation rows and how many of the first bands each stage weighs, and their weight (fixed values).
SIZES = [(100, 12, 1), (300, 36, 2), (1000, 108, 3), (3000, 324, 4), (10000, 972, 5)]
WEIGHT = 4


@dataclass(frozen=True)
class Step:
    """One stage: how many rows it trains and is evaluated on, and the weights of its bands."""

    train: int
    evaluation: int
    weights: dict[str, int]

    @property
    def slug(self) -> str:
        return f"s{self.train}_{'_'.join(b.lower() for b in self.weights)}_e{self.evaluation}"


STEPS = [Step(train, evaluation, {f"B{k}": WEIGHT for k in range(bands)}) for train, evaluation, bands in SIZES]


def step_tables(step: Step, train: DataFrame, evaluation: list[DataFrame], salt: str, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(training sample, evaluation sample) of a stage; the evaluation pool is the union of the given splits."""
    pool = evaluation[0]
    for more in evaluation[1:]:
        pool = pool.unionByName(more)
    return weighted_round_robin(train, step.train, f"{salt}:{step.slug}:train", step.weights, **columns), round_robin(pool, step.evaluation, f"{salt}:{step.slug}:eval", **columns)


def prepare(steps: list[Step], train: DataFrame, evaluation: list[DataFrame], target: str, salt: str, band: str = "band", **columns: str) -> DataFrame:
    """Write both tables of every stage below ``target``; returns (slug, part, band, n)."""
    spark = train.sparkSession
    counts = None
    for step in steps:
        for part, df in zip(("train", "eval"), step_tables(step, train, evaluation, salt, band=band, **columns), strict=True):
            path = f"{target}/{step.slug}/{part}"
            df.write.mode("overwrite").parquet(path)
            own = spark.read.schema(df.schema).parquet(path).groupBy(band).agg(F.count("*").alias("n"))
            own = own.select(F.lit(step.slug).alias("slug"), F.lit(part).alias("part"), F.col(band).alias("band"), "n")
            counts = own if counts is None else counts.unionByName(own)
    return counts


def run(spark: SparkSession, steps: list[Step], target: str, work: Callable[[Step, str], dict], resume: bool = True, go_on: bool = False) -> list[dict]:
    """Do the stages in order; each writes summary.json below its folder, and ``resume`` skips those that have one.

    ``work(step, folder)`` returns the stage's summary.  The manifest is written
    after every stage, so a run that stops can go on; an error ends the run
    unless ``go_on``.
    """
    done = []
    for step in steps:
        folder = f"{target}/{step.slug}"
        if resume and exists(spark, f"{folder}/summary.json"):
            done.append({"slug": step.slug, "status": "kept", "summary": json.loads(read_text(spark, f"{folder}/summary.json"))})
        else:
            try:
                summary = work(step, folder)
                write_text(spark, f"{folder}/summary.json", json.dumps(summary, indent=2, sort_keys=True))
                done.append({"slug": step.slug, "status": "complete", "summary": summary})
            except Exception as error:
                done.append({"slug": step.slug, "status": "failed", "error": repr(error)[:500]})
                if not go_on:
                    raise
            finally:
                write_text(spark, f"{target}/manifest.json", json.dumps(done, indent=2, sort_keys=True))
    return done

"""Command line: ``python -m millrace.cli COMMAND ...`` runs one operator or plan over tables in files.

Tables are Parquet folders or files, or JSON lines where the path ends in
.json or .jsonl; results are Parquet unless the output path ends so.
"""

from __future__ import annotations

import argparse
import json
import shlex
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import deck as D
from millrace.functions import taxonomy as X
from millrace.functions import text as T
from millrace.operators import monitor, report, retrieve, sft
from millrace.plans import corpus, evaluate, reviews
from millrace.session import local_session
from millrace.sources import oracle, programs, records, sinks

COMMANDS: dict[str, tuple[Callable, list[tuple[tuple[str, ...], dict]], str]] = {}
OUT = (("--output",), {"required": True})


def _json(path: str) -> bool:
    return path.rstrip("/").endswith((".json", ".jsonl"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if _json(path) else spark.read.parquet(path)


def write(df: DataFrame, path: str, split: list[str] | None = None) -> dict:
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*split) if split else writer
    (writer.json if _json(path) else writer.parquet)(path)
    return {"output": path}


def command(name: str, *arguments):
    """Register a function (spark, args) that returns a summary for the terminal."""

    def add(f):
        COMMANDS[name] = (f, list(arguments), (f.__doc__ or "").strip())
        return f

    return add


def option(*names: str, **how):
    return names, how


INPUT, REFS, PREDS = option("--input", required=True), option("--references", required=True), option("--predictions", required=True)
BAND, COUNT, SALT = option("--band", default="B1"), option("--count", type=int, default=10), option("--salt", default="")
ORDER = option("--order", default="id", help="columns of the file order, with commas")


def _rows(df: DataFrame) -> list[dict]:
    """A result of a few rows."""
    return [json.loads(x) for x in df.toJSON().collect()]


@command("generate-sample", BAND, option("--seed", type=int, default=1), COUNT, OUT)
def generate_sample(spark, a):
    """Programs of a band from a first seed on, with header, features and hashes."""
    seeds = spark.range(a.seed, a.seed + a.count).select(F.lit(a.band).alias("band"), F.col("id").alias("seed"))
    return write(corpus.with_hashes(programs.generate_programs(seeds)), a.output)


@command("generate-accepted", BAND, COUNT, option("--attempts", type=int, default=0), OUT)
def generate_accepted(spark, a):
    """As many different programs of a band, from at most 20 times as many seeds."""
    tried = corpus.candidates(spark, {a.band: a.count}, a.attempts or max(20, 20 * a.count))
    accepted, rejected = corpus.build(tried, {a.band: a.count})
    return write(accepted, a.output) | {"accepted": read(spark, a.output).count(), "rejected": _rows(rejected.groupBy("reason").count())}


def _build(spark, a, quotas, splits):
    tried = corpus.candidates(spark, quotas, a.seeds_per_band or 20 * max(quotas.values()))
    accepted, rejected = corpus.build(tried, quotas)
    write(accepted, f"{a.output}/accepted")
    write(rejected, f"{a.output}/rejected")
    rows = read(spark, f"{a.output}/accepted").withColumn("id", F.concat_ws("-", "band", "seed"))
    counts = sinks.write_splits(corpus.split_corpus(rows, splits), f"{a.output}/splits")
    return {"bands": {r["band"]: r["count"] for r in _rows(rows.groupBy("band").count())}, "splits": counts}


SEEDS = option("--seeds-per-band", type=int, default=0)


@command("build-pilot-corpus", option("--bands", required=True, help="B0=10,B1=20"), SEEDS, OUT)
def build_pilot(spark, a):
    """A corpus with given numbers of each band, split by hash."""
    return _build(spark, a, sft.parse_band_numbers(a.bands), None)


@command("build-stage-corpus", option("--stage", required=True, choices=sorted(corpus.STAGES)), SEEDS, OUT)
def build_stage(spark, a):
    """A corpus of a named stage with exact splits."""
    stage = corpus.stage(spark, a.stage)
    return _build(spark, a, stage.bands, stage.splits)


@command("slice-dataset", option("--split", action="append", required=True, help="name=path"), option("--limit", action="append", default=[], help="name=rows"), SALT, OUT)
def slice_dataset(spark, a):
    """A sample of each split that takes turns over bands, and the index of all."""
    splits = {k: read(spark, v) for k, v in (s.split("=", 1) for s in a.split)}
    limits = {k: int(v) for k, v in (s.split("=", 1) for s in a.limit)}
    return {"rows": sinks.slice_dataset(splits, a.output, limits, a.salt).count(), "output": a.output}


@command("prepare-sft", INPUT, option("--system", default=""), option("--repeat", default=""), OUT)
def prepare_sft(spark, a):
    """Training rows of records with source and completion, repeated by band."""
    rows = read(spark, a.input)
    return write(sft.sft_rows(rows, T.prompt("source", a.system), T.wrap_completion(F.col("completion")), sft.parse_band_numbers(a.repeat)), a.output)


@command("run-inference", option("--queries", required=True), option("--examples", required=True), option("--mode", default="compat", choices=["compat", "levenshtein"]), OUT)
def run_inference(spark, a):
    """The retrieval model: the most similar example of each query (query_id, text; example_id, text)."""
    return write(retrieve.nearest(read(spark, a.queries), read(spark, a.examples), mode=a.mode), a.output)


@command("reevaluate-predictions", PREDS, REFS, OUT)
def reevaluate(spark, a):
    """Predictions with metrics, recorded oracle results and failure types."""
    return write(evaluate.reevaluate(read(spark, a.predictions), read(spark, a.references)), a.output)


@command("eval-report", PREDS, option("--by", default="band"), OUT)
def eval_report(spark, a):
    """Rates by dimension and the failure taxonomy of scored predictions."""
    scored = read(spark, a.predictions)
    tables = evaluate.full_report(scored, a.by.split(","), "features" if "features" in scored.columns else None)
    out = {name: _rows(df) for name, df in tables.items()}
    sinks.write_text(spark, a.output, json.dumps(out, indent=2, sort_keys=True))
    return out


@command("archive-failures", PREDS, REFS, option("--limit", type=int), ORDER, OUT)
def archive_failures(spark, a):
    """The first failures with their references, one folder each, and how many there are of each type."""
    cases = reviews.failure_cases(read(spark, a.predictions), read(spark, a.references), a.order.split(","), a.limit)
    write(cases, f"{a.output}/cases", ["name"])
    manifest = {str(r.get("failure_type", "count")): r["n"] for r in _rows(reviews.failure_manifest(cases))}
    sinks.write_text(spark, f"{a.output}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True))
    return manifest


@command("review-b1-failures", PREDS, REFS, OUT)
def review_tail(spark, a):
    """The review of one band's failures by where their decks differ."""
    found = reviews.tail_review(read(spark, a.predictions), read(spark, a.references))
    return {"report": reviews.write_review(found, a.output, "B1 Failure Review", X.TAIL_CATEGORIES)}


@command("review-band-failures", PREDS, REFS, option("--bands", default="B2,B3"), OUT)
def review_bands(spark, a):
    """The review of several bands' failures by how their decks end."""
    bands = sft.parse_bands(a.bands)
    found = reviews.band_review(read(spark, a.predictions), read(spark, a.references), bands)
    return {"report": reviews.write_review(found, a.output, f"{'/'.join(bands)} Failure Review", X.BAND_CATEGORIES, bands)}


@command("compare-reports", INPUT, option("--base", default="zero_shot"), option("--metrics", default="exact_match,assemblable,functional"))
def compare(spark, a):
    """Differences of each mode's rates to a base mode's."""
    return {"rows": _rows(report.deltas(read(spark, a.input), "mode", a.base, a.metrics.split(",")))}


@command("thinking-ablation", INPUT, option("--by", default="band"), option("--flag", default="thinking"), option("--metrics", default="exact_match,functional"))
def ablation(spark, a):
    """Differences of rates with a flag on and off."""
    return {"rows": _rows(report.pair_deltas(read(spark, a.input), a.by, a.flag, a.metrics.split(",")))}


@command("write-research-report", PREDS, option("--title", default="Training Report"), option("--training", help="JSON object"), OUT)
def research_report(spark, a):
    """Rates, failures and differences of each mode's scored predictions, as Markdown."""
    training = records.read_manifest(spark, a.training) if a.training else {}
    text = reviews.training_report(read(spark, a.predictions), a.title, training)
    sinks.write_text(spark, a.output, text)
    return {"output": a.output}


@command("canonicalize-pit", option("--decks", required=True, help="folder of deck files"), option("--collapse", action="store_true"), OUT)
def canonicalise(spark, a):
    """Decks without trailing blanks and blank edge cards."""
    decks = records.read_decks(spark, a.decks)
    return write(decks.withColumn("cards", D.canonical("cards", True, a.collapse)), a.output)


@command("build-record", INPUT, OUT)
def build_record(spark, a):
    """Nested records of accepted rows."""
    return write(corpus.records(read(spark, a.input)), a.output)


RUN = option("--run", required=True, help="command with {input}, {output} and {steps}")
SECONDS = option("--seconds", type=float, default=oracle.SECONDS)


@command("translate", INPUT, RUN, SECONDS, OUT)
def translate(spark, a):
    """Sources to decks by an external command."""
    return write(oracle.translate(read(spark, a.input), shlex.split(a.run), seconds=a.seconds), a.output)


@command("split-reservations", INPUT, OUT)
def split_reservations(spark, a):
    """The last cards of each deck apart from the others."""
    return write(oracle.assembly_input(read(spark, a.input), []).drop("phase2_cards"), a.output)


@command("build-phase2-p1", INPUT, option("--dictionary", required=True, help="deck file"), OUT)
def build_phase2(spark, a):
    """Reservations, dictionary and body of each deck."""
    cards = records.read_decks(spark, a.dictionary).first().cards
    return write(oracle.assembly_input(read(spark, a.input), cards), a.output)


@command("assemble", INPUT, RUN, SECONDS, OUT)
def assemble(spark, a):
    """Decks to programs by an external command."""
    return write(oracle.assemble(read(spark, a.input), shlex.split(a.run), seconds=a.seconds), a.output)


@command("build-spit", INPUT, option("--loader", required=True, help="deck file"), option("--data", help="column of input cards"), OUT)
def build_spit(spark, a):
    """Loader, program and input cards of each row."""
    return write(oracle.program_deck(read(spark, a.input), records.read_decks(spark, a.loader).first().cards, a.data), a.output)


@command("run-spit", INPUT, RUN, SECONDS, option("--steps", default=oracle.STEP_BUDGET), OUT)
def run_spit(spark, a):
    """Programs run by an external command under a step limit."""
    return write(oracle.run_programs(read(spark, a.input), shlex.split(a.run), steps=a.steps, seconds=a.seconds), a.output)


@command(
    "pipeline", INPUT, option("--translate", required=True), option("--assemble", required=True), RUN, option("--dictionary", required=True), option("--loader", required=True),
    option("--data"), SECONDS, option("--steps", default=oracle.STEP_BUDGET), OUT,
)
def pipeline(spark, a):
    """All external stages of each row, in order."""
    deck = lambda path: records.read_decks(spark, path).first().cards
    commands = {"translate": shlex.split(a.translate), "assemble": shlex.split(a.assemble), "run": shlex.split(a.run)}
    rows = oracle.pipeline(read(spark, a.input), commands, deck(a.dictionary), deck(a.loader), data=a.data, steps=a.steps, seconds=a.seconds)
    return write(rows, a.output) | {"status": _rows(read(spark, a.output).groupBy("status").count())}


@command("dashboard", option("--processes", required=True, help="file with lines of a process list"), option("--script", required=True), option("--summaries", help="folder"))
def dashboard(spark, a):
    """Running jobs by their command lines, and the latest summaries."""
    out = {"jobs": _rows(monitor.process_table(spark.read.text(a.processes), a.script))}
    if a.summaries:
        found = records.summaries(spark, a.summaries)
        out["recent"] = _rows(monitor.recent(found, "modified", tie="path").select("path", "modified"))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    parser.add_argument("--cores", default="*")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments, text) in sorted(COMMANDS.items()):
        sub = commands.add_parser(name, help=text, description=text)
        for flags, how in arguments:
            sub.add_argument(*flags, **how)
    args = parser.parse_args(argv)
    return COMMANDS[args.command][0](spark or local_session(args.cores), args)


if __name__ == "__main__":
    print(json.dumps(main(sys.argv[1:]), indent=2, default=str))

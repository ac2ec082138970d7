"""External oracle stages: commands for each row, each in its own folder, with a time and a step limit.

The emulator is an external program, so a stage is a command and the scripts it
reads are templates; what the stages make of each other is array columns.
"""

from __future__ import annotations

import re
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import deck as D
from millrace.functions.text import splitlines


def run_commands(df: DataFrame, command: list[str], input_column: str = "input", output_file: str = "output", seconds: float = 30.0) -> DataFrame:
    """Adds status (ok, run_error, timeout), output and log.

    The input is the file ``input`` in a fresh folder of the task; ``{input}``
    and ``{output}`` in the command are replaced by paths.  A lost executor
    only runs its rows again.
    """
    schema = StructType(list(df.schema.fields)).add("status", "string").add("output", "string").add("log", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame[input_column]:
                with tempfile.TemporaryDirectory() as folder:
                    source, target = Path(folder, "input"), Path(folder, output_file)
                    source.write_text(text or "", encoding="latin-1", errors="replace")
                    words = [w.format(input=source, output=target) for w in command]
                    try:
                        done = subprocess.run(words, cwd=folder, capture_output=True, text=True, timeout=seconds, check=False)
                    except subprocess.TimeoutExpired:
                        rows.append(("timeout", None, ""))
                        continue
                    made = target.read_text(encoding="latin-1") if target.exists() else None
                    ok = done.returncode == 0 and bool(made)
                    rows.append(("ok" if ok else "run_error", made, done.stdout + done.stderr))
            yield frame.assign(**dict(zip(("status", "output", "log"), map(list, zip(*rows, strict=True)), strict=True))) if rows else frame.assign(status=None, output=None, log=None)

    return df.mapInPandas(run, schema)


_BLOCK = re.compile(r"\{%\s*if\s+(\w+)\s*%\}(.*?)(?:\{%\s*else\s*%\}(.*?))?\{%\s*endif\s*%\}", re.S)
_VALUE = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def render(template: str, values: dict[str, object]) -> str:
    """A script from a template of ``{{ name }}`` and ``{% if name %}...{% else %}...{% endif %}``; an unknown name is an error."""
    chosen = _BLOCK.sub(lambda m: m[2] if values.get(m[1]) else m[3] or "", template)
    return _VALUE.sub(lambda m: str(values[m[1]]), chosen)


def accumulator(log) -> Column:
    """The signed number that a stage's log reports as ``acc 123-`` or ``acc 123+``; null without one."""
    digits, sign = (F.regexp_extract(log, r"(?i)\bacc\w*\W+(\d+)([+-]?)", i) for i in (1, 2))
    return F.when(digits != "", F.when(sign == "-", -digits.cast("bigint")).otherwise(digits.cast("bigint")))


#: Cards that the reservations take at the end of a translated deck (fixed value).
RESERVED = 10
STEP_BUDGET, SECONDS = "50M", 30.0


def translate(df: DataFrame, command: list[str], source: str = "source", seconds: float = SECONDS) -> DataFrame:
    """Adds translate_status, translate_log, upper_acc, pit_raw and pit_cards: compile_error where the accumulator is not zero or no deck comes out."""
    out = run_commands(df, command, source, seconds=seconds)
    cards = D.canonical(splitlines("output"))
    wrong = F.coalesce(accumulator(F.col("log")) != 0, F.lit(False)) | (F.coalesce(F.size(cards), F.lit(0)) <= 0)
    status = F.when(F.col("status") == "timeout", "timeout").when(wrong, "compile_error").otherwise("ok")
    told = (F.col("log").alias("translate_log"), accumulator(F.col("log")).alias("upper_acc"), F.col("output").alias("pit_raw"))
    return out.select(*df.columns, status.alias("translate_status"), *told, F.when(status == "ok", cards).alias("pit_cards"))


def assembly_input(df: DataFrame, dictionary: list[str], cards: str = "pit_cards") -> DataFrame:
    """Adds reservation_cards, translation_body and phase2_cards: the reservations, the dictionary, the body; null for a short deck."""
    parts = D.split_tail(cards, RESERVED)
    names = F.array(*map(F.lit, dictionary)) if dictionary else F.array().cast("array<string>")
    out = df.withColumns({"reservation_cards": parts["tail"], "translation_body": parts["body"]})
    return out.withColumn("phase2_cards", D.joined("reservation_cards", names, "translation_body"))


def _deck_stage(df: DataFrame, command: list[str], cards: str, stage: str, out: str, seconds: float) -> DataFrame:
    status, log, error = f"{stage}_status", f"{stage}_log", f"{stage}_error"
    ready = df.withColumn("_in", F.concat(F.array_join(F.col(cards), "\n"), F.lit("\n")))
    done = run_commands(ready.where(F.col("_in").isNotNull()), command, "_in", seconds=seconds)
    made = splitlines("output")
    good = (F.col("status") == "ok") & (F.coalesce(F.size(made), F.lit(0)) > 0)
    done = done.select(*df.columns, F.when(good, "ok").when(F.col("status") == "timeout", "timeout").otherwise(error).alias(status), F.col("log").alias(log), F.when(good, made).alias(out))
    skipped = ready.where(F.col("_in").isNull()).select(*df.columns, F.lit("skipped").alias(status), F.lit(None).cast("string").alias(log), F.lit(None).cast("array<string>").alias(out))
    return done.unionByName(skipped)


def assemble(df: DataFrame, command: list[str], cards: str = "phase2_cards", seconds: float = SECONDS) -> DataFrame:
    """Adds assemble_status (ok, assemble_error, timeout, skipped), assemble_log and soap_cards."""
    return _deck_stage(df, command, cards, "assemble", "soap_cards", seconds)


def program_deck(df: DataFrame, loader: list[str], data: str | None = None, cards: str = "soap_cards") -> DataFrame:
    """Adds spit_cards: the loader, the assembled cards and the input cards."""
    parts = [F.array(*map(F.lit, loader)) if loader else F.array().cast("array<string>"), F.col(cards)]
    if data:
        parts.append(F.coalesce(F.col(data), F.array().cast("array<string>")))
    return df.withColumn("spit_cards", D.joined(*parts))


def run_programs(df: DataFrame, command: list[str], cards: str = "spit_cards", steps: str = STEP_BUDGET, seconds: float = SECONDS) -> DataFrame:
    """Adds run_status (ok, run_error, timeout, skipped), run_log and output_cards; ``{steps}`` in the command is the step limit."""
    return _deck_stage(df, [w.replace("{steps}", steps) for w in command], cards, "run", "output_cards", seconds)


def pipeline(df: DataFrame, commands: dict[str, list[str]], dictionary: list[str], loader: list[str], source: str = "source", data: str | None = None, steps: str = STEP_BUDGET, seconds: float = SECONDS) -> DataFrame:
    """All stages in order; a row that fails one skips the rest.  ``status`` is the first status other than ok, else ok."""
    rows = translate(df, commands["translate"], source, seconds)
    rows = assemble(assembly_input(rows, dictionary), commands["assemble"], seconds=seconds)
    rows = run_programs(program_deck(rows, loader, data), commands["run"], steps=steps, seconds=seconds)
    failed = [F.when(F.col(c) != "ok", F.col(c)) for c in ("translate_status", "assemble_status", "run_status")]
    return rows.withColumn("status", F.coalesce(*failed, F.lit("ok")))

"""Enrichment of job tables: fill-in joins, prioritised keys, phases and recent runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.dedupe import keep_last


def filled(value, other) -> Column:
    """``value`` unless it is null or empty, else ``other``, which has the same type."""
    value, other = (F.col(c) if isinstance(c, str) else c for c in (value, other))
    return F.coalesce(F.when(value.cast("string") != "", value), other)


def fill_from(df: DataFrame, metadata: DataFrame, key: str, fields: list[str], order: list[str] | None = None, force: bool = False) -> DataFrame:
    """Null and empty fields filled from the last metadata row of the same key; ``force`` lets the metadata win; types stay."""
    meta = keep_last(metadata, [key], order) if order else metadata
    meta = meta.select(key, *(F.col(f).cast(df.schema[f].dataType).alias(f"_m_{f}") for f in fields))
    joined = df.join(meta, key, "left")
    value = {f: filled(f"_m_{f}", f) if force else filled(f, f"_m_{f}") for f in fields}
    return joined.select(*(value[c].alias(c) if c in value else F.col(c) for c in df.columns))


def prioritised(df: DataFrame, other: DataFrame, first: tuple[str, str], second: tuple[str, str], fields: list[str]) -> DataFrame:
    """Columns of ``other`` found by one key pair, else by a second: two equi-joins, no OR."""
    by_first = other.select(F.col(first[1]).alias("_k1"), *(F.col(f).alias(f"_1_{f}") for f in fields), F.lit(True).alias("_hit")).dropDuplicates(["_k1"])
    by_second = other.select(F.col(second[1]).alias("_k2"), *(F.col(f).alias(f"_2_{f}") for f in fields)).dropDuplicates(["_k2"])
    joined = df.join(by_first, F.col(first[0]) == F.col("_k1"), "left").join(by_second, F.col(second[0]) == F.col("_k2"), "left")
    return joined.select(*df.columns, *(F.when(F.col("_hit"), F.col(f"_1_{f}")).otherwise(F.col(f"_2_{f}")).alias(f) for f in fields))


def unmatched(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return df.join(other.select(on).distinct(), on, "left_anti")


def detached(jobs: DataFrame, active: DataFrame, on: str = "local_output", status: str = "status") -> DataFrame:
    """Saved jobs with an output that no active job writes and that are not complete."""
    rows = unmatched(jobs.where(F.coalesce(F.col(on), F.lit("")) != ""), active, on)
    return rows.where(F.coalesce(F.col(status) != "complete", F.lit(True)))


# -- phases ---------------------------------------------------------------------------------------------------------

#: Modes in the order in which their progress counts (fixed values), and the marks of processes.
MODES = ("fine_tuned", "few_shot", "zero_shot")
GENERATING, TRAINING, PREPARING = (r"cli run-inference",), (r"cli train-eval", r"cli overfit-sanity"), (r"apt-get", r"pip install", r"python3 -m venv")
#: Fields of the struct that describes a remote run.
REMOTE = (
    "struct<error:string,status:string,progress:map<string,struct<lines:bigint,expected:bigint>>,process:string,bootstrap_process:string,"
    "training:struct<current:bigint,total:bigint>,repo_exists:boolean,output_exists:boolean,active_process:boolean,phase:string>"
)


def first_of(*rules: tuple[Column, object]) -> Column:
    """The value of the first rule that holds, else null; an unknown condition does not hold."""
    out = F
    for condition, value in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), value)
    return out


def _said(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("")) != ""


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    return F.coalesce(text, F.lit("")).rlike("|".join(marks))


def remote_step(remote) -> Column:
    """How far a remote run is: ``train n/m``, the mode that is under way, training, or null."""
    r = F.col(remote) if isinstance(remote, str) else remote
    under_way = [((r["progress"][m]["lines"] > 0) & (r["progress"][m]["lines"] < r["progress"][m]["expected"]), F.lit(m)) for m in MODES]
    train = F.format_string("train %d/%d", F.coalesce(r["training"]["current"], F.lit(0)), r["training"]["total"])
    steps = first_of((r["training"]["total"] > 0, train), *under_way, (r["active_process"], F.lit("training")))
    return F.when(~_said(r["error"]), steps)


def remote_phase(remote) -> Column:
    """Phase of a remote run by its process, files and progress; null without one."""
    r = F.col(remote) if isinstance(remote, str) else remote
    no = lambda c: ~F.coalesce(c, F.lit(False))
    generate, train, prepare, failed = (F.lit(x) for x in ("remote_generate", "remote_train", "remote_bootstrap", "failed"))
    rules = first_of(
        (_said(r["error"]) | (r["status"] == "failed"), failed),
        (F.exists(F.map_values(F.coalesce(r["progress"], F.create_map().cast("map<string,struct<lines:bigint,expected:bigint>>"))), lambda x: x["lines"] > 0), generate),
        (_any(r["process"], GENERATING), generate), (_any(r["process"], TRAINING) | r["training"].isNotNull(), train),
        (_any(r["bootstrap_process"], PREPARING) | no(r["repo_exists"]), prepare), (no(r["output_exists"]), train),
        (r["active_process"], F.coalesce(remote_step(r), train)), (F.lit(True), F.lit("remote_complete")),
    )
    return F.when(r.isNotNull(), rules)


def output_phase(state, summary_exists, reports, expected) -> Column:
    """failed, local_reevaluate, complete or pending, by a finalizer's state and the files that are there."""
    state, summary, reports, expected = (F.col(c) if isinstance(c, str) else c for c in (state, summary_exists, reports, expected))
    return first_of(
        (state == "failed", F.lit("failed")), (state.isNotNull(), F.lit("local_reevaluate")), (summary & (reports == expected), F.lit("complete")),
        (summary | (reports > 0), F.lit("local_reevaluate")), (F.lit(True), F.lit("pending")),
    )


def job_phase(remote, local, detached_job, summary_exists, archive_bytes) -> Column:
    """Phase of a job by its remote run, its local output's phase and its archive; the first rule that holds."""
    r, local, own, summary, archive = (F.col(c) if isinstance(c, str) else c for c in (remote, local, detached_job, summary_exists, archive_bytes))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    generate, train = F.lit("remote_generate"), F.lit("remote_train")
    running = first_of((_said(r["phase"]), r["phase"]), (r["training"].isNotNull(), train), (remote_step(r).isNotNull(), generate), (F.lit(True), train))
    return first_of(
        (own & r["active_process"], running), (local.isin("failed", "local_reevaluate", "complete"), local),
        (r.isNull() & (archive > 0), F.lit("remote_bootstrap")), (r.isNull(), F.lit("launching")), (_said(r["error"]), F.lit("failed")),
        (no(r["repo_exists"]), F.lit("remote_bootstrap")), (no(r["output_exists"]), train),
        (r["active_process"], F.when(remote_step(r).isNotNull(), generate).otherwise(train)), (summary, F.lit("local_reevaluate")), (F.lit(True), generate),
    )


def phase_class(phase) -> Column:
    """good, accent, bad or warn."""
    p = F.col(phase) if isinstance(phase, str) else phase
    return first_of(
        (p == "complete", F.lit("good")), (p.isin("remote_bootstrap", "remote_train", "remote_generate", "local_reevaluate"), F.lit("accent")),
        (p.isin("failed", "runpod_error"), F.lit("bad")), (F.lit(True), F.lit("warn")),
    )


# -- command lines --------------------------------------------------------------------------------------------------


def shell_words(command) -> Column:
    """Words of a command line; quoted parts are one word, without their quotes."""
    c = F.col(command) if isinstance(command, str) else command
    parts = F.regexp_extract_all(c, F.lit(r"""((?:"[^"]*"|'[^']*'|[^\s"'])+)"""), F.lit(1))
    return F.transform(parts, lambda w: F.regexp_replace(w, r"""["']""", ""))


def flags(command, script: str) -> Column:
    """map of the flags after ``script``: ``--a-b x y`` is a_b -> ``x y``, a flag without words is ``true``, the last of a name holds.

    An empty map where the command does not run the script.
    """
    words = shell_words(command)
    mark = "\ue000"
    at = F.array_position(F.transform(words, lambda w: F.element_at(F.split(w, "/"), -1) == script), True)
    after = F.when(at > 0, F.slice(words, at.cast("int") + 1, F.greatest(F.size(words) - at.cast("int"), F.lit(0)))).otherwise(F.slice(words, 1, 0))
    pieces = F.split(F.concat(F.lit(mark), F.array_join(after, mark)), f"{mark}--")
    named = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def entry(piece):
        name = F.regexp_replace(F.element_at(F.split(piece, mark), 1), "-", "_")
        rest = F.array_join(F.slice(F.split(piece, mark), 2, 1 << 20), " ")
        return F.struct(name.alias("key"), F.when(rest == "", F.lit("true")).otherwise(rest).alias("value"))

    entries = F.transform(named, entry)
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.element_at(F.transform(F.array(entries), last), 1))


def process_table(lines: DataFrame, script: str, column: str = "value") -> DataFrame:
    """Jobs from lines of a process list (pid, elapsed, command): their flags as columns; other lines are dropped."""
    shape = r"^\s*(\d+)\s+(\S+)\s+(.*)$"
    rows = lines.where(F.col(column).rlike(shape) & F.col(column).contains(script))
    pid, elapsed, command = (F.regexp_extract(column, shape, i) for i in (1, 2, 3))
    rows = rows.select(pid.cast("bigint").alias("pid"), elapsed.alias("elapsed"), command.alias("command"))
    rows = rows.withColumn("_f", flags("command", script))
    text = lambda k: F.col("_f")[k]
    names = ("name", "run_mode", "gpu_id", "dataset_name", "dataset_index", "remote_output", "local_output")
    count = F.coalesce(text("example_count"), text("max_examples")).try_cast("bigint")
    return rows.select(
        "pid", "elapsed", "command", *(text(k).alias(k) for k in names), text("limit").try_cast("bigint").alias("limit"), count.alias("example_count"),
        text("pod_id").alias("pod_id_arg"), text("detach_remote").isNotNull().alias("detached"),
    )


def recent(df: DataFrame, time: str, n: int = 8, tie: str | None = None) -> DataFrame:
    """The last n rows by time; ``tie`` decides between rows of one time."""
    return df.orderBy(F.desc(time), *([tie] if tie else [])).limit(n)


def progress(df: DataFrame, mode: str, expected: dict[str, int]) -> DataFrame:
    """(mode, n, expected, share) of lines already there."""
    want = F.create_map(*[F.lit(x) for k, v in sorted(expected.items()) for x in (k, v)])[F.col(mode)]
    return df.groupBy(mode).agg(F.count("*").alias("n")).withColumn("expected", want).withColumn("share", F.col("n") / F.col("expected"))


# -- waiting and caching --------------------------------------------------------------------------------------------


def wait_until(ready: Callable[[], object], seconds: float, every: float = 10.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
    """The first true result of ``ready``; TimeoutError after ``seconds``.  It is asked at least once."""
    end = clock() + seconds
    while not (got := ready()):
        left = end - clock()
        if left <= 0:
            raise TimeoutError(f"not ready after {seconds} seconds")
        sleep(min(every, left))
    return got


class Snapshot:
    """A value that is made anew when it is older than ``seconds``."""

    def __init__(self, make: Callable[[], object], seconds: float = 5.0, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock = make, seconds, clock
        self.value, self.at = None, None

    def get(self):
        now = self.clock()
        if self.at is None or now - self.at >= self.seconds:
            self.value, self.at = self.make(), now
        return self.value

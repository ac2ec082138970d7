"""Reading and writing record tables, decks and file sets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from millrace.functions.text import splitlines
from millrace.sources.trees import read_tree

#: Schemas of the record kinds (fixed field names); explicit, so nothing is inferred.
_LOGS = "console_log:string,stdout_log:string,print_log:string"
REFERENCE = (
    "id string, band string, seed bigint, runtime_package string, source_format string, "
    "source struct<it_text_v1:string, header:struct<n_i:int,n_y:int,n_c:int,n_s:int,n_pkg:int,N:int>>, "
    "hashes struct<surface_hash:string, alpha_hash:string, shape_hash:string, pit_hash:string>, "
    f"reference struct<translate:struct<status:string,upper_acc:bigint,pit_raw:string,pit_raw_canonical:string,reservation_cards:string,translation_body:string,{_LOGS}>,"
    f"assemble:struct<status:string,pit_phase2_input_p1:string,soap_output:string,{_LOGS}>,run:struct<status:string,input_deck:string,spit_p1:string,output_deck:string,{_LOGS}>>, "
    "generator struct<ast_json:string, bounds_json:string, features:array<string>>, "
    "provenance struct<simh_source:string, simh_commit_or_checksum:string, generator_version:string, normalizer_version:string>"
)
PREDICTION = (
    "id string, mode string, band string, pit_raw_canonical string, prompt_path string, retrieval map<string,string>, "
    "raw_completion_path string, thinking_trace_path string, "
    "metrics struct<exact_match:boolean, per_card_exact:double, normalized_edit_distance:double>, "
    "assemble struct<status:string>, run struct<status:string>, assemblable boolean, functional boolean, failure_type string, "
    "timings struct<generation_seconds:double, evaluation_seconds:double, total_seconds:double>"
)
SFT = "prompt string, completion string, target_text string, id string, source_text string, source_alpha string, band string, repeat_index int"
REJECTION = "band string, seed bigint, status string, reason string"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, missing_ok: bool = True) -> DataFrame:
    """Records of a JSON-lines path; blank lines are skipped, a wrong one is an error, a missing path is an empty table."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a path by the table; the committer makes it appear as a whole."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def count_records(spark: SparkSession, path: str) -> int:
    """Lines that are not blank; a missing path is an error."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_decks(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, cards): one row for each file, as Latin-1 lines."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", splitlines(F.decode("content", "ISO-8859-1")).alias("cards"))


def deck_text(cards) -> Column:
    """Lines joined by LF, with a final LF if there are any."""
    c = F.col(cards) if isinstance(cards, str) else cards
    return F.when(F.size(c) > 0, F.concat(F.array_join(c, "\n"), F.lit("\n"))).otherwise("")


def resolve_path(path, base: str) -> Column:
    """An absolute path as it is, else below ``base``."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))


def record_base(index: str) -> str:
    """The folder that paths of an index are relative to: above ``splits``, else its own."""
    folder = index.rpartition("/")[0]
    return folder.rpartition("/")[0] if folder.rpartition("/")[2] == "splits" else folder


def rewrite_prefix(df: DataFrame, fields: list[str], old: str, new: str) -> DataFrame:
    """String fields, nested ones by dotted name, with a leading ``old`` replaced by ``new``."""
    for f in fields:
        top, _, rest = f.partition(".")
        value = F.when(F.col(f).startswith(old), F.concat(F.lit(new), F.substring(F.col(f), len(old) + 1, 1 << 30))).otherwise(F.col(f))
        df = df.withColumn(top, F.col(top).withField(rest, value) if rest else value)
    return df


def map_strings(value: Column, kind: DataType, change) -> Column:
    """The value with ``change`` applied to every string in it, in structs, arrays and the values of maps, however deep."""
    if not _has_strings(kind):
        return value
    if isinstance(kind, StringType):
        return change(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: map_strings(x, kind.elementType, change))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: map_strings(x, kind.valueType, change))
    made = F.struct(*(map_strings(value.getField(f.name), f.dataType, change).alias(f.name) for f in kind.fields))
    return F.when(value.isNotNull(), made)


def _has_strings(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_strings(f.dataType) for f in kind.fields)
    if isinstance(kind, (ArrayType, MapType)):
        return _has_strings(kind.elementType if isinstance(kind, ArrayType) else kind.valueType)
    return isinstance(kind, StringType)


def moved(value: Column, old: str, new: str) -> Column:
    """The text with a leading ``old`` replaced by ``new``."""
    return F.when(value.startswith(old), F.concat(F.lit(new), F.substring(value, len(old) + 1, 1 << 30))).otherwise(value)


def rewrite_strings(df: DataFrame, old: str, new: str) -> DataFrame:
    """Every string of every column, at any depth, with a leading ``old`` replaced by ``new``; map keys stay, nulls stay."""
    return df.select(*(map_strings(F.col(f"`{f.name}`"), f.dataType, lambda x: moved(x, old, new)).alias(f.name) for f in df.schema.fields))


def rewrite_json(text, old: str, new: str) -> Column:
    """The same for a JSON document of any structure, as text; keys are sorted, a text that is no JSON is null.

    In a document without free white space a quote after a colon, comma or
    bracket opens a string, as quotes inside strings have a backslash before
    them; a string with a colon behind it is a key.
    """
    text = F.col(text) if isinstance(text, str) else text
    old, new = (json.dumps(x, ensure_ascii=False)[1:-1] for x in (old, new))
    quoted = "".join("\\" + x if x in r"\.^$|?*+()[]{}/-" else x for x in old)
    pattern = rf'((?:^|[:,\[])"){quoted}(?=(?:[^"\\]|\\.)*"(?!:))'
    return F.regexp_replace(F.to_json(F.try_parse_json(text)), pattern, "$1" + new.replace("\\", "\\\\").replace("$", "\\$"))


def sample_roots(df: DataFrame, path: str, depth: int) -> DataFrame:
    """Distinct first ``depth`` parts of a path."""
    return df.select(F.substring_index(path, "/", depth).alias("root")).distinct()


def summaries(spark: SparkSession, path: str, name: str = "summary.json", keys: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, modified, body): JSON documents found below a folder, readable and with one of ``keys``, outside ``skip`` folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    if skip:
        files = files.where(~F.arrays_overlap(parts, F.array(*(F.lit(s) for s in skip))))
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.try_parse_json(F.decode("content", "UTF-8")).alias("body"))
    rows = rows.where(F.col("body").isNotNull())
    if keys:
        has = F.lit(False)
        for k in keys:
            has = has | F.try_variant_get("body", f"$.{k}", "variant").isNotNull()
        rows = rows.where(has)
    return rows


def source_lock(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


#: Text fields and number fields of a saved job (fixed names).
JOB_FIELDS = ("name", "run_mode", "dataset_name", "dataset_index", "remote_output", "local_output", "pod_id", "status")
JOB_NUMBERS = ("limit", "example_count")


def job_metadata(spark: SparkSession, path: str, name: str = ".runpod_job.json") -> DataFrame:
    """Saved jobs below a folder: path and fields; of several files of one local_output the last by path holds, those without one are dropped.

    Executors list and read the files, dot-files too.
    """
    found = read_tree(spark, path, name).select("path", F.try_parse_json(F.decode("content", "UTF-8")).alias("body")).where(F.col("body").isNotNull())
    fields = [F.try_variant_get("body", f"$.{f}", "string").alias(f) for f in JOB_FIELDS] + [F.try_variant_get("body", f"$.{f}", "bigint").alias(f) for f in JOB_NUMBERS]
    rows = found.select("path", *fields).where(F.coalesce("local_output", F.lit("")) != "")
    return rows.groupBy("local_output").agg(F.max_by(F.struct("path", *(f for f in (*JOB_FIELDS, *JOB_NUMBERS) if f != "local_output")), "path").alias("j")).select("local_output", "j.*")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A small JSON object; a missing file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    made = json.loads(spark.read.text(path, wholetext=True).first().value)
    if not isinstance(made, dict):
        raise ValueError(f"{path} is no JSON object")
    return made

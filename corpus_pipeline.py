"""The training-data pipeline: five stages over ``documents``, each on all that the stage before it kept.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of documents, also
where those have names of their own beside doc_id, text, lang, source, n_chars.
Rows alike in doc_id and text are one document, which stays or goes as a whole;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, lines, pieces, quality
from millrace.llm._store import free_name, stored
from millrace.llm.queries import PIECE_MODEL
from millrace.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the co-trained classifier rejects, as of bad quality or toxic.

    Null, empty and white texts have nothing to judge and stay, whatever their
    doc_id.  Without usable labels everything stays.
    """
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")), keep_columns=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts, and documents that held nothing else; n_chars follows the text.

    The first copy by doc_id (null last), text hash and line stays.  Null and
    empty texts stay as they are.
    """
    ship(spark)
    removed = F.col(free_name(docs.columns, "n_removed"))
    cut = lines.dedup_lines(docs, details=True, whole_runs=True)
    gone = (removed > 0) & (F.trim(F.col("text")) == "")
    chars = F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", chars).select(*(F.col(f"`{c}`") for c in docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the first by doc_id (null last) and text hash stays; texts without words all stay."""
    ship(spark)
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text contains a benchmark item go; null and empty texts and items match nothing."""
    return decontaminate.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the n best segmentations, their scores and the round trip of each row; null and empty texts have no ids."""
    ship(spark)
    return pieces.encode(docs, PIECE_MODEL)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: Co-training and line runs are beyond SQL; tests/llm/test_pipeline.py compares run() with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read by the next."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs

"""Token counts and training rows by a public tokenizer file; the only part that needs Python is the tokenizer itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import token_labels, trainable


def tokenizer(path: str):
    """Column function: array of ids of a text by the tokenizer file at ``path``, which every executor can read; null stays null."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)  # once for each task
        for texts in batches:
            there = texts.notna()
            ids = iter(model.encode_batch(texts[there].tolist(), add_special_tokens=False))
            yield pd.Series([next(ids).ids if x else None for x in there])

    return encode


def n_tokens(text, path: str) -> Column:
    """Number of tokens of a text; null for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNotNull(), F.size(tokenizer(path)(c)))


def training_rows(df: DataFrame, path: str, longest: int, prompt: str = "prompt", completion: str = "completion", end: str = "") -> DataFrame:
    """``df`` with input_ids, attention_mask and labels, without the rows whose completion the cut takes away."""
    encode = tokenizer(path)
    tokens = df.withColumns({"_p": encode(F.col(prompt)), "_c": encode(F.concat(F.col(completion), F.lit(end)))})
    rows = tokens.withColumn("_t", token_labels("_p", "_c", longest)).where(trainable("_t.labels"))
    return rows.select(*df.columns, "_t.input_ids", "_t.attention_mask", "_t.labels")

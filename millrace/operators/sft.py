"""Training rows: prompts, completions and repetition by band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def band_map(values: dict[str, int], column, default: int = 1) -> Column:
    """A band's number from a literal map, ``default`` where it has none."""
    column = F.col(column) if isinstance(column, str) else column
    if not values:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (k, int(v))])[column], F.lit(default))


def parse_band_numbers(text: str | None, separator: str = "=") -> dict[str, int]:
    """``B0=2,B1=3`` (or with another separator) as a map; a part without the separator is an error."""
    out = {}
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        name, sep, n = part.partition(separator)
        if not sep:
            raise ValueError(f"expected BAND{separator}N, got {part!r}")
        out[name.strip().upper()] = int(n)
    return out


def parse_bands(text: str) -> list[str]:
    """``b1, B3`` as [B1, B3]; none at all is an error."""
    bands = [b for b in (p.strip().upper() for p in text.split(",")) if b]
    if not bands:
        raise ValueError("no bands given")
    return bands


def repeated(df: DataFrame, repeats: dict[str, int], band: str = "band") -> DataFrame:
    """Each row as often as its band says (1 by default, and at least), numbered by repeat_index from 0."""
    n = F.greatest(F.lit(1), band_map(repeats, band))
    return df.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("repeat_index"))


def sft_rows(df: DataFrame, prompt: Column, completion: Column, repeats: dict[str, int], ident: str = "id", band: str = "band") -> DataFrame:
    rows = df.select(prompt.alias("prompt"), completion.alias("completion"), F.col(ident).alias("id"), F.col(band).alias("band"))
    return repeated(rows, repeats, "band")


def training_rows(df: DataFrame, source: str, target: str, system: str, repeats: dict[str, int], ident: str = "id", band: str = "band") -> DataFrame:
    """All columns of a training row: prompt, completion, target_text, id, source_text, source_alpha, band and repeat_index."""
    rows = df.select(
        T.prompt(source, system).alias("prompt"), T.wrap_completion(target).alias("completion"), F.col(target).alias("target_text"), F.col(ident).alias("id"),
        F.col(source).alias("source_text"), T.alpha_normalise(source).alias("source_alpha"), F.col(band).alias("band"),
    )
    return repeated(rows, repeats, "band")

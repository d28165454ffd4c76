"""Between wide and long, and from packed to single values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks of a score payload.
CHUNK = "struct<start_token:int,end_token:int,start_char:int,end_char:int,tokens:int,trust:double,threat:double,excerpt:string>"
PAYLOAD = (
    "entity_id string, year int, text_hash string, spec_hash string, trust_score double, threat_score double, model_token_count int, tokens_scored int, token_coverage double, "
    f"chunk_count int, chunk_tokens_min int, chunk_tokens_median double, chunk_tokens_max int, chunks array<{CHUNK}>"
)
# Markers in cells of the spending sheet.
NOT_INDEPENDENT = "xxx"
UNAVAILABLE = ("...", "..", ". .")


def long_form(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str, keep_null: bool = True) -> DataFrame:
    """One row per id and column; null cells stay unless ``keep_null`` is off."""
    out = df.unpivot(list(ids), list(columns), name, value)
    return out if keep_null else out.where(F.col(value).isNotNull())


def wide_form(df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str], value: Column) -> DataFrame:
    """One column per listed name; the list is given, so no pass is spent on finding it."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(value)


def labels(df: DataFrame, column: str, pattern: str = r"\s*[,;|]\s*", name: str = "label") -> DataFrame:
    """One row per label of a plainly delimited field, with its position from 0."""
    return df.select("*", F.posexplode(F.split(column, pattern)).alias("label_pos", name))


def payload(c: Column) -> Column:
    """A score payload; null where it is broken."""
    return F.from_json(c, PAYLOAD)


def passages(df: DataFrame, text: str, chunks: str) -> DataFrame:
    """One row per chunk with its place and the text between its characters (counted from 0, end exclusive)."""
    out = df.select("*", F.posexplode(chunks).alias("chunk_no", "chunk"))
    return out.withColumn("passage", F.expr(f"substring({text}, chunk.start_char + 1, chunk.end_char - chunk.start_char)"))


def cell_status(c: Column, is_number: Column) -> Column:
    """Status of a spending cell: observed for numbers, by its marker for text, else blank."""
    marker = F.trim(c)
    return F.when(is_number, "observed").when(marker == NOT_INDEPENDENT, "not_independent_or_nonexistent").when(marker.isin(*UNAVAILABLE), "unavailable").otherwise("blank")


def right_closed(c: Column, bounds: Sequence[float], names: Sequence[str]) -> Column:
    """Names of the bins (a, b]; null outside."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(bounds[:-1], bounds[1:], names))):
        out = F.when((c > low) & (c <= high), name).otherwise(out)
    return out

"""Small helpers on DataFrames for the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut_lineage


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """`df` written once and counted: broadcast if it has `most` narrow rows or fewer, else an ordinary join side."""
    df = cut_lineage(df, "side")
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Tells rows apart that share an id (or have none) but not the text. Use it beside the id, never alone."""
    return F.xxhash64(F.col(text_col))


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.select(F.sum(F.octet_length(text_col)).alias("n")).first()[0] or 0)

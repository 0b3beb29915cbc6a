"""Column selection shared by the operators: only what is needed, under names of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null becomes empty) and the columns in ``more``; all else is left out."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
        *(df[c] for c in more),
    )


def fold(id_column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the fold of a document (-1 for a null id)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus, F.lit(-1))

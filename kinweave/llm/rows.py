"""Documents as one value each, so that no column of theirs can clash with ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(documents: DataFrame, *columns: str) -> DataFrame:
    """``row`` with all columns, besides doc_id (long), text and the named ones."""
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    return documents.select(whole, F.col("doc_id").cast("long").alias("doc_id"), "text", *columns)


def unpacked(rows: DataFrame) -> DataFrame:
    """The documents' own columns again."""
    return rows.select("row.*")

"""Bounded, reproducible samples of labelled documents for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) mod 4 is this never teach a model.
HELD_OUT, FOLDS = 2, 4


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a null doc_id is not, as it has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_texts(documents: DataFrame, labels: DataFrame, label: str, bound: int, seed: int) -> DataFrame:
    """Texts and labels (text, y) of at most ``bound`` labelled rows.

    The rows with the smallest hashes of (seed, doc_id) are taken, so the
    sample is the same on every run and of one size however large the tables
    are; only its ids are broadcast.  Rows without a label, without a doc_id
    or kept from training are never taken; a doc_id with contradicting labels
    counts with the larger one, and one with several texts with the smallest.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).filter("_id is not null and y is not null").filter(~held_out(F.col("_id")))
    known = documents.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    chosen = usable.groupBy("_id").agg(F.max("y").alias("y")).join(known, "_id", "left_semi").orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(bound)
    texts = documents.select(F.col("doc_id").cast("long").alias("_id"), "text")
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

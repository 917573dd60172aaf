"""Source rows as a stream: each micro-batch is merged as one delta."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators import scd2
from kinweave.sources.tables import read_optional, write_table


def stream_rows(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def batch_time(batch_id: int, start: str = "2026-01-01") -> Column:
    """A time that depends on the batch only, so a batch that is run again merges alike."""
    return F.timestamp_add("SECOND", F.lit(batch_id), F.lit(start).cast("timestamp"))


def merge_stream(rows: DataFrame, to_incoming: Callable[[DataFrame, Column], DataFrame], merge: Callable[[DataFrame, DataFrame, Column], DataFrame], folder: str, name: str, schema: str, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch of ``rows`` into the versioned table ``folder/name``.

    ``to_incoming`` makes table rows of source rows; ``merge`` is one of
    ``operators.scd2``.  Merges are idempotent, so a batch that is repeated
    after a failure changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        at = batch_time(batch_id)
        held = read_optional(batch.sparkSession, folder, name, schema)
        write_table(merge(held, to_incoming(batch, at), at), folder, name)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_windows(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts per key and time window; rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(*keys, F.window(time, width)).agg(F.count("*").alias("n_rows"))


merge_parties, merge_attributes, merge_relationships = scd2.merge_parties, scd2.merge_attributes, scd2.merge_relationships

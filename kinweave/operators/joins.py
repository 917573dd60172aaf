"""Equi-joins that deal hot keys out over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot beyond this many rows.  Only the hottest keys are dealt out, so
#: the table of them can always be broadcast; any other key of a larger table
#: holds less than ``1 / HOT_KEYS`` of its rows.
HOT_ROWS, HOT_KEYS = 256, 10_000
#: Parts that a key is dealt over at most: in a join, and on each side of a self-join.
MOST_PARTS, MOST_CHUNKS = 4096, 32


def hot_keys(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, _parts): the hottest keys of ``counts`` (keys, n), and into how many parts each is dealt."""
    parts = F.least(F.ceil(F.col("n") / HOT_ROWS), F.lit(most)).cast("int")
    return counts.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), *keys).limit(HOT_KEYS).select(*keys, parts.alias("_parts"))


def _counted(rows: DataFrame, keys: list[str], counts: DataFrame | None, most: int) -> DataFrame:
    return F.broadcast(hot_keys(rows.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts, keys, most))


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join ``left``, whose keys may be hot, with ``right``, which has few rows per key.

    Rows of a hot key are dealt over parts by a hash of all their columns, and
    the rows of ``right`` with that key are repeated for each part.  ``counts``
    (keys, n) says how many rows ``left`` has by key, where that is known.
    ``how`` is inner or left; the other columns' names must differ.
    """
    hot = _counted(left, keys, counts, MOST_PARTS)
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.col("_parts"))).otherwise(0).cast("int")
    dealt = left.join(hot, keys, "left").withColumn("_part", part).drop("_parts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return dealt.join(right.join(hot, keys, "left").withColumn("_part", each).drop("_parts"), [*keys, "_part"], how).drop("_part")


def dealt_pairs(rows: DataFrame, keys: list[str], one: dict[str, str], two: dict[str, str], counts: DataFrame | None = None, by: list[str] | None = None, spread: bool = False) -> DataFrame:
    """The self-join of ``rows`` on ``keys``, its columns renamed by ``one`` and ``two``.

    Every ordered pair of rows comes out once, as in a plain self-join; the
    pairs of any two chunks of a hot key are a task's work of their own.  A row
    of a hot key is repeated once per chunk of that key.  Rows go to chunks by a
    hash of the columns ``by``, else of all.  ``spread`` keeps the session's
    number of shuffle partitions: the pairs of few rows may be many, which the
    size of the rows, by which partitions are merged, does not show.
    """
    hot = _counted(rows, keys, counts, MOST_CHUNKS)
    parts = F.coalesce("_parts", F.lit(1))
    chunked = rows.join(hot, keys, "left").withColumn("_chunk", F.pmod(F.xxhash64(*(by or rows.columns)), parts).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    left = chunked.select(*keys, F.col("_chunk").alias("_x"), F.col("_other").alias("_y"), *[F.col(c).alias(n) for c, n in one.items()])
    right = chunked.select(*keys, F.col("_other").alias("_x"), F.col("_chunk").alias("_y"), *[F.col(c).alias(n) for c, n in two.items()])
    on = [*keys, "_x", "_y"]
    if spread:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    return left.join(right, on).drop("_x", "_y")

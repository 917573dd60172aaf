"""How much data a Python worker is handed at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of rows in one Arrow batch.  Texts may be long, so a bound on rows alone doesn't bound memory.
BATCH_BYTES = "4m"


#: Spark's own bound, which a session that sets nothing has.
_DEFAULT = "67108864b"
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session close at ``BATCH_BYTES``, unless it has a bound of its own.

    Plans read the setting when they run, so it has to stay; a session that
    sets it keeps its own value.
    """
    if spark.conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        spark.conf.set(_SETTING, BATCH_BYTES)

"""Let Python workers import this package from where the driver found it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def share_package(spark: SparkSession) -> None:
    """Add the folder that holds this package to the workers' import path.

    Enough where workers see the same path as the driver; on other clusters
    ship the package with ``--py-files``.
    """
    home = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])


#: Tables up to this size are sent to all executors where Spark chooses to; the driver's heap holds several of them, unpacked, at once.
BROADCAST_BYTES = "1m"
#: Spark's own bound, which a session that sets nothing has.
_DEFAULT = "10485760b"
_SETTING = "spark.sql.autoBroadcastJoinThreshold"


def bound_broadcasts(spark: SparkSession) -> None:
    """Let Spark broadcast tables of ``BROADCAST_BYTES`` at most in this session, unless it has a bound of its own.

    Sizes are those of packed files and shuffles; a hash table may be many times that.
    """
    if spark.conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        spark.conf.set(_SETTING, BROADCAST_BYTES)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete a query's shuffle files when it ends, unless the session has a setting of its own.

    Else they stay until the driver happens to collect its garbage, those of
    every table that a query writes on its way beside each other.
    """
    if spark.conf.get(_CLEANUP, None) is None:
        spark.conf.set(_CLEANUP, "true")

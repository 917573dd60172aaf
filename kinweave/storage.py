"""Tables that cut lineage: written once to the folder all executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Only a local session
without that setting gets a folder of its own; on a cluster its absence is an
error, because a machine-local folder would be invisible to other executors.
The folder of an application is deleted when its driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOTS: dict[str, str] = {}
_HELD: dict[str, dict] = {}
_CLEARED: set[str] = set()


class Lazy(Mapping):
    """Tables by name, each built when it is first asked for."""

    def __init__(self, **build: Callable[[], DataFrame]):
        self._build = build
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build[name]()
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._build

    def __iter__(self) -> Iterator[str]:
        return iter(self._build)

    def __len__(self) -> int:
        return len(self._build)


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _OWN_ROOTS:
            _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        root = _OWN_ROOTS[app]
    own = f"{root.rstrip('/')}/kinweave-{app}"
    if own not in _CLEARED:
        _CLEARED.add(own)
        _clear_at_exit(spark, own)
    return own


def _clear_at_exit(spark: SparkSession, own: str) -> None:
    """Delete the folder when the driver's process ends, as no plan can read it after."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def delete() -> None:
        with contextlib.suppress(Exception):  # the process ends in any case
            path = jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(conf).delete(path, True)

    atexit.register(delete)


def held(spark: SparkSession) -> dict:
    """What queries of this application may keep for each other; ``clear`` empties it."""
    return _HELD.setdefault(spark.sparkContext.applicationId, {})


def shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    The scan has no lineage to ``df``: a lost executor costs the re-read of a
    few files, never the recomputation of what came before.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialized table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_root(spark)
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() == root.rsplit("/", 1)[1]:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; no plan may read them after."""
    held(spark).clear()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

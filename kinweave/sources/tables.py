"""Reading and writing tables by name: CSV or Parquet, full or delta."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType, TimestampType

from kinweave import schemas
from kinweave.profiles import DEFAULT, Profile, list_profiles, load_profile

# Words that mean NULL in a CSV file.
NULL_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _fs(spark, path)
    return fs.exists(hadoop)


def _aside(folder: str, name: str, fmt: str) -> str:
    """Where a table's last version stands while its successor takes its place."""
    return f"{folder}/.{name}.{fmt}.last"


def _move(spark: SparkSession, source: str, target: str) -> None:
    to, fs = _fs(spark, target)
    if not fs.rename(_fs(spark, source)[0], to):
        raise OSError(f"could not move {source} to {target}")


def _recover(spark: SparkSession, folder: str, name: str, fmt: str) -> None:
    """Put a version back that a write moved aside and could not replace."""
    target, last = f"{folder}/{name}.{fmt}", _aside(folder, name, fmt)
    if not exists(spark, target) and exists(spark, last):
        _move(spark, last, target)


def find_table(spark: SparkSession, folder: str, name: str) -> str | None:
    """The path of a table in a folder, Parquet before CSV; None if missing."""
    for fmt in ("parquet", "csv"):
        _recover(spark, folder, name, fmt)
    return next((p for p in (f"{folder}/{name}.parquet", f"{folder}/{name}.csv") if exists(spark, p)), None)


def _typed(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast string columns to declared types; columns not in the file are null, others go."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, BooleanType):
            out.append(F.expr(f"try_cast(lower(`{f.name}`) AS boolean)").alias(f.name))
        elif isinstance(f.dataType, TimestampType):
            out.append(F.expr(f"try_to_timestamp(`{f.name}`)").alias(f.name))
        else:
            out.append(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; the words of ``NULL_WORDS`` are NULL.

    Without a schema all columns stay strings, so keys such as ``007`` and bad
    dates survive as they are.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.select(*[F.when(F.col(f"`{c}`").isin(NULL_WORDS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return _typed(raw, StructType.fromDDL(schema)) if schema else raw


def read_path(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return read_csv(spark, path, schema) if path.endswith(".csv") else spark.read.parquet(path)


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A table that must exist; raises before anything is planned if it doesn't."""
    path = find_table(spark, folder, name)
    if path is None:
        raise FileNotFoundError(f"table {name} is missing in {folder}")
    return read_path(spark, path, schema)


def read_optional(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame | None:
    """A table, or None where it is missing (an empty one if a schema is given)."""
    path = find_table(spark, folder, name)
    if path is not None:
        return read_path(spark, path, schema)
    return spark.createDataFrame([], schema) if schema else None


def current(df: DataFrame) -> DataFrame:
    """Rows of the current snapshot: no end date, where the table has one."""
    return df.filter(F.col("rec_end_date").isNull()) if "rec_end_date" in df.columns else df


@dataclass(frozen=True)
class Sources:
    """Source files ``<system>_<table>``: a full folder and, for a delta run, a delta folder."""

    spark: SparkSession
    full: str
    delta: str | None = None

    @staticmethod
    def file_name(system: str, table: str) -> str:
        return f"{system.lower()}_{table}"

    def changed(self, system: str, table: str) -> DataFrame | None:
        """Rows to ingest: of the delta in a delta run, else all; None if missing."""
        return read_optional(self.spark, self.delta or self.full, self.file_name(system, table))

    def whole(self, system: str, table: str) -> DataFrame | None:
        """All rows, for the target side of relationships."""
        return read_optional(self.spark, self.full, self.file_name(system, table))

    def bridge(self, system: str, table: str) -> DataFrame | None:
        """A bridge table: of the delta if it is there, else the full one."""
        found = self.changed(system, table)
        return found if found is not None else self.whole(system, table)


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet") -> None:
    """Replace a table.  The new one is written beside it and swapped in, so
    ``df`` may read the table that it replaces.

    The old version is moved aside before the new one takes its place, and
    deleted last; where a write dies between these steps, the next read or
    write puts the old version back.
    """
    spark = df.sparkSession
    target, last, beside = f"{folder}/{name}.{fmt}", _aside(folder, name, fmt), f"{folder}/.{name}-{uuid.uuid4().hex}"
    _recover(spark, folder, name, fmt)
    writer = df.write.mode("errorifexists")
    (writer.option("header", True).csv(beside) if fmt == "csv" else writer.parquet(beside))
    old, fs = _fs(spark, last)
    fs.delete(old, True)
    if exists(spark, target):
        _move(spark, target, last)
    _move(spark, beside, target)
    fs.delete(old, True)


def write_profiled(df: DataFrame, folder: str, name: str, profile: Profile = DEFAULT, fmt: str = "parquet") -> None:
    """One output per profile: ``master_entity_operational`` and so on."""
    write_table(df, folder, f"{name}{profile.output_suffix}", fmt)


def read_profiled(spark: SparkSession, folder: str, name: str, profile: Profile = DEFAULT, schema: str | None = None) -> DataFrame:
    """A profile's output; where it is missing, that of the default profile."""
    path = find_table(spark, folder, f"{name}{profile.output_suffix}")
    return read_path(spark, path, schema) if path else read_table(spark, folder, name, schema)


def write_delta(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Write the tables of a delta that have rows; returns their names."""
    written = []
    for name, df in tables.items():
        if not df.isEmpty():
            write_table(df, folder, name)
            written.append(name)
    return written


class Catalogue:
    """All tables of one profile, as a mapping and as temporary views.

    ``switch`` reads the outputs of another profile in place.
    """

    def __init__(self, spark: SparkSession, metadata: str, bronze: str, silver: str, gold: str, profile: str = "default", profile_folder: str | None = None):
        self._spark, self._folders, self._profiles = spark, (metadata, bronze, silver, gold), profile_folder
        self.tables: dict[str, DataFrame] = {}
        self.switch(profile)

    def switch(self, profile: str) -> None:
        """Use another profile; an unknown one raises ValueError and changes nothing."""
        if profile not in list_profiles(self._profiles):
            raise ValueError(f"unknown profile {profile!r}; there are {', '.join(list_profiles(self._profiles))}")
        self.profile = load_profile(profile, self._profiles)
        metadata, bronze, silver, gold = self._folders
        read = lambda folder, tables: {n: read_optional(self._spark, folder, n, s) for n, s in tables.items()}
        self.tables = read(metadata, schemas.METADATA) | read(bronze, schemas.BRONZE) | read(silver, schemas.SILVER)
        self.tables |= {n: read_profiled(self._spark, gold, n, self.profile, s) for n, s in schemas.GOLD.items()}
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: object) -> bool:
        return name in self.tables

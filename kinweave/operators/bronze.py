"""Source rows to parties and attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions import values
from kinweave.functions.conditions import any_present, first_match
from kinweave.operators.metadata import Metadata
from kinweave.sources.tables import Sources, current


def union(frames: list[DataFrame], schema: str, like: DataFrame | None = None) -> DataFrame:
    """All rows of frames with the same columns; an empty frame of ``schema`` if there are none."""
    if frames:
        return reduce(DataFrame.unionByName, frames)
    from pyspark.sql import SparkSession

    return (like.sparkSession if like is not None else SparkSession.active()).createDataFrame([], schema)


def _party(rows: DataFrame, key: str, party_id: Column, table_id: str, party_type_id: Column, at: Column) -> DataFrame:
    return rows.select(
        party_id.alias("source_party_id"),
        F.lit(table_id).alias("system_table_id"),
        party_type_id.alias("party_type_id"),
        values.text(F.col(key)).alias("source_record_id"),
        at.alias("ingestion_timestamp"),
        F.lit(True).alias("is_active"),
        at.alias("rec_start_date"),
        F.lit(None).cast("timestamp").alias("rec_end_date"),
    )


def simple_parties(rows: DataFrame, system: str, table: str, key: str, table_id: str, party_type_id: str, at: Column) -> DataFrame:
    """One party per row, of one type."""
    return _party(rows, key, values.party_id(system, table, F.col(key)), table_id, F.lit(party_type_id), at)


def conditional_parties(rows: DataFrame, system: str, table: str, key: str, table_id: str, rules: list[tuple[str, str]], type_ids: dict[str, str], at: Column, otherwise: Column | None = None) -> DataFrame:
    """One party per row, its type by the first condition that holds.

    A row that no condition fits stops the ingest, unless ``otherwise`` names a type id.
    """
    chosen = first_match([(c, type_ids[t]) for c, t in rules], rows.columns, otherwise)
    return _party(rows, key, values.party_id(system, table, F.col(key)), table_id, chosen, at)


def sound_rows(rows: DataFrame, key: str, rules: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows that can become parties of a conditional table, and the others with a ``reason``.

    An ingest that should go on in spite of bad rows takes the first and
    reports the second.
    """
    reason = F.when(F.col(key).isNull(), "no key").when(first_match(rules, rows.columns, F.lit(None).cast("string")).isNull(), "no party type condition matches")
    return rows.filter(reason.isNull()), rows.withColumn("reason", reason).filter("reason is not null")


def subset_parties(rows: DataFrame, system: str, table: str, key: str, table_id: str, groups: dict[str, list[str]], type_ids: dict[str, str], at: Column) -> DataFrame:
    """One party per row and type that has any attribute; the id ends with the role.

    ``groups`` gives each type's attribute columns.  The row is read once and
    exploded over its types.
    """
    roles = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(type_ids[t]).alias("id"), any_present([c for c in cols if c in rows.columns]).alias("given")) for t, cols in groups.items()])
    spread = rows.withColumn("_role", F.explode(F.filter(roles, lambda r: r["given"])))
    return _party(spread, key, values.party_id(system, table, F.col(key), values.role_of(F.col("_role.type"))), table_id, F.col("_role.id"), at)


def table_parties(rows: DataFrame, meta: Metadata, system: str, table: str, at: Column) -> DataFrame:
    """The parties of one source table, by the pattern its control rows describe."""
    row, key = meta.table(system, table), meta.primary_key(system, table)
    types = {p["party_type"]: p["party_type_id"] for p in meta.party_type}
    if meta.is_conditional(system, table):
        return conditional_parties(rows, system, table, key, row["system_table_id"], meta.conditions(system, table), types, at)
    if meta.is_column_subset(system, table):
        groups = {t: [c["source_column"] for c in meta.attribute_columns(system, table) if c["party_type"] == t] for t in meta.party_types(system, table)}
        return subset_parties(rows, system, table, key, row["system_table_id"], groups, types, at)
    if row["main_party_type_id"] is None:
        raise ValueError(f"{system}.{table} has no main party type")
    return simple_parties(rows, system, table, key, row["system_table_id"], row["main_party_type_id"], at)


def all_parties(sources: Sources, meta: Metadata, at: Column) -> DataFrame:
    """Parties of all source tables that hold some and are there."""
    found = [(s, t, sources.changed(s, t)) for s, t in meta.party_tables()]
    return union([table_parties(rows, meta, s, t, at) for s, t, rows in found if rows is not None], schemas.SOURCE_PARTY)


def unpivot(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Wide to long: (source_record_id, row_pos, source_column, raw_value), nulls included.

    ``columns`` maps a name of the long table to a source column.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("source_column"), values.text(F.col(c)).alias("raw_value")) for n, c in columns.items()])
    return rows.select(values.text(F.col(key)).alias("source_record_id"), F.explode(cells).alias("cell")).select("source_record_id", "cell.*")


def table_attributes(rows: DataFrame, parties: DataFrame, meta: Metadata, system: str, table: str, all_versions: bool = False) -> DataFrame:
    """Long attributes of one table: (source_party_id, column_id, raw_value), nulls included.

    A cell goes to each party of its row whose type has that column.  The
    column id names column and party type, as a column alone may serve several
    types.  Null values stay in the result: they close earlier versions.
    ``all_versions`` also serves parties that are closed.
    """
    spark = rows.sparkSession
    columns = [c for c in meta.attribute_columns(system, table) if c["source_column"] in rows.columns]
    if not columns:
        return spark.createDataFrame([], "source_party_id string, column_id string, raw_value string")
    key, table_id = meta.primary_key(system, table), meta.table(system, table)["system_table_id"]
    types = {p["party_type"]: p["party_type_id"] for p in meta.party_type}
    control = spark.createDataFrame([(c["source_column"], types[c["party_type"]], column_key(c)) for c in columns], "source_column string, party_type_id string, column_id string")
    long = unpivot(rows, key, {c["source_column"]: c["source_column"] for c in {c["source_column"]: c for c in columns}.values()})
    own = (parties if all_versions else current(parties)).filter(F.col("system_table_id") == table_id).select("source_party_id", "party_type_id", "source_record_id")
    return long.join(own, "source_record_id").join(F.broadcast(control), ["source_column", "party_type_id"]).select("source_party_id", "column_id", "raw_value")


def column_key(column: dict) -> str:
    """The key of a control row: column id and party type."""
    return f"{column['column_id']}@{column['party_type']}"


def all_attributes(sources: Sources, parties: DataFrame, meta: Metadata) -> DataFrame:
    """Long attributes of all tables that have some and are there, nulls included."""
    found = [(s, t, sources.changed(s, t)) for s, t in meta.party_tables() if meta.attribute_columns(s, t)]
    return union([table_attributes(rows, parties, meta, s, t) for s, t, rows in found if rows is not None], "source_party_id string, column_id string, raw_value string")


def new_attributes(long: DataFrame, at: Column) -> DataFrame:
    """RAW_ATTRIBUTE rows of long attributes; null values give none."""
    return long.filter("raw_value is not null").select(
        values.attribute_id(F.col("source_party_id"), F.col("column_id")).alias("raw_attribute_id"),
        "source_party_id",
        "column_id",
        "raw_value",
        at.alias("ingestion_timestamp"),
        at.alias("rec_start_date"),
        F.lit(None).cast("timestamp").alias("rec_end_date"),
    )


def rows_without_party(rows: DataFrame, parties: DataFrame, key: str, table_id: str) -> DataFrame:
    """Source rows of a table that no party stands for."""
    own = parties.filter(F.col("system_table_id") == table_id).select(F.col("source_record_id").alias("_record"))
    return rows.join(own, values.text(F.col(key)) == F.col("_record"), "left_anti")

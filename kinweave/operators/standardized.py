"""RAW_ATTRIBUTE to STANDARDIZED_ATTRIBUTE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import standardize, values
from kinweave.sources.tables import current


def column_types(metadata_column: DataFrame, attribute_type: DataFrame) -> DataFrame:
    """(column_id, attribute_type, attribute_name, requires_classification) per control row."""
    columns = metadata_column.filter("is_attribute and party_type is not null").select(F.concat_ws("@", "column_id", "party_type").alias("column_id"), "attribute_type")
    types = attribute_type.select(F.col("attribute_type_id").alias("attribute_type"), "attribute_name", "requires_classification")
    return columns.join(types, "attribute_type").select("column_id", "attribute_type", "attribute_name", "requires_classification")


def standardize_attributes(raw: DataFrame, metadata_column: DataFrame, attribute_type: DataFrame, attribute_subtype: DataFrame, at: Column, current_only: bool = True, normalise_subtype: bool = False) -> DataFrame:
    """Normalise every raw value and classify the types that ask for it.

    Values that normalise to null go.  A classified value whose subtype no
    control row names goes too; the comparison is case-sensitive unless
    ``normalise_subtype`` folds case, spaces and underscores.  Unclassified
    values carry their type id with confidence 1.  ``current_only=False`` also
    takes closed versions.
    """
    rows = current(raw) if current_only else raw
    typed = rows.join(F.broadcast(column_types(metadata_column, attribute_type)), "column_id")
    value = standardize.normalize(F.col("attribute_name"), F.col("raw_value"))
    named = typed.withColumn("standardized_value", value).filter("standardized_value is not null")
    named = named.withColumn("_class", F.when(F.col("requires_classification"), standardize.classify(F.col("attribute_name"), F.col("standardized_value"))))
    fold = (lambda c: F.upper(F.regexp_replace(c, "[ _]", ""))) if normalise_subtype else (lambda c: c)
    names = attribute_subtype.select(fold(F.col("subtype_name")).alias("_name"), "attribute_subtype_id").groupBy("_name").agg(F.min("attribute_subtype_id").alias("_subtype"))
    joined = named.withColumn("_name", fold(F.col("_class.subtype"))).join(F.broadcast(names), "_name", "left")
    joined = joined.withColumn("attribute_subtype_id", F.when(F.col("_class").isNotNull(), F.col("_subtype")).otherwise(F.col("attribute_type"))).filter("attribute_subtype_id is not null")
    return joined.select(
        values.stable_id(F.lit("std"), F.col("raw_attribute_id")).alias("standardized_attribute_id"),
        "raw_attribute_id",
        "source_party_id",
        "attribute_subtype_id",
        "standardized_value",
        F.coalesce("_class.confidence", F.lit(1.0)).alias("confidence_score"),
        F.lit("v1.0").alias("pipeline_version"),
        at.alias("created_at"),
        F.lit(True).alias("is_current"),
    )


def coverage(raw: DataFrame, standardized: DataFrame) -> DataFrame:
    """One row: raw and standardised values, coverage in percent, distinct parties."""
    left = raw.agg(F.count("raw_value").alias("raw_values"))
    right = standardized.agg(F.count("*").alias("standardized_values"), F.count_distinct("source_party_id").alias("parties"))
    percent = F.when(F.col("raw_values") > 0, F.col("standardized_values") / F.col("raw_values") * 100).otherwise(0.0)
    return left.crossJoin(right).select("raw_values", "standardized_values", "parties", percent.alias("coverage_percent"))


def classification_stats(standardized: DataFrame) -> DataFrame:
    """Values by subtype, most first."""
    return standardized.groupBy("attribute_subtype_id").agg(F.count("*").alias("n_values")).orderBy(F.desc("n_values"), "attribute_subtype_id")


def party_attributes(standardized: DataFrame) -> DataFrame:
    """(party_id, subtype, value): of several values of a subtype the last row's."""
    return standardized.groupBy(F.col("source_party_id").alias("party_id"), F.col("attribute_subtype_id").alias("subtype")).agg(F.max_by("standardized_value", F.struct("created_at", "raw_attribute_id")).alias("value"))


def attribute_maps(standardized: DataFrame) -> DataFrame:
    """(party_id, attributes): the party's values as a map."""
    return party_attributes(standardized).groupBy("party_id").agg(F.map_from_entries(F.collect_list(F.struct("subtype", "value"))).alias("attributes"))

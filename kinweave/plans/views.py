"""What a user interface derives from the read queries: filters, sorts, groups, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import values

# The fields that lists can be sorted by, and the attribute types a table hides.
ENTITY_SORTS = ["entity_id", "primary_name", "party_count", "match_evidence_count", "conflict_count", "resolution_score", "total_pairs", "unique_attributes", "total_attribute_instances", "fully_matching_attributes", "contradicting_attributes", "avg_pair_score", "min_pair_score", "max_pair_score"]
PARTY_SORTS = ["display_name", "source_system", "party_type", "match_score", "attribute_count"]
CLUSTER_SORTS = ["cluster_id", "party_count", "entity_count", "resolution_rate", "relationship_count", "evidence_count"]
HIDDEN_TYPES = ["ATTR_GOV_ID_TYPE", "ATTR_RELATIONSHIP_TYPE", "ATTR_GENDER"]


def _has(c: str, text: str) -> Column:
    return F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))


def _any(columns: list[str], text: str | None) -> Column:
    out = F.lit(not text)
    for c in columns if text else []:
        out = out | _has(c, text)
    return out


def filter_entities(entities: DataFrame, search: str | None = None, conflicts: bool | None = None, hide_singletons: bool = False, min_parties: int | None = None, max_parties: int | None = None, min_score: float | None = None) -> DataFrame:
    """Entities by name or id, conflicts, size and score; a missing score fails a minimum."""
    keep = _any(["primary_name", "entity_id"], search)
    if conflicts is not None:
        keep = keep & (F.col("has_conflicts") == conflicts)
    if hide_singletons:
        keep = keep & (F.col("party_count") > 1)
    if min_parties is not None:
        keep = keep & (F.col("party_count") >= min_parties)
    if max_parties is not None:
        keep = keep & (F.col("party_count") <= max_parties)
    if min_score is not None:
        keep = keep & F.coalesce(F.col("avg_pair_score") >= min_score, F.lit(False))
    return entities.filter(keep)


def filter_parties(parties: DataFrame, search: str | None = None, source: str | None = None, party_type: str | None = None, has_entity: bool | None = None, min_score: float | None = None) -> DataFrame:
    """Parties by name, id, email or government id, source, type, entity and score."""
    keep = _any(["display_name", "party_id", "email", "gov_id"], search)
    if source:
        keep = keep & (F.col("source_system") == source)
    if party_type:
        keep = keep & (F.col("party_type") == party_type)
    if has_entity is not None:
        keep = keep & (F.col("entity_id").isNotNull() if has_entity else F.col("entity_id").isNull())
    if min_score is not None:
        keep = keep & F.coalesce(F.col("match_score") >= min_score, F.lit(False))
    return parties.filter(keep)


def filter_clusters(clusters: DataFrame, search: str | None = None, min_parties: int | None = None, max_parties: int | None = None) -> DataFrame:
    keep = _any(["cluster_id"], search)
    if min_parties is not None:
        keep = keep & (F.col("party_count") >= min_parties)
    if max_parties is not None:
        keep = keep & (F.col("party_count") <= max_parties)
    return clusters.filter(keep)


def sort_by(df: DataFrame, field: str, descending: bool = False, allowed: list[str] | None = None) -> DataFrame:
    """Sort by one field, text ignoring case, nulls last either way."""
    if field not in (allowed or df.columns):
        raise ValueError(f"cannot sort by {field!r}")
    key = F.lower(field) if dict(df.dtypes)[field] == "string" else F.col(field)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last())


def first_items(column: str, n: int) -> Column:
    """The first n items of a list column."""
    return F.slice(column, 1, n)


def filter_options(parties: DataFrame, column: str) -> DataFrame:
    """Distinct values to filter by, sorted."""
    return parties.select(F.col(column).alias("option")).filter("option is not null").distinct().orderBy("option")


def entity_summary(entities: DataFrame) -> DataFrame:
    """One row: entities, mean parties, mean score of those that have one."""
    return entities.agg(F.count("*").alias("n_entities"), F.avg("party_count").alias("avg_parties"), F.avg("avg_pair_score").alias("avg_match_score"), F.count_if(F.col("has_conflicts")).alias("with_conflicts"))


def cluster_summary(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.count("*").alias("n_clusters"), F.avg("party_count").alias("avg_parties"), (F.avg("resolution_rate") * 100).alias("avg_resolution_percent"))


def party_summary(parties: DataFrame) -> DataFrame:
    return parties.agg(F.count("*").alias("n_parties"), F.count_if(F.col("entity_id").isNotNull()).alias("with_entity"), F.avg("match_score").alias("avg_match_score"))


def group_by_cluster(parties: DataFrame) -> DataFrame:
    """Parties by cluster, those without one together, largest first."""
    key = F.coalesce("cluster_id", F.lit("NO_CLUSTER"))
    grouped = parties.groupBy(key.alias("cluster_id")).agg(F.count("*").alias("party_count"), F.array_sort(F.collect_set("source_system")).alias("source_systems"), F.array_sort(F.collect_set("party_type")).alias("party_types"), F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return grouped.orderBy(F.desc("party_count"), "cluster_id")


def group_by_entity(parties: DataFrame) -> DataFrame:
    """Parties by entity, those without one left out, largest first."""
    grouped = parties.filter("entity_id is not null").groupBy("entity_id").agg(F.count("*").alias("party_count"), F.array_sort(F.collect_set("source_system")).alias("source_systems"), F.array_sort(F.collect_list("party_id")).alias("party_ids"))
    return grouped.orderBy(F.desc("party_count"), "entity_id")


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """Each row's share of the column's sum, in percent."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn("percent", F.when(F.col("_total") > 0, F.col(value) / F.col("_total") * 100).otherwise(0.0)).drop("_total")


def attribute_table(attributes: DataFrame, search: str | None = None, source: str | None = None, hidden: list[str] = HIDDEN_TYPES) -> DataFrame:
    """Per attribute: its label, how many values, distinct ones ignoring case, and
    the share of the most common one.  ``attributes`` has attribute_subtype_id,
    standardized_value, source_system."""
    shown = attributes.filter(~F.col("attribute_subtype_id").isin(hidden))
    per_value = shown.groupBy("attribute_subtype_id", F.lower("standardized_value").alias("v")).agg(F.count("*").alias("n"), F.collect_set("source_system").alias("s"))
    grouped = per_value.groupBy("attribute_subtype_id").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_distinct"), (F.max("n") / F.sum("n") * 100).alias("match_percent"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("source_systems"))
    out = grouped.withColumn("label", values.attribute_label(F.col("attribute_subtype_id"))).withColumn("band", values.match_band(F.col("match_percent")))
    if search:
        out = out.filter(_has("label", search))
    return out.filter(F.array_contains("source_systems", source)) if source else out


def party_rows(parties: DataFrame, attributes: DataFrame, search: str | None = None, table: str | None = None) -> DataFrame:
    """Parties with the number of attributes that fit the search."""
    fits = attributes.filter(_any(["standardized_value", "attribute_subtype_id"], search))
    n = fits.groupBy("party_id").agg(F.count("*").alias("n_attributes"))
    out = parties.join(n, "party_id", "inner" if search else "left").withColumn("n_attributes", F.coalesce("n_attributes", F.lit(0)).cast("long"))
    return out.filter(F.col("source_table") == table) if table else out


def compare_pair(attributes: DataFrame, party_1: str, party_2: str) -> DataFrame:
    """Attributes of two parties side by side: match, mismatch or missing, in that order.

    ``attributes`` has party_id, subtype and value, one row per subtype.
    """
    side = lambda p, n: attributes.filter(F.col("party_id") == p).select("subtype", F.col("value").alias(n))
    both = side(party_1, "value_1").join(side(party_2, "value_2"), "subtype", "full")
    status = F.when(F.col("value_1").isNull() | F.col("value_2").isNull(), "missing").when(F.lower("value_1") == F.lower("value_2"), "match").otherwise("mismatch")
    rank = F.when(F.col("status") == "match", 0).when(F.col("status") == "mismatch", 1).otherwise(2)
    return both.withColumn("status", status).orderBy(rank, "subtype")


def compare_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status").agg(F.count("*").alias("n_attributes"))


def focus_rows(rows: DataFrame, party_id: str) -> DataFrame:
    """Evidence or blocks that involve one party."""
    return rows.filter((F.col("party_id_1") == party_id) | (F.col("party_id_2") == party_id))


def edge_labels(evidence: DataFrame) -> DataFrame:
    """Per pair of evidence rows with counts: match and mismatch percent and band."""
    pairs = evidence.groupBy("party_id_1", "party_id_2").agg(F.max("num_matches").alias("m"), F.max("num_differences").alias("d"))
    percent = F.when(F.col("m") + F.col("d") > 0, F.round(F.col("m") / (F.col("m") + F.col("d")) * 100))
    return pairs.withColumn("match_percent", percent).withColumn("mismatch_percent", 100 - F.col("match_percent")).withColumn("band", values.edge_band(F.col("match_percent"))).drop("m", "d")


def graph_edges(evidence: DataFrame, blocking: DataFrame, relationships: DataFrame, visible: DataFrame) -> DataFrame:
    """All edges whose two ends are visible: (source, target, edge_type)."""
    e = evidence.select(F.col("party_id_1").alias("source"), F.col("party_id_2").alias("target"), F.lit("evidence").alias("edge_type")).distinct()
    b = blocking.select(F.col("party_id_1").alias("source"), F.col("party_id_2").alias("target"), F.lit("blocking").alias("edge_type")).distinct()
    r = relationships.select(F.col("from_party_id").alias("source"), F.col("to_party_id").alias("target"), F.lit("relationship").alias("edge_type")).distinct()
    seen = visible.select("party_id").distinct()
    return e.unionByName(b).unionByName(r).join(seen.withColumnRenamed("party_id", "source"), "source", "left_semi").join(seen.withColumnRenamed("party_id", "target"), "target", "left_semi").select("source", "target", "edge_type")


def graph_nodes(parties: DataFrame, blocking: DataFrame) -> DataFrame:
    """Parties as nodes, marked where a block involves them."""
    marked = blocking.select(F.explode(F.array("party_id_1", "party_id_2")).alias("party_id")).distinct().withColumn("has_conflict", F.lit(True))
    return parties.join(marked, "party_id", "left").withColumn("has_conflict", F.coalesce("has_conflict", F.lit(False)))


def entity_facets(parties: DataFrame) -> DataFrame:
    """One row: systems, types and clusters of the parties in an entity view."""
    own = parties.filter("in_entity") if "in_entity" in parties.columns else parties
    return own.agg(F.array_sort(F.collect_set("source_system")).alias("source_systems"), F.array_sort(F.collect_set("party_type")).alias("party_types"), F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"))


def cluster_entities(parties: DataFrame) -> DataFrame:
    """Distinct entities of a cluster view."""
    return parties.filter("entity_id is not null").select("entity_id").distinct()

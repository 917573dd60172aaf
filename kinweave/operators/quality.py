"""Statistics and checks over the tables of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import values
from kinweave.operators.clusters import components
from kinweave.sources.tables import current


def parties_by_type(parties: DataFrame, party_type: DataFrame) -> DataFrame:
    """Current parties per type name."""
    return current(parties).groupBy("party_type_id").agg(F.count("*").alias("n_parties")).join(F.broadcast(party_type), "party_type_id", "left").select(F.coalesce("party_type", "party_type_id").alias("party_type"), "n_parties")


def attributes_by_table(raw: DataFrame) -> DataFrame:
    """Current attributes per table prefix, most first."""
    return current(raw).groupBy(values.table_prefix(F.col("source_party_id")).alias("source_table")).agg(F.count("*").alias("n_attributes")).orderBy(F.desc("n_attributes"), "source_table")


def relationship_counts(relationships: DataFrame) -> DataFrame:
    """Current relationships by foreign keys and by one row's roles."""
    return current(relationships).agg(F.count_if(F.col("metadata_relationship_id").isNotNull()).alias("fk_relationships"), F.count_if(F.col("metadata_party_type_relationship_id").isNotNull()).alias("semantic_relationships"))


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return table.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def sample_rows(table: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in a stated order, for a reader to look at."""
    return table.orderBy(*order).limit(n)


def scenario_statistics(expected_clusters: DataFrame, expected_entities: DataFrame, expected_matches: DataFrame) -> DataFrame:
    """One row of what a set of expected outputs holds."""
    counts = [
        expected_clusters.agg(F.count_distinct("scenario_id").alias("scenarios"), F.count("*").alias("parties"), F.count_distinct("expected_cluster_id").alias("clusters")),
        expected_entities.agg(F.count_distinct("expected_master_entity_id").alias("entities")),
        expected_matches.agg(F.count("*").alias("matches"), F.count_if(F.col("should_match")).alias("positive_matches")),
    ]
    return reduce(DataFrame.crossJoin, counts)


def scenario_faults(expected_clusters: DataFrame, expected_entities: DataFrame, expected_matches: DataFrame, person_tables: list[str]) -> DataFrame:
    """Where expected outputs contradict each other: (scenario_id, fault, detail).

    ``person_tables`` names the source tables whose rows are persons.

    Matches and entities may only name clustered parties; parties that match,
    directly or through others, must be exactly one entity; every person needs
    an entity; parties that must not match must not share one.
    """
    known = expected_clusters.select("scenario_id", F.col("source_pk_value").alias("party")).distinct()
    ends = expected_matches.select("scenario_id", F.explode(F.array("party_id_1", "party_id_2")).alias("party")).distinct()
    members = expected_entities.select("scenario_id", "expected_master_entity_id", F.explode(values.json_list(F.col("source_party_ids"))).alias("party"))
    faults = [
        ends.join(known, ["scenario_id", "party"], "left_anti").select("scenario_id", F.lit("match outside clusters").alias("fault"), F.col("party").alias("detail")),
        members.join(known, ["scenario_id", "party"], "left_anti").select("scenario_id", F.lit("entity outside clusters").alias("fault"), F.concat_ws(" ", "expected_master_entity_id", "party").alias("detail")),
    ]
    node = lambda p: F.concat_ws("\x1f", "scenario_id", p)
    positive = expected_matches.filter("should_match").select(node("party_id_1").alias("a"), node("party_id_2").alias("b"))
    nodes = positive.select(F.explode(F.array("a", "b")).alias("party_id")).distinct()
    closure = components(nodes, positive).groupBy("component").agg(F.array_sort(F.collect_set(F.substring_index("party_id", "\x1f", -1))).alias("members"), F.min(F.substring_index("party_id", "\x1f", 1)).alias("scenario_id"))
    defined = members.groupBy("scenario_id", "expected_master_entity_id").agg(F.array_sort(F.collect_set("party")).alias("members"))
    faults.append(closure.join(defined, ["scenario_id", "members"], "left_anti").select("scenario_id", F.lit("no entity for connected parties").alias("fault"), F.array_join("members", " ").alias("detail")))
    persons = expected_clusters.filter(F.col("source_table").isin(person_tables)).select("scenario_id", F.col("source_pk_value").alias("party")).distinct()
    faults.append(persons.join(members, ["scenario_id", "party"], "left_anti").select("scenario_id", F.lit("person without entity").alias("fault"), F.col("party").alias("detail")))
    apart = expected_matches.filter("not should_match").select("scenario_id", "party_id_1", "party_id_2")
    m1 = members.select("scenario_id", "expected_master_entity_id", F.col("party").alias("party_id_1"))
    m2 = members.select("scenario_id", "expected_master_entity_id", F.col("party").alias("party_id_2"))
    faults.append(apart.join(m1, ["scenario_id", "party_id_1"]).join(m2, ["scenario_id", "expected_master_entity_id", "party_id_2"]).select("scenario_id", F.lit("negative match in one entity").alias("fault"), F.concat_ws(" ", "party_id_1", "party_id_2").alias("detail")))
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out.distinct()

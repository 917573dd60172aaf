"""Party clusters: connected components of relationships, with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions.values import stable_id
from kinweave.operators.graph import connected_components
from kinweave.sources.tables import current
from kinweave.storage import materialize


def components(parties: DataFrame, edges: DataFrame) -> DataFrame:
    """(party_id, component) of every party; parties without edges are their own component.

    ``edges`` has two columns of party ids; direction doesn't matter.  A
    component is named by its smallest party.
    """
    found = materialize(connected_components(edges), "components")
    joined = parties.select("party_id").distinct().join(found, F.col("party_id") == F.col("node"), "left")
    return joined.select("party_id", F.coalesce("component", "party_id").alias("component"))


def _records(members: DataFrame, at: Column) -> DataFrame:
    return members.select("party_id", "cluster_id", at.alias("rec_start_date"), F.lit(None).cast("timestamp").alias("rec_end_date"))


def _edges(relationships: DataFrame) -> DataFrame:
    return current(relationships).select("from_party_id", "to_party_id")


def full_clusters(parties: DataFrame, relationships: DataFrame, at: Column) -> DataFrame:
    """PARTY_CLUSTER from nothing; ids depend on the smallest member only.

    ``parties`` has party_id; ``relationships`` counts with its current rows.
    """
    found = components(parties, _edges(relationships))
    return _records(found.withColumn("cluster_id", stable_id(F.lit("cluster"), F.col("component"))), at)


def affected_parties(relationships: DataFrame, clusters: DataFrame) -> DataFrame:
    """Parties whose relationships began or ended after the last clustering."""
    cutoff = clusters.filter("rec_end_date is null").agg(F.max("rec_start_date").alias("cutoff"))
    changed = relationships.crossJoin(F.broadcast(cutoff)).filter("cutoff is null or rec_start_date > cutoff or rec_end_date > cutoff")
    return changed.select(F.explode(F.array("from_party_id", "to_party_id")).alias("party_id")).distinct()


def affected_members(affected: DataFrame, clusters: DataFrame) -> DataFrame:
    """(party_id, cluster_id): all members of clusters with an affected party."""
    now = clusters.filter("rec_end_date is null").select("party_id", "cluster_id")
    touched = now.join(affected, "party_id", "left_semi").select("cluster_id").distinct()
    return now.join(touched, "cluster_id", "left_semi")


def keep_ids(found: DataFrame, old: DataFrame) -> DataFrame:
    """Give re-clustered components (party_id, component) their cluster ids.

    A component keeps an old id if more than half of its members had it.  Of
    several such components the one with the larger overlap, then the larger
    one, then the smaller name keeps it.  Others get an id of their own.
    """
    size = found.groupBy("component").agg(F.count("*").alias("n"))
    overlap = found.join(old.select("party_id", F.col("cluster_id").alias("old_id")), "party_id").groupBy("component", "old_id").agg(F.count("*").alias("shared"))
    ranked = overlap.withColumn("_best", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("shared"), "old_id"))).filter("_best = 1").join(size, "component").filter("shared * 2 > n")
    won = ranked.withColumn("_first", F.row_number().over(Window.partitionBy("old_id").orderBy(F.desc("shared"), F.desc("n"), "component"))).filter("_first = 1").select("component", "old_id")
    members = found.join(won, "component", "left")
    return members.select("party_id", "component", "old_id")


def incremental_clusters(parties: DataFrame, relationships: DataFrame, clusters: DataFrame, at: Column) -> DataFrame:
    """Re-cluster only what a delta touched.

    Members of touched clusters, parties of changed relationships and new
    parties are clustered again over current relationships; their current rows
    are closed and new ones added, even where the id stays.  Without a change
    the result is the table as it was; an empty table is clustered in full.
    """
    if clusters.filter("rec_end_date is null").isEmpty():
        return full_clusters(parties, relationships, at)
    affected = affected_parties(relationships, clusters)
    now = clusters.filter("rec_end_date is null")
    new = parties.select("party_id").distinct().join(now.select("party_id"), "party_id", "left_anti")
    old = affected_members(affected, clusters)
    again = materialize(old.select("party_id").unionByName(affected.join(parties.select("party_id"), "party_id", "left_semi")).unionByName(new).distinct(), "affected")
    if again.isEmpty():
        return clusters
    edges = _edges(relationships)
    inside = edges.join(again.select(F.col("party_id").alias("from_party_id")), "from_party_id", "left_semi").join(again.select(F.col("party_id").alias("to_party_id")), "to_party_id", "left_semi")
    named = keep_ids(components(again, inside), old).withColumn("cluster_id", F.coalesce("old_id", stable_id(F.lit("cluster"), F.col("component"), at)))
    mark = again.withColumn("_again", F.lit(True))
    kept = clusters.join(mark, "party_id", "left").withColumn("rec_end_date", F.when(F.col("_again") & F.col("rec_end_date").isNull(), at).otherwise(F.col("rec_end_date"))).select(*clusters.columns)
    return kept.unionByName(_records(named, at))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.filter("rec_end_date is null").groupBy("cluster_id").agg(F.count("*").alias("party_count"))


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """One row: total, multi, singleton, largest and mean cluster size."""
    n = F.col("party_count")
    return cluster_sizes(clusters).agg(F.count("*").alias("total_clusters"), F.count_if(n > 1).alias("multi_clusters"), F.count_if(n == 1).alias("singleton_clusters"), F.coalesce(F.max(n), F.lit(0)).alias("largest_cluster"), F.avg(n).alias("mean_size"))


def clustering_faults(parties: DataFrame, clusters: DataFrame) -> DataFrame:
    """Parties without a current cluster and parties with several: (party_id, fault)."""
    now = clusters.filter("rec_end_date is null")
    missing = parties.select("party_id").distinct().join(now.select("party_id"), "party_id", "left_anti").withColumn("fault", F.lit("no cluster"))
    several = now.groupBy("party_id").agg(F.count("*").alias("n")).filter("n > 1").select("party_id", F.lit("several clusters").alias("fault"))
    return missing.unionByName(several)


EMPTY = schemas.PARTY_CLUSTER

"""Candidate pairs and what speaks for and against them.

Pairs are canonical: ``party_id_1 < party_id_2``.  They come from two equi
self-joins, within clusters and on strong attribute values, so a pair is never
looked for outside a shared key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import values
from kinweave.functions.conditions import present
from kinweave.operators.joins import dealt_pairs

# The strong attributes of the second phase, first label wins.
STRONG_KEYS = [("SUB_HKID", "EXACT_HKID"), ("SUB_PASSPORT", "EXACT_PASSPORT"), ("ATTR_EMAIL", "EXACT_EMAIL"), ("ATTR_DOB", "EXACT_DOB")]
PHASE_1 = "PHASE_1"


def self_pairs(members: DataFrame, key: list[str], party: str = "party_id") -> DataFrame:
    """All unordered pairs of parties that share a key: key columns, party_id_1, party_id_2.

    The pairs of a hot key are dealt over tasks.
    """
    return dealt_pairs(members.select(*key, party), key, {party: "party_id_1"}, {party: "party_id_2"}).filter("party_id_1 < party_id_2")


def pairs_within(clusters: DataFrame) -> DataFrame:
    """Distinct pairs of one current cluster, labelled for phase 1."""
    now = clusters.filter("rec_end_date is null") if "rec_end_date" in clusters.columns else clusters
    return self_pairs(now.select("cluster_id", "party_id").distinct(), ["cluster_id"]).select("party_id_1", "party_id_2", F.lit(PHASE_1).alias("blocking_keys")).distinct()


def strong_candidates(attributes: DataFrame, keys: list[tuple[str, str]] = STRONG_KEYS) -> DataFrame:
    """Pairs that share a strong value: party_id_1, party_id_2, key_order, blocking_keys."""
    spark = attributes.sparkSession
    names = spark.createDataFrame([(s, n, i) for i, (s, n) in enumerate(keys)], "subtype string, blocking_keys string, key_order int")
    strong = attributes.join(F.broadcast(names), "subtype").select("subtype", "value", "party_id")
    return self_pairs(strong, ["subtype", "value"]).join(F.broadcast(names), "subtype").select("party_id_1", "party_id_2", "key_order", "blocking_keys")


def _placed(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs with ``same_cluster``; two parties without a cluster count as one."""
    now = clusters.filter("rec_end_date is null").select("party_id", "cluster_id") if "rec_end_date" in clusters.columns else clusters.select("party_id", "cluster_id")
    a, b = now.select(F.col("party_id").alias("party_id_1"), F.col("cluster_id").alias("_c1")), now.select(F.col("party_id").alias("party_id_2"), F.col("cluster_id").alias("_c2"))
    return pairs.join(a, "party_id_1", "left").join(b, "party_id_2", "left").withColumn("same_cluster", F.col("_c1").eqNullSafe(F.col("_c2"))).drop("_c1", "_c2")


def pairs_across(attributes: DataFrame, clusters: DataFrame, keys: list[tuple[str, str]] = STRONG_KEYS) -> DataFrame:
    """Distinct pairs of different clusters that share a strong value, by their first key."""
    found = _placed(strong_candidates(attributes, keys), clusters).filter("not same_cluster")
    return found.groupBy("party_id_1", "party_id_2").agg(F.min_by("blocking_keys", "key_order").alias("blocking_keys"))


def across_stats(attributes: DataFrame, clusters: DataFrame, keys: list[tuple[str, str]] = STRONG_KEYS) -> DataFrame:
    """Per strong key: candidates, skipped as one cluster, skipped as seen, compared."""
    found = _placed(strong_candidates(attributes, keys), clusters)
    first = F.min(F.when(~F.col("same_cluster"), F.col("key_order"))).over(Window.partitionBy("party_id_1", "party_id_2"))
    judged = found.withColumn("_seen", ~F.col("same_cluster") & (F.col("key_order") > first))
    return judged.groupBy("blocking_keys").agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("same_cluster")).alias("same_cluster"),
        F.count_if(F.col("_seen")).alias("seen"),
        F.count_if(~F.col("same_cluster") & ~F.col("_seen")).alias("compared"),
    )


def all_pairs(attributes: DataFrame, clusters: DataFrame, keys: list[tuple[str, str]] = STRONG_KEYS) -> DataFrame:
    """Pairs of both phases; they can't overlap, as one is within and one across clusters."""
    return pairs_within(clusters).unionByName(pairs_across(attributes, clusters, keys))


def compared(pairs: DataFrame, attributes: DataFrame, rules: DataFrame) -> DataFrame:
    """Every attribute that both parties of a pair have and an active rule weighs.

    Adds value_1, value_2, equal, hard, the rule's weights, and for each pair
    whether any hard conflict exists (``blocked``) and which row shows it
    (``shown``: highest priority, then attribute).
    """
    given = attributes.filter(present(F.col("value")))
    a = given.select(F.col("party_id").alias("party_id_1"), "subtype", F.col("value").alias("value_1"))
    b = given.select(F.col("party_id").alias("party_id_2"), "subtype", F.col("value").alias("value_2"))
    weights = rules.filter("is_active").select(F.col("attribute_subtype_id").alias("subtype"), "match_weight", "difference_weight", "hard_link_threshold", "hard_block_threshold", "priority")
    both = pairs.join(a, "party_id_1").join(b, ["party_id_2", "subtype"]).join(F.broadcast(weights), "subtype")
    both = both.withColumn("equal", F.col("value_1") == F.col("value_2")).withColumn("hard", ~F.col("equal") & F.coalesce(F.col("hard_block_threshold") == 1.0, F.lit(False)))
    pair = Window.partitionBy("party_id_1", "party_id_2")
    at = F.row_number().over(pair.orderBy(F.desc("hard"), F.desc("priority"), "subtype"))
    return both.withColumn("_at", at).withColumn("blocked", F.max("hard").over(pair)).withColumn("shown", F.col("hard") & (F.col("_at") == 1)).drop("_at")


def match_rows(compared_rows: DataFrame, at: Column) -> DataFrame:
    """MATCH_EVIDENCE: equal values of pairs without a hard conflict."""
    hit = compared_rows.filter(F.col("equal") & ~F.col("blocked") & (F.col("match_weight") > 0))
    confidence = F.when(F.coalesce(F.col("hard_link_threshold") == 1.0, F.lit(False)), 1.0).otherwise(0.95)
    return hit.select(
        values.stable_id(F.lit("match"), F.col("party_id_1"), F.col("party_id_2"), F.col("subtype")).alias("evidence_id"),
        "party_id_1",
        "party_id_2",
        F.lit("EXACT_MATCH").alias("match_type"),
        values.rule_id(F.col("subtype")).alias("match_rule_id"),
        F.col("subtype").alias("match_key"),
        F.col("value_1").alias("evidence_value"),
        confidence.alias("confidence_score"),
        at.alias("created_at"),
        "blocking_keys",
    )


def difference_rows(compared_rows: DataFrame, at: Column) -> DataFrame:
    """DIFFERENCE_EVIDENCE: one row for a hard conflict, else every weighed difference."""
    soft = ~F.col("blocked") & ~F.col("equal") & (F.col("difference_weight") > 0)
    return compared_rows.filter(F.col("shown") | soft).select(
        values.stable_id(F.lit("difference"), F.col("party_id_1"), F.col("party_id_2"), F.col("subtype")).alias("evidence_id"),
        "party_id_1",
        "party_id_2",
        F.col("subtype").alias("attribute_subtype_id"),
        "value_1",
        "value_2",
        F.when(F.col("shown"), 1.0).otherwise(F.col("difference_weight")).alias("severity_score"),
        F.col("shown").alias("is_hard_block"),
        F.when(F.col("shown"), "HARD_CONFLICT").otherwise("SOFT_CONFLICT").alias("difference_type"),
        at.alias("created_at"),
    )


def phase_stats(pairs: DataFrame, matches: DataFrame, differences: DataFrame) -> DataFrame:
    """Per label: pairs, pairs with matches, with differences, hard-blocked, without evidence."""
    ends = ["party_id_1", "party_id_2"]
    m = matches.groupBy(*ends).agg(F.count("*").alias("m"))
    d = differences.groupBy(*ends).agg(F.count("*").alias("d"), F.max("is_hard_block").alias("h"))
    joined = pairs.join(m, ends, "left").join(d, ends, "left")
    has_m, has_d = F.col("m").isNotNull(), F.col("d").isNotNull()
    return joined.groupBy("blocking_keys").agg(F.count("*").alias("pairs"), F.count_if(has_m).alias("with_matches"), F.count_if(has_d).alias("with_differences"), F.count_if(F.col("h")).alias("hard_blocked"), F.count_if(~has_m & ~has_d).alias("without_evidence"))


def union_pairs(*frames: DataFrame) -> DataFrame:
    """Distinct canonical pairs of frames with two party columns each."""
    one = [f.select(F.least(*f.columns[:2]).alias("party_id_1"), F.greatest(*f.columns[:2]).alias("party_id_2")) for f in frames]
    return reduce(DataFrame.unionByName, one).filter("party_id_1 <> party_id_2").distinct()

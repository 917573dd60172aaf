"""Decisions about pairs from their evidence and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import values
from kinweave.operators.evidence import union_pairs
from kinweave.profiles import Profile
from kinweave.sources.tables import current

# What a soft relationship's confidence counts in the score, the
# scores of hard links by tier, and below, in ``decide``, the texts of reasons.
RELATIONSHIP_WEIGHT = 0.3
HIGH_SCORE, MEDIUM_SCORE, LOW_SCORE = 1.0, 0.85, 0.5


def relationship_pairs(relationships: DataFrame, metadata_relationship: DataFrame) -> DataFrame:
    """Per canonical pair: soft relationship score and whether a relationship guarantees identity."""
    rules = metadata_relationship.select(F.col("relationship_id").alias("metadata_relationship_id"), "guarantees_same_party", "confidence_score")
    known = current(relationships).join(F.broadcast(rules), "metadata_relationship_id", "left")
    a, b = values.pair(F.col("from_party_id"), F.col("to_party_id"))
    sure = F.coalesce(F.col("guarantees_same_party") & (F.col("confidence_score") == 1.0), F.lit(False))
    soft = F.when(F.col("confidence_score") < 1.0, F.col("confidence_score") * RELATIONSHIP_WEIGHT).otherwise(0.0)
    return known.groupBy(a.alias("party_id_1"), b.alias("party_id_2")).agg(F.sum(soft).alias("relationship_score"), F.max(sure).alias("guaranteed"), F.min(F.when(sure, F.col("metadata_relationship_id"))).alias("guaranteed_by"))


def pair_summary(pairs: DataFrame, matches: DataFrame, differences: DataFrame, relationships: DataFrame, metadata_relationship: DataFrame, rules: DataFrame) -> DataFrame:
    """Per pair: counts, sums and flags that the decision needs.

    Evidence is summed per pair before it is joined, in canonical order, so
    every join is a plain equi-join of one row per pair.
    """
    ends = ["party_id_1", "party_id_2"]
    weights = rules.groupBy(F.col("attribute_subtype_id").alias("_attr")).agg(F.max("match_weight").alias("_weight"))
    a, b = values.pair(F.col("party_id_1"), F.col("party_id_2"))
    m = matches.withColumns({"_a": a, "_b": b}).join(F.broadcast(weights), F.col("match_key") == F.col("_attr"), "left")
    m = m.groupBy(F.col("_a").alias("party_id_1"), F.col("_b").alias("party_id_2")).agg(F.count("*").alias("num_matches"), F.sum(F.coalesce(F.col("confidence_score") * F.col("_weight"), F.lit(0.0))).alias("match_score"), F.min(F.when(F.col("confidence_score") == 1.0, F.col("match_key"))).alias("hard_match"))
    d = differences.withColumns({"_a": a, "_b": b}).join(F.broadcast(weights), F.col("attribute_subtype_id") == F.col("_attr"), "left")
    d = d.groupBy(F.col("_a").alias("party_id_1"), F.col("_b").alias("party_id_2")).agg(F.count("*").alias("num_differences"), F.count_if(F.col("is_hard_block")).alias("num_hard_blocks"), F.sum(F.when(F.col("_attr").isNotNull(), F.col("severity_score")).otherwise(0.0)).alias("penalty"), F.min(F.when(F.col("is_hard_block"), F.col("attribute_subtype_id"))).alias("hard_block"))
    r = relationship_pairs(relationships, metadata_relationship)
    joined = pairs.join(m, ends, "left").join(d, ends, "left").join(r, ends, "left")
    return joined.na.fill(0, ["num_matches", "num_differences", "num_hard_blocks"]).na.fill(0.0, ["match_score", "penalty", "relationship_score"]).na.fill(False, ["guaranteed"])


def decide(summary: DataFrame, rules: DataFrame, profile: Profile) -> DataFrame:
    """Add decision, score, reason and tier; the first of these that applies:

    1. a hard conflict: MUST_NOT_MERGE, 0;
    2. a hard match: by the share of matches MUST_MERGE (HIGH 1, MEDIUM 0.85) or
       REVIEW_REQUIRED (LOW 0.5);
    3. a relationship that guarantees identity: the same tiers;
    4. (matches + soft relationships - penalties) / weights, clamped: MERGE at
       the profile's threshold, else NO_MERGE.
    """
    total = rules.agg(F.coalesce(F.sum(F.when(F.col("match_weight") > 0, F.col("match_weight"))), F.lit(0.0)).alias("_total"))
    rows = summary.crossJoin(F.broadcast(total))
    share = values.ratio(F.col("num_matches"), F.col("num_differences"))
    most = F.when(F.col("_total") > 0, F.col("_total")).otherwise(1.0)
    rows = rows.withColumn("match_ratio", share).withColumn("_score", values.clamp((F.col("match_score") + F.col("relationship_score") - F.col("penalty")) / most))
    blocked, hard, sure = F.col("num_hard_blocks") > 0, F.col("hard_match").isNotNull(), F.col("guaranteed")
    linked = hard | sure
    high, middle = F.col("match_ratio") >= profile.hard_link_tier1_ratio, F.col("match_ratio") >= profile.hard_link_tier2_ratio
    merges = F.col("_score") >= profile.merge_threshold
    source = F.when(hard, F.col("hard_match")).otherwise(F.concat(F.lit("Relationship "), F.col("guaranteed_by")))
    note = F.when(high, " (high confidence)").when(middle & hard, " (medium confidence - flagged)").when(middle, " (medium confidence)").otherwise(F.concat(F.lit(" but low attribute match ("), values.percent(F.col("match_ratio")), F.lit(")")))
    return (
        rows.withColumn("decision", F.when(blocked, "MUST_NOT_MERGE").when(linked & middle, "MUST_MERGE").when(linked & high, "MUST_MERGE").when(linked, "REVIEW_REQUIRED").when(merges, "MERGE").otherwise("NO_MERGE"))
        .withColumn("score", F.when(blocked, 0.0).when(linked & high, HIGH_SCORE).when(linked & middle, MEDIUM_SCORE).when(linked, LOW_SCORE).otherwise(F.col("_score")))
        .withColumn("confidence_tier", F.when(blocked, F.lit(None)).when(linked & high, "HIGH").when(linked & middle, "MEDIUM").when(linked, "LOW"))
        .withColumn("reason", F.when(blocked, F.concat(F.lit("Hard block: "), F.col("hard_block"))).when(linked, F.concat(F.lit("Hard link: "), source, note)).otherwise(F.concat(F.format_string("Score %.2f ", F.col("_score")), F.when(merges, ">= threshold").otherwise("< threshold"))))
        .drop("_total", "_score")
    )


def candidate_pairs(matches: DataFrame, differences: DataFrame, relationships: DataFrame, attribute_parties: DataFrame) -> DataFrame:
    """Pairs with evidence or a relationship, of parties that have attributes."""
    found = union_pairs(matches.select("party_id_1", "party_id_2"), differences.select("party_id_1", "party_id_2"), current(relationships).select("from_party_id", "to_party_id"))
    own = attribute_parties.select("party_id").distinct()
    return found.join(own.withColumnRenamed("party_id", "party_id_1"), "party_id_1", "left_semi").join(own.withColumnRenamed("party_id", "party_id_2"), "party_id_2", "left_semi")


def score_pairs(pairs: DataFrame, matches: DataFrame, differences: DataFrame, relationships: DataFrame, metadata_relationship: DataFrame, rules: DataFrame, profile: Profile) -> DataFrame:
    return decide(pair_summary(pairs, matches, differences, relationships, metadata_relationship, rules), rules, profile)


def decision_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("decision").agg(F.count("*").alias("n_pairs"))


def review_queue(scored: DataFrame) -> DataFrame:
    """Pairs that a steward must look at."""
    return scored.filter("decision = 'REVIEW_REQUIRED'")

"""Master entities and the links of parties to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import values
from kinweave.operators.clusters import components
from kinweave.operators.evidence import self_pairs, union_pairs
from kinweave.operators.graph import spanning_forest
from kinweave.operators.joins import dealt_pairs
from kinweave.operators.patterns import to_parties
from kinweave.operators.scoring import decide, pair_summary
from kinweave.profiles import Profile
from kinweave.sources.tables import current
from kinweave.storage import materialize

MERGES = ("MUST_MERGE", "MERGE")


def numbered_entities(members: DataFrame) -> DataFrame:
    """(party_id, component) to (party_id, master_entity_id).

    Entities are numbered ``ENTITY_0001`` on in the order of their smallest
    party.  Components are dealt over ranges of about equal size; each is
    ranked inside its range, which starts after the sum of those before it, so
    no task orders all of them.
    """
    names = materialize(members.select("component").distinct().repartitionByRange("component").withColumn("_range", F.spark_partition_id()), "components")
    sizes = names.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("component"))
    ids = names.withColumn("_rank", rank).join(starts, "_range").select("component", values.numbered("ENTITY_", F.col("_start") + F.col("_rank")).alias("master_entity_id"))
    return members.join(ids, "component").select("party_id", "master_entity_id")


def candidate_entities(parties: DataFrame, scored: DataFrame) -> DataFrame:
    """(party_id, master_entity_id): components of the pairs that merge."""
    edges = scored.filter(F.col("decision").isin(*MERGES)).select("party_id_1", "party_id_2")
    return numbered_entities(components(parties, spanning_forest(edges)))


def entities_of_kinds(parties: DataFrame, placed: DataFrame, scored: DataFrame) -> DataFrame:
    """``candidate_entities`` from the scored pairs of ``patterns.kind_pairs``.

    Every party of a kind that merges with another or in itself is linked to
    the kind's smallest party, and the smallest parties of two that merge to
    each other, as all their pairs merge.
    """
    merged = scored.filter(F.col("decision").isin(*MERGES))
    edges = merged.select("party_id_1", "party_id_2")
    hit = merged.select("near", F.explode(F.array("party_id_1", "party_id_2")).alias("party_id")).distinct().withColumn("party_id_2", F.col("party_id"))
    star = to_parties(placed, hit).select(F.col("party_id").alias("party_id_1"), "party_id_2")
    return numbered_entities(components(parties, spanning_forest(edges.unionByName(star).filter("party_id_1 <> party_id_2"))))


def merge_edges(scored: DataFrame) -> DataFrame:
    """The entity graph: (party_id_1, party_id_2, weight, decision, reason)."""
    return scored.filter(F.col("decision").isin(*MERGES)).select("party_id_1", "party_id_2", F.col("score").alias("weight"), "decision", "reason")


def entity_pairs(entities: DataFrame) -> DataFrame:
    """All unordered pairs inside entities: master_entity_id, party_id_1, party_id_2."""
    return self_pairs(entities, ["master_entity_id"])


def inside(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """The pairs whose two parties are in one entity, with its master_entity_id."""
    key = "master_entity_id"
    one = entities.select(F.col("party_id").alias("party_id_1"), key)
    two = entities.select(F.col("party_id").alias("party_id_2"), F.col(key).alias("_other"))
    return pairs.join(one, "party_id_1").join(two, "party_id_2").filter(F.col(key) == F.col("_other")).drop("_other")


def _evidence_counts(matches: DataFrame, differences: DataFrame) -> DataFrame:
    """Per canonical pair with evidence: matches m and differences d."""
    ends = ["party_id_1", "party_id_2"]

    def counted(rows: DataFrame, name: str) -> DataFrame:
        a, b = values.pair(F.col("party_id_1"), F.col("party_id_2"))
        return rows.groupBy(a.alias("party_id_1"), b.alias("party_id_2")).agg(F.count("*").alias(name))

    return counted(matches, "m").join(counted(differences, "d"), ends, "full").na.fill(0, ["m", "d"])


def counted(pairs: DataFrame) -> DataFrame:
    """``patterns.kind_pairs`` with evidence, with matches m and differences d of each of their pairs."""
    return pairs.filter("matched <> 0 or differed <> 0").withColumns({"m": F.bit_count("matched").cast("long"), "d": F.bit_count("differed").cast("long")})


def pair_scores(entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per entity: mean, lowest and highest share of equal values over its pairs that share an attribute.

    Parties of an entity with the same values are one row with a count, so
    only different sets of values are compared, and an entity of many like
    parties costs little.
    """
    key = "master_entity_id"
    given = attributes.join(entities, "party_id").groupBy(key, "party_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subtype", "value")))).alias("has"))
    kinds = given.groupBy(key, F.to_json("has").alias("kind")).agg(F.first("has").alias("has"), F.count("*").alias("n"))
    alike = kinds.filter("n > 1").select(key, F.lit(1.0).alias("s"), (F.col("n") * (F.col("n") - 1) / 2).alias("w"))
    rows = kinds.select(key, "kind", F.map_keys("has").alias("keys"), F.map_entries("has").alias("entries"), "n")
    side = lambda i: {"kind": f"kind_{i}", "keys": f"keys_{i}", "entries": f"entries_{i}", "n": f"n_{i}"}
    pairs = dealt_pairs(rows, [key], side(1), side(2), spread=True).filter("kind_1 < kind_2")
    shared, equal = F.size(F.array_intersect("keys_1", "keys_2")), F.size(F.array_intersect("entries_1", "entries_2"))
    apart = pairs.withColumn("_shared", shared).filter("_shared > 0").select(key, (equal / F.col("_shared")).alias("s"), (F.col("n_1") * F.col("n_2")).cast("double").alias("w"))
    return alike.unionByName(apart).groupBy(key).agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("avg_s"), F.min("s").alias("min_s"), F.max("s").alias("max_s"))


def master_entities(entities: DataFrame, attributes: DataFrame, instances: DataFrame, matches: DataFrame, differences: DataFrame, at: Column) -> DataFrame:
    """MASTER_ENTITY with its analytics.

    ``attributes`` is one value per party and subtype, ``instances`` all
    standardised rows.  Singletons, and entities whose parties share no
    attribute, have average 0, lowest 1 and highest 0.
    """
    return entity_analytics(entities, attributes, instances, inside(_evidence_counts(matches, differences), entities), at)


def entity_analytics(entities: DataFrame, attributes: DataFrame, instances: DataFrame, counts: DataFrame, at: Column, exact: bool = False) -> DataFrame:
    """``master_entities`` from the matches m and differences d of each pair inside an entity that has any.

    A row of ``counts`` stands for as many pairs as its column ``pairs`` says.
    ``exact`` leaves out the rounding to four places.
    """
    shown = (lambda c: c) if exact else (lambda c: F.round(c, 4))
    key, of = "master_entity_id", F.col("pairs") if "pairs" in counts.columns else F.lit(1)
    size = entities.groupBy(key).agg(F.count("*").alias("party_count"))
    owned = instances.select(F.col("source_party_id").alias("party_id"), "attribute_subtype_id").join(entities, "party_id")
    seen = owned.groupBy(key).agg(F.count_distinct("attribute_subtype_id").alias("unique_attributes"), F.count("*").alias("total_attribute_instances"))
    agree = attributes.join(entities, "party_id").groupBy(key, "subtype").agg(F.count_distinct("value").alias("v"))
    agree = agree.groupBy(key).agg(F.count_if(F.col("v") == 1).alias("fully"), F.count_if(F.col("v") > 1).alias("against"))
    scores = pair_scores(entities, attributes)
    told = counts.withColumn("r", F.when(F.col("m") + F.col("d") > 0, F.col("m") / (F.col("m") + F.col("d"))))
    told = told.groupBy(key).agg(F.sum(F.col("m") * of).alias("total_m"), F.sum(F.col("d") * of).alias("total_d"), (F.sum(F.col("r") * of) / F.sum(F.when(F.col("r").isNotNull(), of))).alias("avg_r"))
    joined = size.join(seen, key, "left").join(agree, key, "left").join(scores, key, "left").join(told, key, "left")
    n, many = F.col("party_count"), F.col("party_count") > 1
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(
        key,
        "party_count",
        (n * (n - 1) / 2).cast("long").alias("total_pairs"),
        zero("unique_attributes").alias("unique_attributes"),
        zero("total_attribute_instances").alias("total_attribute_instances"),
        F.when(many, zero("fully")).otherwise(0).alias("fully_matching_attributes"),
        F.when(many, zero("against")).otherwise(0).alias("contradicting_attributes"),
        shown(F.coalesce("avg_s", F.lit(0.0))).alias("avg_pair_score"),
        shown(F.coalesce("min_s", F.lit(1.0))).alias("min_pair_score"),
        shown(F.coalesce("max_s", F.lit(0.0))).alias("max_pair_score"),
        zero("total_m").alias("total_match_evidence"),
        zero("total_d").alias("total_difference_evidence"),
        shown(values.ratio(zero("total_m"), zero("total_d"))).alias("evidence_match_ratio"),
        shown(F.coalesce("avg_r", F.lit(0.0))).alias("avg_evidence_ratio_per_pair"),
        at.alias("created_at"),
        at.alias("updated_at"),
        F.lit(True).alias("is_active"),
    )


def entity_links(entities: DataFrame, matches: DataFrame, differences: DataFrame, relationships: DataFrame, metadata_relationship: DataFrame, rules: DataFrame, profile: Profile, at: Column) -> DataFrame:
    """PARTY_TO_ENTITY_LINK: what joins each party to its entity.

    Every pair of peers counts for both of its parties.  Only pairs with
    evidence or a relationship are scored; all others of an entity score 0 and
    enter the mean by their number.  The decision is the strongest among peers
    (MUST_MERGE, REVIEW_REQUIRED, MERGE), the tier the weakest.
    """
    known = union_pairs(matches.select("party_id_1", "party_id_2"), differences.select("party_id_1", "party_id_2"), current(relationships).select("from_party_id", "to_party_id"))
    pairs = inside(known, entities)
    summary = pair_summary(pairs, matches, differences, relationships, metadata_relationship, rules)
    each = decide(summary, rules, profile).select("master_entity_id", F.explode(F.array("party_id_1", "party_id_2")).alias("party_id"), *TOLD, F.lit(1).alias("times"))
    return links_from(entities, tallied(each, ["master_entity_id", "party_id"]), profile, at)


#: What links read of a scored pair.
TOLD = ["decision", "score", "confidence_tier", "num_matches", "num_differences", "num_hard_blocks"]


def tallied(each: DataFrame, keys: list[str]) -> DataFrame:
    """What scored pairs (``TOLD``, each for as many peers as ``times`` says) tell per key."""
    tier = F.when(F.col("confidence_tier") == "LOW", 1).when(F.col("confidence_tier") == "MEDIUM", 2).when(F.col("confidence_tier") == "HIGH", 3)
    has = lambda d: F.max(F.col("decision") == d)
    all_ = lambda c: F.sum(F.col(c) * F.col("times"))
    return each.groupBy(*keys).agg(
        has("MUST_MERGE").alias("must"),
        has("REVIEW_REQUIRED").alias("review"),
        has("MERGE").alias("merge"),
        F.min(tier).alias("tier"),
        all_("score").alias("scores"),
        F.max("score").alias("best"),
        F.sum("times").alias("scored"),
        all_("num_matches").alias("m"),
        all_("num_differences").alias("d"),
        all_("num_hard_blocks").alias("h"),
    )


def added(tallies: DataFrame) -> DataFrame:
    """Rows of ``tallied`` as one per party and entity."""
    how = {"must": F.max, "review": F.max, "merge": F.max, "tier": F.min, "best": F.max}
    told = ["must", "review", "merge", "tier", "scores", "best", "scored", "m", "d", "h"]
    return tallies.groupBy("master_entity_id", "party_id").agg(*[how.get(c, F.sum)(c).alias(c) for c in told])


def links_from(entities: DataFrame, per_party: DataFrame, profile: Profile, at: Column, exact: bool = False) -> DataFrame:
    """``entity_links`` from what ``tallied`` says of each party with a scored pair inside its entity.

    ``exact`` leaves out the rounding to four places.
    """
    shown = (lambda c: c) if exact else (lambda c: F.round(c, 4))
    key = "master_entity_id"
    peers = entities.groupBy(key).agg((F.count("*") - 1).alias("peers"))
    joined = entities.join(peers, key).join(per_party, [key, "party_id"], "left")
    alone = F.col("peers") == 0
    silent = F.col("peers") > F.coalesce("scored", F.lit(0))  # peers without a score of their own, which is 0
    merged = F.coalesce("merge", F.lit(False)) | (silent & F.lit(profile.merge_threshold <= 0))
    joined = joined.withColumns({
        "must": F.coalesce("must", F.lit(False)),
        "review": F.coalesce("review", F.lit(False)),
        "merge": merged,
        "avg_score": F.when(~alone, F.coalesce("scores", F.lit(0.0)) / F.col("peers")),
        "best_score": F.when(~alone, F.when(silent, F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("best"))),
    })
    pick = lambda single, must, review, merge, other: F.when(alone, single).when(F.col("must"), must).when(F.col("review"), review).when(F.col("merge"), merge).otherwise(other)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    total = F.col("m") + F.col("d")
    return joined.select(
        values.stable_id(F.lit("link"), F.col("party_id"), F.col(key)).alias("link_id"),
        "party_id",
        key,
        pick("SINGLETON", "HARD_LINK", "HARD_LINK_LOW_CONFIDENCE", "SCORED", "MATCH_EVIDENCE").alias("link_type"),
        pick("SINGLETON", "MUST_MERGE", "REVIEW_REQUIRED", "MERGE", "UNKNOWN").alias("link_decision"),
        F.when(alone, 1.0).otherwise(shown(F.col("best_score"))).alias("confidence_score"),
        F.when(F.col("tier") == 1, "LOW").when(F.col("tier") == 2, "MEDIUM").when(F.col("tier") == 3, "HIGH").alias("confidence_tier"),
        shown(F.col("avg_score")).alias("avg_score_with_peers"),
        shown(F.col("best_score")).alias("best_score_with_peer"),
        zero("m").alias("num_matches"),
        zero("d").alias("num_differences"),
        zero("h").alias("num_hard_blocks"),
        shown(F.when(total > 0, F.col("m") / total)).alias("attribute_match_ratio"),
        at.alias("created_at"),
        at.alias("rec_start_date"),
        F.lit(None).cast("timestamp").alias("rec_end_date"),
        F.lit(True).alias("is_current"),
    )


def rounded(table: DataFrame) -> DataFrame:
    """An exact table of entities or links as it is published, to four places."""
    return table.withColumns({f.name: F.round(f.name, 4).alias(f.name) for f in table.schema if f.dataType.typeName() == "double"})


def link_count_faults(entities: DataFrame, links: DataFrame) -> DataFrame:
    """One row if links and entity members differ in number: (members, links)."""
    return entities.agg(F.count("*").alias("members")).crossJoin(links.agg(F.count("*").alias("links"))).filter("members <> links")

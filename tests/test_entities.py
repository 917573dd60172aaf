import pytest
from pyspark.sql import functions as F

from kinweave import profiles, schemas
from kinweave.operators import conflicts, entities, evidence, quality, scoring
from kinweave.plans.model import EVIDENCE_RULES

ATTRS = "party_id string, subtype string, value string"


def at():
    return F.lit("2026-01-01").cast("timestamp")


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([(*r, None) for r in EVIDENCE_RULES], schemas.METADATA["metadata_evidence_rule"])


def attributes(spark, people):
    return spark.createDataFrame([(p, s, v) for p, values in people.items() for s, v in values.items()], ATTRS)


def clusters(spark, members):
    rows = spark.createDataFrame(members, "party_id string, cluster_id string")
    return rows.withColumn("rec_start_date", at()).withColumn("rec_end_date", F.lit(None).cast("timestamp"))


def evidence_of(spark, rules, people, members):
    attrs = attributes(spark, people)
    rows = evidence.compared(evidence.all_pairs(attrs, clusters(spark, members)), attrs, rules)
    return attrs, evidence.match_rows(rows, at()), evidence.difference_rows(rows, at())


NO_RELS = schemas.RELATIONSHIP


def scored(spark, rules, attrs, m, d, profile=profiles.DEFAULT, rels=None, meta=None):
    rels = rels if rels is not None else spark.createDataFrame([], NO_RELS)
    meta = meta if meta is not None else spark.createDataFrame([], schemas.METADATA["metadata_relationship"])
    pairs = scoring.candidate_pairs(m, d, rels, attrs)
    return scoring.score_pairs(pairs, m, d, rels, meta, rules, profile)


SOFT = {"ATTR_EMAIL": "e", "ATTR_PHONE": "p", "ATTR_FIRST_NAME": "f", "ATTR_LAST_NAME": "l", "ATTR_DOB": "d", "ATTR_GENDER": "g", "ATTR_ADDRESS": "a"}


def test_hard_block_shows_one_row_and_no_match(spark, rules):
    people = {"a": {**SOFT, "SUB_HKID": "C123456(7)", "SUB_PASSPORT": "P1"}, "b": {**SOFT, "SUB_HKID": "C999999(9)", "SUB_PASSPORT": "P2"}}
    attrs, m, d = evidence_of(spark, rules, people, [("a", "1"), ("b", "1")])
    assert m.count() == 0
    only = d.collect()
    assert [(r.attribute_subtype_id, r.is_hard_block, r.severity_score) for r in only] == [("SUB_HKID", True, 1.0)]
    row = scored(spark, rules, attrs, m, d).first()
    assert (row.decision, row.score, row.confidence_tier) == ("MUST_NOT_MERGE", 0.0, None) and "SUB_HKID" in row.reason


def test_pairs_of_both_phases(spark, rules):
    people = {"a": {"SUB_HKID": "x", "ATTR_EMAIL": "m"}, "b": {"SUB_HKID": "x", "ATTR_EMAIL": "m"}, "c": {"ATTR_EMAIL": "m"}, "d": {"ATTR_DOB": "", "ATTR_EMAIL": "q"}, "e": {"ATTR_DOB": ""}}
    attrs = attributes(spark, people)
    pairs = evidence.all_pairs(attrs, clusters(spark, [("a", "1"), ("b", "2"), ("c", "1"), ("d", "3"), ("e", "3")]))
    got = {(r.party_id_1, r.party_id_2): r.blocking_keys for r in pairs.collect()}
    assert got == {("a", "c"): "PHASE_1", ("d", "e"): "PHASE_1", ("a", "b"): "EXACT_HKID", ("b", "c"): "EXACT_EMAIL"}
    rows = evidence.compared(pairs, attrs, rules).filter("party_id_1 = 'd'")
    assert rows.count() == 0  # an empty value counts as missing


@pytest.mark.parametrize("matches, differences, want", [(1, 1, ("MUST_MERGE", 1.0, "HIGH")), (3, 7, ("MUST_MERGE", 0.85, "MEDIUM")), (29, 71, ("REVIEW_REQUIRED", 0.5, "LOW"))])
def test_tier_boundaries(spark, rules, matches, differences, want):
    m = spark.createDataFrame([("i", "a", "b", "EXACT_MATCH", "r", "SUB_HKID", "v", 1.0 if i == 0 else 0.95, None, "k") for i in range(matches)], schemas.MATCH_EVIDENCE)
    d = spark.createDataFrame([("i", "b", "a", "ATTR_X", "1", "2", 0.2, False, "SOFT_CONFLICT", None) for _ in range(differences)], schemas.DIFFERENCE_EVIDENCE)
    row = scored(spark, rules, attributes(spark, {"a": {"x": "1"}, "b": {"x": "2"}}), m, d).first()
    assert (row.decision, row.score, row.confidence_tier) == want


def test_soft_ceiling_merges_for_analytics_only(spark, rules):
    attrs, m, d = evidence_of(spark, rules, {"a": SOFT, "b": SOFT}, [("a", "1"), ("b", "1")])
    for profile, decision in ((profiles.DEFAULT, "NO_MERGE"), (profiles.ANALYTICS, "MERGE"), (profiles.OPERATIONAL, "NO_MERGE")):
        row = scored(spark, rules, attrs, m, d, profile).first()
        assert (row.decision, round(row.score, 3), row.confidence_tier) == (decision, 0.437, None)


def test_relationships_score_and_guarantee(spark, rules):
    meta = spark.createDataFrame([("SURE", False, True, False, None, None, None, None, None, "T", 1.0), ("SOFT", False, False, False, None, None, None, None, None, "T", 0.9), ("HARD", False, False, False, None, None, None, None, None, "T", 1.0)], schemas.METADATA["metadata_relationship"])
    rel = lambda i, rule, a, b: (str(i), rule, None, a, b, None, None, None, None)
    rels = spark.createDataFrame([rel(1, "SURE", "b", "a"), rel(2, "SOFT", "c", "d"), rel(3, "HARD", "c", "e"), rel(4, None, "d", "e"), rel(5, "SOFT", "a", "zz")], schemas.RELATIONSHIP)
    attrs = attributes(spark, {p: {"ATTR_EMAIL": p} for p in "abcde"})
    none_m, none_d = spark.createDataFrame([], schemas.MATCH_EVIDENCE), spark.createDataFrame([], schemas.DIFFERENCE_EVIDENCE)
    got = {(r.party_id_1, r.party_id_2): (r.decision, round(r.score, 4)) for r in scored(spark, rules, attrs, none_m, none_d, rels=rels, meta=meta).collect()}
    assert got == {("a", "b"): ("REVIEW_REQUIRED", 0.5), ("c", "d"): ("NO_MERGE", round(0.27 / 2.5, 4)), ("c", "e"): ("NO_MERGE", 0.0), ("d", "e"): ("NO_MERGE", 0.0)}


def test_entities_links_and_analytics(spark, rules):
    same = {"SUB_HKID": "h", "ATTR_EMAIL": "e"}
    people = {"p1": {**same, "ATTR_PHONE": "1"}, "p2": {**same, "ATTR_PHONE": "2"}, "p3": {"SUB_HKID": "h", "ATTR_PHONE": "1"}, "p4": {"ATTR_EMAIL": "solo"}}
    attrs, m, d = evidence_of(spark, rules, people, [("p1", "1"), ("p2", "1"), ("p3", "1"), ("p4", "1")])
    s = scored(spark, rules, attrs, m, d)
    members = entities.candidate_entities(attrs.select("party_id").distinct(), s)
    assert {r.party_id: r.master_entity_id for r in members.collect()} == {"p1": "ENTITY_0001", "p2": "ENTITY_0001", "p3": "ENTITY_0001", "p4": "ENTITY_0002"}
    std = attrs.select(F.col("party_id").alias("source_party_id"), F.col("subtype").alias("attribute_subtype_id"))
    one, two = entities.master_entities(members, attrs, std, m, d, at()).orderBy("master_entity_id").collect()
    assert (one.party_count, one.total_pairs, one.unique_attributes, one.total_attribute_instances, one.fully_matching_attributes, one.contradicting_attributes) == (3, 3, 3, 8, 2, 1)
    assert (one.avg_pair_score, one.min_pair_score, one.max_pair_score) == (round((2 / 3 + 1 + 1 / 2) / 3, 4), 0.5, 1.0)
    assert (two.party_count, two.avg_pair_score, two.min_pair_score, two.max_pair_score, two.fully_matching_attributes) == (1, 0.0, 1.0, 0.0, 0)
    none = spark.createDataFrame([], schemas.METADATA["metadata_relationship"])
    links = {r.party_id: r for r in entities.entity_links(members, m, d, spark.createDataFrame([], NO_RELS), none, rules, profiles.DEFAULT, at()).collect()}
    assert (links["p4"].link_type, links["p4"].confidence_score, links["p4"].attribute_match_ratio) == ("SINGLETON", 1.0, None)
    assert (links["p1"].link_decision, links["p1"].confidence_tier, links["p1"].num_matches, links["p1"].num_differences) == ("MUST_MERGE", "HIGH", 4, 2 - 1)
    assert entities.link_count_faults(members, spark.createDataFrame([(1,)] * 4, "x int")).isEmpty()
    assert not entities.link_count_faults(members, spark.createDataFrame([(1,)] * 3, "x int")).isEmpty()
    assert {(r.decision, r.n_pairs) for r in scoring.decision_histogram(s).collect()} >= {("MUST_MERGE", 3)}


def test_split_one_follows_the_lightest_edge():
    chain = [("a", "b", 1.0), ("b", "c", 0.85), ("c", "d", 1.0)]
    assert conflicts.split_one(list("abcd"), chain, [("a", "d")]) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert conflicts.split_one(list("abcd"), chain, [("a", "b")]) == {"a": "a", "b": "b", "c": "b", "d": "b"}
    assert conflicts.split_one(list("abc"), [("a", "b", 1.0)], [("a", "c")]) == {"a": "a", "b": "a", "c": "c"}
    ring = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "a", 1.0)]
    assert set(conflicts.split_one(list("abcd"), ring, [("a", "c")]).values()) == {"a"}
    assert conflicts.shortest_path({"a": {"b": 1}, "b": {"a": 1}}, "a", "z") == []


BLOCK = [("R_GENDER", "GENDER_CONFLICT_WITH_SAME_NAME", "CONFLICT", "SUB_GENDER", "DIFFERENT_VALUES", None, True, 8, True, False, 0.8, None), ("R_HKID", "DIFFERENT_HKID_BLOCKS_MATCH", "CONFLICT", "SUB_HKID", "DIFFERENT_VALUES", None, True, 10, True, False, 0.8, None), ("R_DOB", "D", "TEMPORAL", "SUB_DOB", "THRESHOLD_EXCEEDED", 365.0, True, 7, True, False, 0.8, None), ("R_OFF", "OFF", "CONFLICT", "ATTR_EMAIL", "DIFFERENT_VALUES", None, False, 99, True, False, 0.8, None)]


def test_conflicts_and_split(spark):
    people = {"a": {"ATTR_FIRST_NAME": "F", "ATTR_LAST_NAME": "L", "ATTR_GENDER": "M", "ATTR_EMAIL": "1"}, "b": {"ATTR_FIRST_NAME": "F", "ATTR_LAST_NAME": "L", "ATTR_GENDER": "F", "ATTR_EMAIL": "2"}, "c": {"ATTR_FIRST_NAME": "F", "ATTR_GENDER": "F", "SUB_HKID": "1"}, "d": {"SUB_HKID": "2"}, "e": {"ATTR_EMAIL": "5"}}
    attrs = attributes(spark, people)
    members = spark.createDataFrame([*((p, "E1") for p in "abcd"), ("e", "E2")], "party_id string, master_entity_id string")
    block_rules = spark.createDataFrame(BLOCK, schemas.METADATA["metadata_blocking_rule"])
    known = spark.createDataFrame([("k1", "d", "c", "KNOWN", "R_HKID", "x", "SUB_HKID", "{}", None, True, "s"), ("k2", "a", "c", "OLD", "R", "x", "S", "{}", None, False, "s")], schemas.MATCH_BLOCKING)
    found = conflicts.entity_conflicts(members, attrs, block_rules, known)
    got = {(r.party_id_1, r.party_id_2): (r.conflict_type, r.blocking_rule_id, r.reason_code) for r in found.collect()}
    assert got == {("a", "b"): ("TRANSITIVE", "R_GENDER", "GENDER_CONFLICT"), ("c", "d"): ("DIRECT", "R_HKID", "KNOWN")}
    new = conflicts.new_blocks(found, at()).collect()
    assert [(r.blocking_reason_code, r.blocking_source) for r in new] == [("TRANSITIVE_CONFLICT", "AUTOMATIC_TRANSITIVE")] and "shared_name" in new[0].conflict_details
    assert conflicts.blocked_pairs(entities.entity_pairs(members), attrs, block_rules, alias=False).select("blocking_rule_id").distinct().collect()[0][0] == "R_HKID"
    edges = spark.createDataFrame([("a", "c", 1.0), ("b", "c", 0.85), ("c", "d", 1.0)], "party_id_1 string, party_id_2 string, weight double")
    split = {r.party_id: r.master_entity_id for r in conflicts.split_entities(members, edges, found).collect()}
    assert split["a"] == split["c"] and len({split[p] for p in "abde"}) == 4


def test_scenarios(spark):
    clusters_ = spark.createDataFrame([("S1", "alpha_lead", "L1"), ("S1", "beta_member", "P1"), ("S1", "beta_policy", "X"), ("S2", "alpha_lead", "L2"), ("S2", "alpha_lead", "L3")], "scenario_id string, source_table string, source_pk_value string")
    ents = spark.createDataFrame([("S1", "E1", '["L1","P1"]'), ("S2", "E2", '["L2","L3"]')], "scenario_id string, expected_master_entity_id string, source_party_ids string")
    matches = "scenario_id string, party_id_1 string, party_id_2 string, should_match boolean"
    good = spark.createDataFrame([("S1", "L1", "P1", True), ("S2", "L2", "L3", True)], matches)
    assert quality.scenario_faults(clusters_, ents, good, ["alpha_lead", "beta_member"]).isEmpty()
    bad = spark.createDataFrame([("S1", "L1", "Q9", True), ("S2", "L2", "L3", False)], matches)
    got = {(r.scenario_id, r.fault) for r in quality.scenario_faults(clusters_, ents.filter("scenario_id = 'S2'"), bad, ["alpha_lead", "beta_member"]).collect()}
    assert got == {("S1", "match outside clusters"), ("S1", "no entity for connected parties"), ("S1", "person without entity"), ("S2", "negative match in one entity")}

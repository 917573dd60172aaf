"""Declared schemas of all tables; nothing is inferred from data."""

from __future__ import annotations

SOURCE_PARTY = "source_party_id string, system_table_id string, party_type_id string, source_record_id string, ingestion_timestamp timestamp, is_active boolean, rec_start_date timestamp, rec_end_date timestamp"
RAW_ATTRIBUTE = "raw_attribute_id string, source_party_id string, column_id string, raw_value string, ingestion_timestamp timestamp, rec_start_date timestamp, rec_end_date timestamp"
RELATIONSHIP = "party_relationship_id string, metadata_relationship_id string, metadata_party_type_relationship_id string, from_party_id string, to_party_id string, from_matching_value string, to_matching_value string, rec_start_date timestamp, rec_end_date timestamp"
PARTY_CLUSTER = "party_id string, cluster_id string, rec_start_date timestamp, rec_end_date timestamp"
STANDARDIZED_ATTRIBUTE = "standardized_attribute_id string, raw_attribute_id string, source_party_id string, attribute_subtype_id string, standardized_value string, confidence_score double, pipeline_version string, created_at timestamp, is_current boolean"
MATCH_EVIDENCE = "evidence_id string, party_id_1 string, party_id_2 string, match_type string, match_rule_id string, match_key string, evidence_value string, confidence_score double, created_at timestamp, blocking_keys string"
DIFFERENCE_EVIDENCE = "evidence_id string, party_id_1 string, party_id_2 string, attribute_subtype_id string, value_1 string, value_2 string, severity_score double, is_hard_block boolean, difference_type string, created_at timestamp"
MATCH_BLOCKING = "blocking_id string, party_id_1 string, party_id_2 string, blocking_reason_code string, blocking_rule_id string, blocking_source string, conflicting_attribute_subtype_id string, conflict_details string, created_at timestamp, is_active boolean, created_by string"
MASTER_ENTITY = "master_entity_id string, party_count long, total_pairs long, unique_attributes long, total_attribute_instances long, fully_matching_attributes long, contradicting_attributes long, avg_pair_score double, min_pair_score double, max_pair_score double, total_match_evidence long, total_difference_evidence long, evidence_match_ratio double, avg_evidence_ratio_per_pair double, created_at timestamp, updated_at timestamp, is_active boolean"
PARTY_TO_ENTITY_LINK = "link_id string, party_id string, master_entity_id string, link_type string, link_decision string, confidence_score double, confidence_tier string, avg_score_with_peers double, best_score_with_peer double, num_matches long, num_differences long, num_hard_blocks long, attribute_match_ratio double, created_at timestamp, rec_start_date timestamp, rec_end_date timestamp, is_current boolean"

METADATA = {
    "metadata_system": "system_id string, system_name string",
    "metadata_system_table": "system_table_id string, system_id string, table_name string, main_party_type_id string",
    "metadata_party_type": "party_type_id string, party_type string",
    "metadata_column": "column_id string, source_system string, source_table string, source_column string, is_attribute boolean, is_relationship boolean, is_party_type_condition boolean, condition_column string, condition_logic string, party_type string, attribute_type string, priority double, quality_score double, is_pii boolean, requires_classification boolean",
    "metadata_attribute_type": "attribute_type_id string, attribute_name string, is_pii boolean, requires_classification boolean",
    "metadata_attribute_subtype": "attribute_subtype_id string, attribute_type_id string, subtype_name string",
    "metadata_relationship": "relationship_id string, is_bidirectional boolean, guarantees_same_party boolean, keeping_granularity_when_used boolean, from_column_id string, to_column_id string, bridge_table_id string, bridge_column_source_id string, bridge_column_target_id string, relationship_type string, confidence_score double",
    "metadata_relationship_type": "relationship_type_id string, type_name string, binding_strength string",
    "metadata_party_type_relationship": "party_type_relationship_id string, from_party_type string, to_party_type string, relationship_type string, binding_strength string, is_hierarchical boolean, is_bidirectional boolean, source_system string, source_table string",
    "metadata_evidence_rule": "attribute_subtype_id string, match_weight double, difference_weight double, hard_link_threshold double, hard_block_threshold double, is_active boolean, priority int, description string",
    "metadata_blocking_rule": "blocking_rule_id string, rule_name string, rule_type string, attribute_subtype_id string, blocking_logic string, threshold_value double, is_active boolean, priority int, applies_to_same_country boolean, requires_high_quality_sources boolean, source_quality_threshold double, created_at timestamp",
}

BRONZE = {"source_party": SOURCE_PARTY, "raw_attribute": RAW_ATTRIBUTE, "relationship": RELATIONSHIP}
SILVER = {"party_cluster": PARTY_CLUSTER, "standardized_attribute": STANDARDIZED_ATTRIBUTE, "match_evidence": MATCH_EVIDENCE, "difference_evidence": DIFFERENCE_EVIDENCE, "match_blocking": MATCH_BLOCKING}
GOLD = {"master_entity": MASTER_ENTITY, "party_to_entity_link": PARTY_TO_ENTITY_LINK}
STATE = BRONZE | SILVER | GOLD

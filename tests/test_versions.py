from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.operators import bronze, scd2
from kinweave.streaming import deltas


def month(m):
    return F.lit(f"2026-0{m}-01").cast("timestamp")


LONG = "source_party_id string, column_id string, raw_value string"


def long(spark, rows):
    return spark.createDataFrame(rows, LONG)


def seen(frame):
    return sorted((r.raw_attribute_id, r.raw_value, r.rec_end_date is None) for r in frame.collect())


def test_attribute_versions(spark):
    first = bronze.new_attributes(long(spark, [("p", "a", "1"), ("p", "b", "2"), ("q", "a", "3"), ("q", "b", None)]), month(1))
    second = scd2.merge_attributes(first, long(spark, [("p", "a", "1"), ("p", "b", "9"), ("q", "a", None), ("r", "a", "5")]), month(2))
    assert seen(second) == [("RA_p_a", "1", True), ("RA_p_b", "2", False), ("RA_p_b_v2", "9", True), ("RA_q_a", "3", False), ("RA_r_a", "5", True)]
    third = scd2.merge_attributes(second, long(spark, [("p", "b", "10")]), month(3))
    assert ("RA_p_b_v3", "10", True) in seen(third) and ("RA_p_b_v2", "9", False) in seen(third)
    assert seen(scd2.merge_attributes(third, long(spark, [("p", "b", "10")]), month(3))) == seen(third)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from("pqr"), st.sampled_from("ab"), st.one_of(st.none(), st.sampled_from("12"))), max_size=5), min_size=1, max_size=3))
def test_at_most_one_current_row_and_idempotence(spark, batches):
    table = spark.createDataFrame([], schemas.RAW_ATTRIBUTE)
    for batch in batches:
        one = list({(p, c): (p, c, v) for p, c, v in batch}.values())
        table = scd2.merge_attributes(table, long(spark, one), month(2))
        rows = table.filter("rec_end_date is null").collect()
        assert len({(r.source_party_id, r.column_id) for r in rows}) == len(rows)
        for p, c, v in one:
            assert [r.raw_value for r in rows if (r.source_party_id, r.column_id) == (p, c)] == ([v] if v is not None else [])
        assert seen(scd2.merge_attributes(table, long(spark, one), month(2))) == seen(table)


def parties(spark, rows):
    return bronze.simple_parties(spark.createDataFrame(rows, "k string"), "S", "t", "k", "TBL", "PT", month(1))


def test_party_versions_and_counts(spark):
    held = parties(spark, [("1",), ("2",)])
    assert scd2.merge_parties(held, parties(spark, [("2",), ("3",)]), month(2)).count() == 3
    flipped = parties(spark, [("2",)]).withColumn("is_active", F.lit(False))
    merged = scd2.merge_parties(held, flipped, month(2))
    assert sorted((r.source_party_id, r.is_active, r.rec_end_date is None) for r in merged.collect()) == [("SP_S_t_1", True, True), ("SP_S_t_2", True, False), ("SP_S_t_2_v2", False, True)]
    n = scd2.version_counts(merged).first()
    assert (n.current_rows, n.historical_rows, n.total_rows) == (2, 1, 3)


def edges(spark, rows):
    base = spark.createDataFrame(rows, "from_party_id string, to_party_id string")
    fill = [F.lit("R").alias("metadata_relationship_id") if c == "metadata_relationship_id" else month(1).alias(c) if c == "rec_start_date" else F.lit(None).cast("timestamp").alias(c) if c == "rec_end_date" else F.col(c) if c in base.columns else F.lit("x").alias(c) for c in (x.split()[0] for x in schemas.RELATIONSHIP.split(", "))]
    return base.select(*fill)


def test_broken_relationships_close(spark):
    held = edges(spark, [("q1", "l1"), ("q2", "l2"), ("q3", "l3")])
    delta = spark.createDataFrame([("q1",), ("q2",)], "party_id string")
    merged = scd2.merge_relationships(held, edges(spark, [("q1", "l1"), ("q2", "l9")]), month(2), delta)
    assert sorted((r.from_party_id, r.to_party_id, r.rec_end_date is None) for r in merged.collect()) == [("q1", "l1", True), ("q2", "l2", False), ("q2", "l9", True), ("q3", "l3", True)]
    assert scd2.merge_relationships(held, edges(spark, [("q1", "l1")]), month(2)).count() == 3


def test_stream_merges_each_batch(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "out"
    schema = "k string, v string"
    to_rows = lambda batch, at: batch.select(F.concat(F.lit("p"), "k").alias("source_party_id"), F.lit("a").alias("column_id"), F.col("v").alias("raw_value"))
    for i, rows in enumerate(([("1", "x"), ("2", "y")], [("1", "z"), ("3", "w")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        q = deltas.merge_stream(deltas.stream_rows(spark, f"file://{source}", schema), to_rows, deltas.merge_attributes, f"file://{folder}", "raw_attribute", schemas.RAW_ATTRIBUTE, f"file://{tmp_path}/cp")
        q.awaitTermination()
    got = seen(spark.read.parquet(f"file://{folder}/raw_attribute.parquet"))
    assert got == [("RA_p1_a", "x", False), ("RA_p1_a_v2", "z", True), ("RA_p2_a", "y", True), ("RA_p3_a", "w", True)]

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.operators import clusters, joins
from kinweave.operators.graph import connected_components

AT, LATER = "2026-01-01", "2026-02-01"
when = lambda t: F.lit(t).cast("timestamp")


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def components(spark, edges):
    rows = connected_components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_equal_union_find(spark, edges):
    assert components(spark, edges) == union_find([e for e in edges if e[0] != e[1]])


def test_chain_star_and_null(spark):
    rng = random.Random(1)
    names = rng.sample(range(1000), 60)
    edges = [*zip(names, names[1:]), *((2000, 3000 + i) for i in range(200)), (5, None)]
    assert components(spark, edges) == union_find([e for e in edges if None not in e])
    assert components(spark, []) == {}


REL = "party_relationship_id string, metadata_relationship_id string, metadata_party_type_relationship_id string, from_party_id string, to_party_id string, from_matching_value string, to_matching_value string, rec_start_date timestamp, rec_end_date timestamp"


def rels(spark, edges, at=AT):
    rows = spark.createDataFrame([(a, b) for a, b in edges], "from_party_id string, to_party_id string")
    cols = [c.split()[0] for c in REL.split(", ")]
    base = rows.withColumn("rec_start_date", when(at)).withColumn("rec_end_date", F.lit(None).cast("timestamp"))
    return base.select(*[F.col(c) if c in base.columns else F.lit(None).cast("string").alias(c) for c in cols])


def parties(spark, names):
    return spark.createDataFrame([(n,) for n in names], "party_id string")


def current(frame):
    return {r.party_id: r.cluster_id for r in frame.filter("rec_end_date is null").collect()}


def test_ids_stay_when_clusters_merge_and_split(spark):
    first = rels(spark, [("a1", "a2"), ("a2", "a3"), ("b1", "b2"), ("c1", "c2"), ("c2", "c3")])
    names = ["a1", "a2", "a3", "b1", "b2", "c1", "c2", "c3", "solo"]
    before = clusters.full_clusters(parties(spark, names), first, when(AT))
    old = current(before)
    # b joins a (3 of 5 had a's id); c loses c3 (2 of 2 keep c's id); a new party arrives
    ended = first.withColumn("rec_end_date", F.when((F.col("from_party_id") == "c2") & (F.col("to_party_id") == "c3"), when(LATER)))
    after = clusters.incremental_clusters(parties(spark, [*names, "new"]), ended.unionByName(rels(spark, [("b1", "a1")], LATER)), before, when(LATER))
    new = current(after)
    assert {new[p] for p in ("a1", "a2", "a3", "b1", "b2")} == {old["a1"]}
    assert new["c1"] == new["c2"] == old["c1"] and new["c3"] not in old.values()
    assert new["solo"] == old["solo"] and "new" in new
    rows = after.collect()
    assert sum(r.party_id == "solo" for r in rows) == 1 and sum(r.party_id == "a1" for r in rows) == 2
    assert clusters.clustering_faults(parties(spark, [*names, "new"]), after).isEmpty()
    stats = clusters.cluster_stats(after).first()
    assert (stats.total_clusters, stats.largest_cluster, stats.singleton_clusters) == (5, 5, 3)


def test_no_change_is_a_no_op(spark):
    first = rels(spark, [("a", "b")])
    before = clusters.full_clusters(parties(spark, ["a", "b", "c"]), first, when(AT))
    after = clusters.incremental_clusters(parties(spark, ["a", "b", "c"]), first, before, when(LATER))
    assert sorted(after.collect()) == sorted(before.collect())


def test_contested_id_goes_to_the_larger_overlap(spark):
    found = spark.createDataFrame([("p1", "p1"), ("p2", "p1"), ("p3", "p1"), ("p4", "p4"), ("p5", "p4")], "party_id string, component string")
    old = spark.createDataFrame([(f"p{i}", "OLD") for i in range(1, 6)], "party_id string, cluster_id string")
    kept = {r.component: r.old_id for r in clusters.keep_ids(found, old).collect()}
    assert kept == {"p1": "OLD", "p4": None}


def test_faults(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2")], "party_id string, cluster_id string").withColumn("rec_start_date", when(AT)).withColumn("rec_end_date", F.lit(None).cast("timestamp"))
    got = {(r.party_id, r.fault) for r in clusters.clustering_faults(parties(spark, ["a", "b"]), rows).collect()}
    assert got == {("a", "several clusters"), ("b", "no cluster")}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_dealt_joins_equal_plain_ones(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    left = spark.createDataFrame([(i % 3 if i < 30 else i, i) for i in range(40)] + [(None, 99)], "k int, x int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (33, "d")], "k int, y string")
    assert sorted(joins.dealt_join(left, right, ["k"], how=how).collect(), key=str) == sorted(left.join(right, ["k"], how).collect(), key=str)


def test_dealt_pairs_equal_a_self_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i % 2 if i < 20 else i, i) for i in range(25)] + [(1, 1)], "k int, x int")
    plain = rows.withColumnRenamed("x", "a").join(rows.withColumnRenamed("x", "b"), "k")
    assert sorted(joins.dealt_pairs(rows, ["k"], {"x": "a"}, {"x": "b"}).collect()) == sorted(plain.collect())


def test_components_around_hubs(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 4)
    edges = [(100, i) for i in range(30)] + [(200, i) for i in range(29, 60)] + [(i, i + 1) for i in range(300, 320)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {**dict.fromkeys([*range(60), 100, 200], 0), **dict.fromkeys(range(300, 321), 300)}

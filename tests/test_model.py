"""What the model's queries build, and that they build no more."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from kinweave.operators import evidence, graph, patterns
from kinweave.plans import catalogue, runs  # noqa: F401
from kinweave.plans.model import Model, at
from kinweave.storage import clear, shared_root

from .conftest import ROOT, SF
from .test_entry import canonical

#: Queries that read no pair of parties.
WITHOUT_PAIRS = [
    "api_cluster_relationships",
    "api_party",
    "api_party_attributes",
    "api_source_systems",
    "attributes_by_table",
    "parties_by_system",
]


@pytest.mark.parametrize("name", WITHOUT_PAIRS)
def test_a_query_builds_only_what_it_reads(spark, name):
    clear(spark)
    assert catalogue.QUERIES[name](spark, SF).count() > 0
    assert not {"pairs", "compared", "scored", "entities", "master", "links", "conflicts"} & set(vars(Model.shared(spark, SF)))
    clear(spark)


#: Queries that read pairs of parties.
WITH_PAIRS = [
    "pair_score_operational",
    "pair_score_default",
    "evidence_match",
    "evidence_difference",
    "not_found_guards",
    "dashboard_totals",
    "dashboard_size_buckets",
    "dashboard_score_buckets",
    "dashboard_quality",
    "api_parties",
    "api_entities",
    "api_clusters",
    "api_cluster_detail",
    "api_entity_detail",
    "master_entity_analytics",
    "link_count_faults",
    "party_entity_links",
    "evidence_hard_block",
]


@pytest.mark.parametrize("name", WITH_PAIRS)
def test_a_query_writes_no_pairs(spark, name):
    clear(spark)
    catalogue.QUERIES[name](spark, SF).collect()
    written = {f.rsplit("-", 1)[0] for f in os.listdir(shared_root(spark).removeprefix("file://"))}
    assert written and not {f"model-{t}" for t in ("pairs", "compared", "matches", "differences", "scored")} & written
    clear(spark)


def test_patterns_say_what_rows_of_evidence_say(spark):
    people = {"a": ("x", "h1", "e1"), "b": ("x", "h1", "e2"), "c": ("y", "h2", "e1"), "d": (None, "h1", "e1"), "e": (None, "h1", "e1"), "f": ("y", "", "e1"), "g": ("z", "", "e1"), "h": ("z", None, None)}
    attributes = spark.createDataFrame([(p, s, v) for p, (_, *vs) in people.items() for s, v in zip(("SUB_HKID", "ATTR_EMAIL"), vs, strict=True) if v is not None], "party_id string, subtype string, value string")
    clusters = spark.createDataFrame([(p, c) for p, (c, *_) in people.items() if c], "party_id string, cluster_id string")
    rules = Model(spark, SF).rules
    pairs = evidence.all_pairs(attributes, clusters)
    compared = evidence.compared(pairs, attributes, rules)
    judge = patterns.Judge.of(rules)
    judged = patterns.pairs_of(patterns.placed(attributes, clusters, judge), judge)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(judged.select(*pairs.columns)) == rows(pairs)
    assert rows(patterns.match_rows(judged, judge, at())) == rows(evidence.match_rows(compared, at()))
    assert rows(patterns.difference_rows(judged, judge, at())) == rows(evidence.difference_rows(compared, at()))


def test_a_forest_connects_what_its_edges_connect(spark, monkeypatch):
    monkeypatch.setattr(graph, "FOREST_NODES", 5)
    edges = spark.createDataFrame([(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(6) for j in range(i)], "a string, b string").coalesce(1)
    forest = graph.spanning_forest(edges)
    assert forest.count() < edges.count()
    assert sorted(graph.connected_components(forest).collect()) == sorted(graph.connected_components(edges).collect())


def _copies(spark, folder, times):
    """The smallest tables with customers copied under keys whose neighbours are copies too."""
    for name in os.listdir(SF):
        if name != "customer.parquet":
            os.symlink(f"{SF}/{name}", f"{folder}/{name}")
    rows = spark.read.parquet(f"{SF}/customer.parquet").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    rows.withColumn("c_custkey", F.col("c_custkey") * times + F.col("i")).drop("i").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


#: Queries that judge kinds of parties, or bundles.
BY_KINDS = [
    "dashboard_quality",
    "api_parties",
    "api_entities",
    "api_clusters",
    "pair_score_operational",
    "pair_score_default",
    "evidence_difference",
    "evidence_match",
    "dashboard_score_buckets",
    "dashboard_size_buckets",
    "api_entity_detail",
    "api_cluster_detail",
    "not_found_guards",
    "link_count_faults",
    "dashboard_totals",
    "master_entity_analytics",
    "party_entity_links",
]


@pytest.mark.parametrize("name", BY_KINDS)
def test_a_query_judges_kinds_or_bundles(spark, monkeypatch, name):
    """No query judges each pair of parties, but for those inside one cluster; only queries that return pairs form them."""
    clear(spark)
    pairs_of = patterns.pairs_of
    monkeypatch.setattr(patterns, "pairs_of", lambda *args, phases=None, **more: pairs_of(*args, phases=phases, **more) if phases == [-1] else pytest.fail("forms pairs of parties"))
    if not name.startswith(("pair_score", "evidence")):
        monkeypatch.setattr(patterns, "bundled_pairs", lambda *_: pytest.fail("forms pairs"))
    catalogue.QUERIES[name](spark, SF).collect()
    assert "conflicts" not in vars(Model.shared(spark, SF))
    clear(spark)


def test_pairs_of_kinds_stand_for_all_pairs(spark, tmp_path):
    (tmp_path / "copies").mkdir()
    model = Model(spark, _copies(spark, tmp_path / "copies", 6))
    pairs = patterns.pairs_of(model._placed, model.judge).filter("matched <> 0 or differed <> 0")
    by_kind = patterns.kind_pairs(model._placed, model.judge).filter("matched <> 0 or differed <> 0")
    sums = [F.sum(F.bit_count(c) * F.col("pairs")) for c in ("matched", "differed")]
    found = by_kind.agg(F.sum("pairs"), *sums, F.count("*")).first()
    assert tuple(found)[:3] == tuple(pairs.withColumn("pairs", F.lit(1)).agg(F.sum("pairs"), *sums).first())
    assert found[3] < found[0]
    clear(spark)


def test_copies_are_scored_like_their_sql(spark, tmp_path):
    """Relationships inside entities set parties apart from their kind; figures are rounded once."""
    folder = _copies(spark, tmp_path, 6)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{folder}/customer.parquet/*.parquet')")
    for name in ("party_entity_links", "master_entity_analytics", "api_entities", "pair_score_default", "evidence_difference", "evidence_match"):
        assert canonical(catalogue.QUERIES[name](spark, folder).toPandas()) == canonical(duck.execute(catalogue.ORACLES[name]).df()), name
    clear(spark)


def test_the_model_bounds_what_spark_broadcasts(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    fresh, own = spark.newSession(), spark.newSession()
    own.conf.set(name, "300k")
    for session in (fresh, own):
        Model.shared(session, SF)
    assert (fresh.conf.get(name), own.conf.get(name)) == ("1m", "300k")
    clear(spark)


#: Runs queries of an application of its own and prints, after each, how many shuffle files there are.
LEFT_OVER = """
import os, sys, time
from pyspark.sql import SparkSession
from kinweave.plans import catalogue, runs
from kinweave.storage import clear
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", sys.argv[1]).config("spark.checkpoint.dir", "file://" + sys.argv[1] + "/shared").getOrCreate()
files = lambda: sum(n.startswith("shuffle_") and n.endswith(".data") for _, _, names in os.walk(sys.argv[1]) for n in names)
for name in sys.argv[3:]:
    clear(spark)
    assert catalogue.QUERIES[name](spark, sys.argv[2]).collect()
    until = time.time() + 20
    while files() and time.time() < until:
        time.sleep(0.2)
    print("LEFT", name, files())
"""

#: Queries that write tables on their way.
WITH_TABLES = ["api_clusters", "dashboard_quality", "dashboard_totals"]


def test_queries_leave_no_shuffle_files(tmp_path):
    run = subprocess.run([sys.executable, "-c", LEFT_OVER, str(tmp_path), SF, *WITH_TABLES], check=True, cwd=ROOT, capture_output=True, text=True)
    assert [x for x in run.stdout.splitlines() if x.startswith("LEFT")] == [f"LEFT {n} 0" for n in WITH_TABLES]


def test_a_session_may_keep_its_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    fresh, own = spark.newSession(), spark.newSession()
    own.conf.set(name, "false")
    for session in (fresh, own):
        Model.shared(session, SF)
    assert (fresh.conf.get(name), own.conf.get(name)) == ("true", "false")
    clear(spark)

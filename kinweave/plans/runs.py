"""Registered queries over files, control tables, whole runs and checks, each with its SQL.

The source files of a run are written to the shared folder first, under the
names that a run looks for, so every way of reading and writing is exercised
on the whole tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions import values
from kinweave.functions.conditions import compile_condition
from kinweave.operators import bronze, clusters, conflicts, entities, quality
from kinweave.operators.metadata import Metadata
from kinweave.plans import oracles as O
from kinweave.plans import reads, views
from kinweave.plans.catalogue import _API_ENTITIES, _API_PARTIES, _entity_list, _party_list, _register
from kinweave.plans.model import Model, at
from kinweave.plans.pipeline import Run
from kinweave.profiles import ANALYTICS, DEFAULT, OPERATIONAL, Profile, list_profiles, load_profile
from kinweave.sources import tables as files
from kinweave.storage import shared_path

# Control tables of the run: how the star schema's tables become parties, attributes and edges.
_SYSTEMS = [("SYS_SALES", "Sales"), ("SYS_SUPPLY", "Supply")]
_TABLES = [("TBL_CUSTOMER", "SYS_SALES", "customer", "PT_CUSTOMER"), ("TBL_ORDERS", "SYS_SALES", "orders", None), ("TBL_LINE", "SYS_SALES", "lineitem", None), ("TBL_SUPPLIER", "SYS_SUPPLY", "supplier", "PT_SUPPLIER"), ("TBL_PART", "SYS_SUPPLY", "part", "PT_ITEM")]
_TYPES = [("PT_CUSTOMER", "sales.customer"), ("PT_FILLED", "sales.orders.filled"), ("PT_OPEN", "sales.orders.open"), ("PT_SUPPLIER", "supply.supplier"), ("PT_ITEM", "supply.part.item"), ("PT_MAKER", "supply.part.maker")]


def _column(name: str, system: str, table: str, column: str, key: bool = False, party_type: str | None = None, kind: str | None = None, condition: str | None = None) -> tuple:
    return (name, system, table, column, kind is not None, key, condition is not None, column if condition else None, condition, party_type, kind, 1.0, 0.9, False, False)


_COLUMNS = [
    _column("COL_CUSTOMER_KEY", "Sales", "customer", "c_custkey", True),
    _column("COL_CUSTOMER_NAME", "Sales", "customer", "c_name", party_type="sales.customer", kind="ATTR_LAST_NAME"),
    _column("COL_CUSTOMER_SEGMENT", "Sales", "customer", "c_mktsegment", party_type="sales.customer", kind="ATTR_ADDRESS"),
    _column("COL_ORDER_KEY", "Sales", "orders", "o_orderkey", True),
    _column("COL_ORDER_CUSTOMER", "Sales", "orders", "o_custkey", True),
    _column("COL_ORDER_STATUS", "Sales", "orders", "o_orderstatus", party_type="sales.orders.filled", condition="o_orderstatus='F'"),
    _column("COL_ORDER_STATUS", "Sales", "orders", "o_orderstatus", party_type="sales.orders.open", condition="o_orderstatus IN ('O','P')"),
    _column("COL_ORDER_PRIORITY", "Sales", "orders", "o_orderpriority", party_type="sales.orders.open", kind="ATTR_ADDRESS"),
    _column("COL_LINE_ORDER", "Sales", "lineitem", "l_orderkey", True),
    _column("COL_LINE_SUPPLIER", "Sales", "lineitem", "l_suppkey", True),
    _column("COL_SUPPLIER_KEY", "Supply", "supplier", "s_suppkey", True),
    _column("COL_SUPPLIER_NAME", "Supply", "supplier", "s_name", party_type="supply.supplier", kind="ATTR_LAST_NAME"),
    _column("COL_PART_KEY", "Supply", "part", "p_partkey", True),
    _column("COL_PART_NAME", "Supply", "part", "p_name", party_type="supply.part.item", kind="ATTR_LAST_NAME"),
    _column("COL_PART_BRAND", "Supply", "part", "p_brand", party_type="supply.part.maker", kind="ATTR_LAST_NAME"),
]
_EDGES = [
    ("R_ORDER", False, False, False, "COL_ORDER_CUSTOMER", "COL_CUSTOMER_KEY", None, None, None, "LINK", 1.0),
    ("R_SUPPLY", False, False, False, "COL_ORDER_KEY", "COL_SUPPLIER_KEY", "TBL_LINE", "COL_LINE_ORDER", "COL_LINE_SUPPLIER", "LINK", 1.0),
]
_ROLES = [("PTR_PART", "supply.part.item", "supply.part.maker", "MADE_BY", "STRONG", False, True, "Supply", "part")]
_AT0, _AT1 = datetime(2026, 1, 1), datetime(2026, 2, 1)
#: The customers that the delta renames, and the orders that it moves to customer 0.
_RENAMED, _MOVED = "c_nationkey = 3", "o_orderpriority = '1-URGENT'"


def control_folder(spark: SparkSession) -> str:
    """Write the control tables; returns their folder."""
    folder = shared_path(spark, "control")
    rows = {"system": _SYSTEMS, "system_table": _TABLES, "party_type": _TYPES, "column": _COLUMNS, "relationship": _EDGES, "party_type_relationship": _ROLES}
    for name, schema in schemas.METADATA.items():
        files.write_table(spark.createDataFrame(rows.get(name.removeprefix("metadata_"), []), schema).coalesce(1), folder, name)
    return folder


_WANTED = {"sales_customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "sales_orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "sales_lineitem": ["l_orderkey", "l_suppkey"], "supply_supplier": ["s_suppkey", "s_name"], "supply_part": ["p_partkey", "p_name", "p_brand"]}


def source_folder(m: Model, names: list[str] | None = None) -> str:
    """Write the source files under the names a run looks for; returns their folder."""
    folder = shared_path(m.spark, "sources")
    for name in names or _WANTED:
        files.write_table(m.table(name.split("_", 1)[1]).select(*_WANTED[name]), folder, name)
    return folder


def delta_folder(m: Model) -> str:
    """A delta: renamed customers and moved orders, and nothing of the other tables."""
    folder = shared_path(m.spark, "delta")
    files.write_table(m.table("customer").filter(_RENAMED).select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), "c_nationkey", "c_mktsegment"), folder, "sales_customer")
    files.write_table(m.table("orders").filter(_MOVED).select("o_orderkey", F.lit(0).cast("long").alias("o_custkey"), "o_orderstatus", "o_orderpriority"), folder, "sales_orders")
    return folder


# -- files ------------------------------------------------------------------------
@_register("io_csv_overwrite", "SELECT c_custkey, c_name, c_acctbal, c_nationkey = 3 AS is_first FROM customer")
def _(m: Model) -> DataFrame:
    """A CSV table is written, read back as text, united with new rows, and written over."""
    folder, c = shared_path(m.spark, "csv"), m.table("customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_nationkey") == 3).alias("is_first"))
    files.write_table(c.filter("is_first"), folder, "sales_customer", "csv")
    held = files.Sources(m.spark, folder).whole("Sales", "customer")
    text = [F.col(x).cast("string").alias(x) for x in c.columns]
    files.write_table(held.unionByName(c.filter("not is_first").select(*text)), folder, "sales_customer", "csv")
    return files.read_table(m.spark, folder, "sales_customer", "c_custkey long, c_name string, c_acctbal double, is_first boolean")


@_register("io_optional_and_mandatory", "SELECT * FROM (VALUES ('nation', 'optional', 'found'), ('nothing', 'optional', 'missing'), ('nation', 'mandatory', 'found'), ('nothing', 'mandatory', 'FileNotFoundError')) t(table_name, kind, outcome)")
def _(m: Model) -> DataFrame:
    out = [(n, "optional", "missing" if files.read_optional(m.spark, m.folder, n) is None else "found") for n in ("nation", "nothing")]
    for n in ("nation", "nothing"):
        try:
            files.read_table(m.spark, m.folder, n)
            out.append((n, "mandatory", "found"))
        except FileNotFoundError as e:
            out.append((n, "mandatory", type(e).__name__))
    return m.spark.createDataFrame(out, "table_name string, kind string, outcome string")


@_register("io_delta_fallback", f"SELECT 'changed customer' AS role, count(*) AS n_rows FROM customer WHERE {_RENAMED} UNION ALL SELECT 'whole customer', count(*) FROM customer UNION ALL SELECT 'bridge lineitem', count(*) FROM lineitem UNION ALL SELECT 'changed lineitem', 0 UNION ALL SELECT 'changed orders', count(*) FROM orders WHERE {_MOVED} UNION ALL SELECT 'full run', count(*) FROM customer")
def _(m: Model) -> DataFrame:
    full, delta = source_folder(m, ["sales_customer", "sales_orders", "sales_lineitem"]), delta_folder(m)
    s = files.Sources(m.spark, full, delta)
    found = {"changed customer": s.changed("Sales", "customer"), "whole customer": s.whole("Sales", "customer"), "bridge lineitem": s.bridge("Sales", "lineitem"), "changed lineitem": s.changed("Sales", "lineitem"), "changed orders": s.changed("Sales", "orders"), "full run": files.Sources(m.spark, full).changed("Sales", "customer")}
    none = m.spark.createDataFrame([], "x int")
    return bronze.union([(none if df is None else df).agg(F.lit(role).alias("role"), F.count("*").alias("n_rows")) for role, df in found.items()], "")


@_register("io_state_timestamps", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS stamp FROM orders")
def _(m: Model) -> DataFrame:
    folder = shared_path(m.spark, "state")
    files.write_table(m.table("orders").select("o_orderkey", values.iso_timestamp(F.col("o_orderdate")).alias("o_orderdate")), folder, "state", "csv")
    held = files.read_table(m.spark, folder, "state", "o_orderkey long, o_orderdate timestamp")
    return held.select("o_orderkey", values.iso_timestamp(F.col("o_orderdate")).alias("stamp"))


@_register("iso_timestamps", "SELECT event_id, CASE WHEN date_part('microseconds', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS stamp FROM events")
def _(m: Model) -> DataFrame:
    return m.table("events").select("event_id", values.iso_timestamp(F.col("ts")).alias("stamp"))


@_register("io_profiled_outputs", "SELECT 'default' AS profile, count(*) AS n_rows FROM nation UNION ALL SELECT 'operational', count(*) FROM region UNION ALL SELECT 'analytics', count(*) FROM nation")
def _(m: Model) -> DataFrame:
    folder = shared_path(m.spark, "profiled")
    files.write_profiled(m.table("nation").select(F.col("n_name").alias("name")), folder, "master_entity", DEFAULT)
    files.write_profiled(m.table("region").select(F.col("r_name").alias("name")), folder, "master_entity", OPERATIONAL)
    return bronze.union([files.read_profiled(m.spark, folder, "master_entity", p).agg(F.lit(p.name).alias("profile"), F.count("*").alias("n_rows")) for p in (DEFAULT, OPERATIONAL, ANALYTICS)], "")


@_register("io_delta_export", "SELECT 'nation' AS table_name, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def _(m: Model) -> DataFrame:
    folder = shared_path(m.spark, "export")
    names = files.write_delta({"nation": m.table("nation"), "empty": m.table("nation").filter("false"), "region": m.table("region")}, folder)
    return bronze.union([files.read_table(m.spark, folder, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows")) for n in names], "")


# -- profiles -----------------------------------------------------------------------
@_register("config_profiles", "SELECT * FROM (VALUES ('analytics', false, 0.4, 0.4, 0.2, 0.1, '_analytics'), ('default', true, 0.5, 0.5, 0.3, 0.3, ''), ('operational', false, 0.85, 0.8, 0.6, 0.4, '_operational')) t(config, is_active, merge_threshold, tier_1, tier_2, tier_3, output_suffix)")
def _(m: Model) -> DataFrame:
    known = [load_profile(n) for n in list_profiles()]
    limits = m.spark.createDataFrame([(p.name, p.merge_threshold, p.hard_link_tier1_ratio, p.hard_link_tier2_ratio, p.hard_link_tier3_ratio, p.output_suffix) for p in known], "config string, merge_threshold double, tier_1 double, tier_2 double, tier_3 double, output_suffix string")
    return reads.configs(m.spark).join(limits, "config").select("config", "is_active", *limits.columns[1:])


@_register("config_invariants", "SELECT * FROM (VALUES ('defaults', true), ('rising tiers', false), ('threshold above 1', false), ('ratio below 0', false), ('equal tiers', true)) t(given, accepted)")
def _(m: Model) -> DataFrame:
    def accepted(**given: float) -> bool:
        try:
            Profile(**given)
        except ValueError:
            return False
        return True

    tried = [("defaults", accepted()), ("rising tiers", accepted(hard_link_tier1_ratio=0.2)), ("threshold above 1", accepted(merge_threshold=1.2)), ("ratio below 0", accepted(min_attribute_match_ratio=-0.1)), ("equal tiers", accepted(hard_link_tier1_ratio=0.3))]
    return m.spark.createDataFrame(tried, "given string, accepted boolean")


@_register("api_health", "SELECT 'healthy' AS status, 'operational' AS config")
def _(m: Model) -> DataFrame:
    return reads.health(m.spark, "operational")


# -- control tables ------------------------------------------------------------------
@_register(
    "control_lookups",
    "SELECT * FROM (VALUES ('table id of Supply.part', 'TBL_PART'), ('type id of supply.supplier', 'PT_SUPPLIER'), ('type of PT_OPEN', 'sales.orders.open'), ('column COL_ORDER_CUSTOMER', 'Sales.orders.o_custkey'), ('key of Sales.orders', 'o_orderkey'), ('types of Supply.part', 'supply.part.item,supply.part.maker'), ('conditional tables', 'Sales.orders'), ('column subset tables', 'Supply.part'), ('party tables', 'Sales.customer,Sales.orders,Supply.supplier,Supply.part'), ('unknown type', 'ValueError'), ('unknown table', 'ValueError')) t(lookup, found)",
)
def _(m: Model) -> DataFrame:
    meta = Metadata.load(m.spark, control_folder(m.spark))
    every = [(s, t) for s, t in [("Sales", "customer"), ("Sales", "orders"), ("Sales", "lineitem"), ("Supply", "supplier"), ("Supply", "part")]]

    def failed(ask) -> str:
        try:
            return ask()
        except ValueError as e:
            return type(e).__name__

    listed = lambda wanted: ",".join(f"{s}.{t}" for s, t in every if wanted(s, t))
    out = [
        ("table id of Supply.part", meta.table("Supply", "part")["system_table_id"]),
        ("type id of supply.supplier", meta.party_type_id("supply.supplier")),
        ("type of PT_OPEN", meta.party_type_name("PT_OPEN")),
        ("column COL_ORDER_CUSTOMER", ".".join(meta.resolve_column("COL_ORDER_CUSTOMER"))),
        ("key of Sales.orders", meta.primary_key("Sales", "orders")),
        ("types of Supply.part", ",".join(meta.party_types("Supply", "part"))),
        ("conditional tables", listed(meta.is_conditional)),
        ("column subset tables", listed(meta.is_column_subset)),
        ("party tables", ",".join(f"{s}.{t}" for s, t in meta.party_tables())),
        ("unknown type", failed(lambda: meta.party_type_id("nobody"))),
        ("unknown table", failed(lambda: meta.table("Sales", "nothing")["table_name"])),
    ]
    return m.spark.createDataFrame(out, "lookup string, found string")


@_register("condition_length", "SELECT c_custkey, length(c_mktsegment) = 8 AS fits FROM customer")
def _(m: Model) -> DataFrame:
    return m.table("customer").select("c_custkey", compile_condition("LEN(c_mktsegment)==8").alias("fits"))


@_register("bad_rows_kept_aside", "SELECT o_orderkey, 'no party type condition matches' AS reason FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def _(m: Model) -> DataFrame:
    rules = [("o_orderstatus='F'", "sales.orders.filled"), ("o_orderstatus='O'", "sales.orders.open")]
    return bronze.sound_rows(m.table("orders"), "o_orderkey", rules)[1].select("o_orderkey", "reason")


# -- whole runs -----------------------------------------------------------------------
_PARTIES_SQL = """SELECT concat('SP_Sales_customer_', c_custkey) AS source_party_id, 'PT_CUSTOMER' AS party_type_id, 'TBL_CUSTOMER' AS system_table_id FROM customer
UNION ALL SELECT concat('SP_Sales_orders_', o_orderkey), CASE WHEN o_orderstatus = 'F' THEN 'PT_FILLED' ELSE 'PT_OPEN' END, 'TBL_ORDERS' FROM orders
UNION ALL SELECT concat('SP_Supply_supplier_', s_suppkey), 'PT_SUPPLIER', 'TBL_SUPPLIER' FROM supplier
UNION ALL SELECT concat('SP_Supply_part_', p_partkey, '_item'), 'PT_ITEM', 'TBL_PART' FROM part UNION ALL SELECT concat('SP_Supply_part_', p_partkey, '_maker'), 'PT_MAKER', 'TBL_PART' FROM part"""
_ATTRIBUTES_SQL = """SELECT concat('SP_Sales_customer_', c_custkey) AS source_party_id, 'COL_CUSTOMER_NAME@sales.customer' AS column_id, c_name AS raw_value FROM customer
UNION ALL SELECT concat('SP_Sales_customer_', c_custkey), 'COL_CUSTOMER_SEGMENT@sales.customer', c_mktsegment FROM customer
UNION ALL SELECT concat('SP_Sales_orders_', o_orderkey), 'COL_ORDER_PRIORITY@sales.orders.open', o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P')
UNION ALL SELECT concat('SP_Supply_supplier_', s_suppkey), 'COL_SUPPLIER_NAME@supply.supplier', s_name FROM supplier
UNION ALL SELECT concat('SP_Supply_part_', p_partkey, '_item'), 'COL_PART_NAME@supply.part.item', p_name FROM part
UNION ALL SELECT concat('SP_Supply_part_', p_partkey, '_maker'), 'COL_PART_BRAND@supply.part.maker', p_brand FROM part"""
_EDGES_SQL = """SELECT concat('SP_Sales_orders_', o_orderkey) AS from_party_id, concat('SP_Sales_customer_', c_custkey) AS to_party_id, 'R_ORDER' AS rule FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT DISTINCT concat('SP_Sales_orders_', o_orderkey), concat('SP_Supply_supplier_', s_suppkey), 'R_SUPPLY' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
UNION ALL SELECT concat('SP_Supply_part_', p_partkey, '_item'), concat('SP_Supply_part_', p_partkey, '_maker'), 'PTR_PART' FROM part
UNION ALL SELECT concat('SP_Supply_part_', p_partkey, '_maker'), concat('SP_Supply_part_', p_partkey, '_item'), 'PTR_PART' FROM part"""


def _full_run(m: Model) -> Run:
    run = Run(m.spark, control_folder(m.spark), files.Sources(m.spark, source_folder(m)), _AT0)
    run.bronze()
    return run


@_register("bronze_all_parties", _PARTIES_SQL)
def _(m: Model) -> DataFrame:
    meta = Metadata.load(m.spark, control_folder(m.spark))
    return bronze.all_parties(files.Sources(m.spark, source_folder(m)), meta, at()).select("source_party_id", "party_type_id", "system_table_id")


@_register("bronze_all_attributes", _ATTRIBUTES_SQL)
def _(m: Model) -> DataFrame:
    return _full_run(m).state["raw_attribute"].select("source_party_id", "column_id", "raw_value")


@_register("bronze_all_relationships", _EDGES_SQL)
def _(m: Model) -> DataFrame:
    rule = F.coalesce("metadata_relationship_id", "metadata_party_type_relationship_id").alias("rule")
    return _full_run(m).state["relationship"].select("from_party_id", "to_party_id", rule)


@_register(
    "bronze_delta_run",
    f"""SELECT 'source_party' AS table_name, count(*) AS current_rows, 0 AS historical_rows FROM ({_PARTIES_SQL})
UNION ALL SELECT 'raw_attribute', count(*), (SELECT count(*) FROM customer WHERE {_RENAMED}) FROM ({_ATTRIBUTES_SQL})
UNION ALL SELECT 'relationship', (SELECT count(*) FROM ({_EDGES_SQL})) - x.gone + x.new, x.gone FROM (SELECT count(*) FILTER (WHERE o_custkey <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)) AS gone, count(*) FILTER (WHERE o_custkey <> 0) AS new FROM orders WHERE {_MOVED}) x""",
)
def _(m: Model) -> DataFrame:
    """A full run, then a delta merged into it: versions of names, edges closed and opened."""
    first = _full_run(m)
    run = Run(m.spark, first.metadata_folder, files.Sources(m.spark, first.sources.full, delta_folder(m)), _AT1, state=dict(first.state))
    run.bronze()
    open_ = F.col("rec_end_date").isNull()
    return bronze.union([df.agg(F.lit(n).alias("table_name"), F.count_if(open_).alias("current_rows"), F.count_if(~open_).alias("historical_rows")) for n, df in run.state.items() if n in schemas.BRONZE], "")


@_register("raw_attribute_all_versions", "SELECT concat('SP_Sales_customer_', c_custkey, CASE v WHEN 2 THEN '_v2' ELSE '' END) AS source_party_id, c_name AS raw_value FROM customer, (VALUES (1), (2)) t(v) WHERE v = 1 OR c_nationkey = 3")
def _(m: Model) -> DataFrame:
    """Customers of one nation have a closed and a current version; both get their row's attributes."""
    meta, rows = Metadata.load(m.spark, control_folder(m.spark)), m.table("customer")
    parties = m.customers
    old = parties.join(rows.filter("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("source_record_id")), "source_record_id", "left_semi").select(*parties.columns)
    both = parties.join(old.select("source_party_id", F.lit(True).alias("_old")), "source_party_id", "left").withColumn("rec_end_date", F.when(F.col("_old"), at("2026-02-01 00:00:00"))).select(*parties.columns).unionByName(old.withColumn("source_party_id", values.next_version(F.col("source_party_id"))))
    long = bronze.table_attributes(rows, both, meta, "Sales", "customer", all_versions=True)
    return long.filter("column_id = 'COL_CUSTOMER_NAME@sales.customer'").select("source_party_id", "raw_value")


@_register("io_catalogue_tables", f"SELECT 'source_party' AS table_name, count(*) AS n_rows FROM ({_PARTIES_SQL}) UNION ALL SELECT 'raw_attribute', count(*) FROM ({_ATTRIBUTES_SQL}) UNION ALL SELECT 'relationship', count(*) FROM ({_EDGES_SQL}) UNION ALL SELECT 'metadata_system', 2 UNION ALL SELECT 'metadata_party_type', 6 UNION ALL SELECT 'master_entity', count(*) FROM nation UNION ALL SELECT 'party_to_entity_link', 0 UNION ALL SELECT 'match_evidence', 0")
def _(m: Model) -> DataFrame:
    """A saved run as a catalogue of views, after a switch to another profile."""
    run, folder = _full_run(m), shared_path(m.spark, "saved")
    run.save(folder)
    empty = {n: m.spark.createDataFrame([], s) for n, s in schemas.GOLD.items()}
    for name, df in empty.items():
        files.write_profiled(df, f"{folder}/gold", name)
    named = m.table("nation").select(F.col("n_name").alias("master_entity_id"))
    files.write_profiled(empty["master_entity"].unionByName(named, allowMissingColumns=True), f"{folder}/gold", "master_entity", ANALYTICS)
    c = files.Catalogue(m.spark, run.metadata_folder, f"{folder}/bronze", f"{folder}/silver", f"{folder}/gold")
    c.switch("analytics")
    names = ("source_party", "raw_attribute", "relationship", "metadata_system", "metadata_party_type", "master_entity", "party_to_entity_link", "match_evidence")
    return bronze.union([m.spark.table(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows")) for n in names], "")


# -- guards and checks --------------------------------------------------------------------
@_register("not_found_guards", "SELECT * FROM (VALUES ('cluster', false), ('entity', false), ('party', false), ('party context', false), ('known party', true)) t(asked, found)")
def _(m: Model) -> DataFrame:
    def found(ask) -> bool:
        try:
            ask()
        except reads.NotFound:
            return False
        return True

    t = m.tables
    out = [("cluster", found(lambda: reads.cluster_detail(t, "nothing"))), ("entity", found(lambda: reads.entity_detail(t, "nothing"))), ("party", found(lambda: reads.party_detail(t, "nothing"))), ("party context", found(lambda: reads.party_context(t, "nothing"))), ("known party", found(lambda: reads.party_detail(t, "SP_Sales_customer_1")))]
    return m.spark.createDataFrame(out, "asked string, found boolean")


@_register("link_count_faults", O.with_(O.links(), "SELECT (SELECT count(*) FROM ent) AS members, (SELECT count(*) FROM lnk WHERE link_type = 'SINGLETON') AS links", True))
def _(m: Model) -> DataFrame:
    """Links of singletons alone, which is too few."""
    return entities.link_count_faults(m.entities, m.links.filter("link_type = 'SINGLETON'"))


@_register("clustering_faults", f"SELECT {O.P} AS party_id, 'no cluster' AS fault FROM customer WHERE c_nationkey = 3 UNION ALL SELECT {O.P}, 'several clusters' FROM customer WHERE c_nationkey = 5")
def _(m: Model) -> DataFrame:
    """One nation's customers lack a cluster, another's have two."""
    party = F.concat(F.lit("SP_Sales_customer_"), F.col("c_custkey").cast("string")).alias("party_id")
    of = lambda nation: m.blocks.join(m.table("customer").filter(F.col("c_nationkey") == nation).select(party), "party_id", "left_semi")
    less = m.blocks.join(of(3).select("party_id"), "party_id", "left_anti")
    return clusters.clustering_faults(m.table("customer").select(party), less.unionByName(of(5).withColumn("cluster_id", F.lit("another"))))


_SCENARIO_CLUSTERS = [("S1", "A", "C1"), ("S1", "B", "C1"), ("S1", "C", "C1"), ("S1", "D", "C2"), ("S2", "E", "C3"), ("S2", "F", "C3"), ("S2", "G", "C4")]
_SCENARIO_ENTITIES = [("S1", "E1", '["A","B"]'), ("S1", "E2", '["D"]'), ("S2", "E3", '["E","F","Z"]')]
_SCENARIO_MATCHES = [("S1", "A", "B", True), ("S1", "B", "C", True), ("S1", "A", "X", False), ("S2", "E", "F", False)]


def _scenario(m: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    make = m.spark.createDataFrame
    held = make(_SCENARIO_CLUSTERS, "scenario_id string, source_pk_value string, expected_cluster_id string").withColumn("source_table", F.when(F.col("source_pk_value") == "D", "quote").otherwise("person"))
    return held, make(_SCENARIO_ENTITIES, "scenario_id string, expected_master_entity_id string, source_party_ids string"), make(_SCENARIO_MATCHES, "scenario_id string, party_id_1 string, party_id_2 string, should_match boolean")


@_register(
    "scenario_coherence",
    "SELECT * FROM (VALUES ('S1', 'match outside clusters', 'X'), ('S2', 'entity outside clusters', 'E3 Z'), ('S1', 'no entity for connected parties', 'A B C'), ('S1', 'person without entity', 'C'), ('S2', 'person without entity', 'G'), ('S2', 'negative match in one entity', 'E F')) t(scenario_id, fault, detail)",
)
def _(m: Model) -> DataFrame:
    """Expected outputs with one planted fault of each kind."""
    held, ents, pairs = _scenario(m)
    return quality.scenario_faults(held, ents, pairs, ["person"])


@_register("scenario_statistics", "SELECT 2 AS scenarios, 7 AS parties, 4 AS clusters, 3 AS entities, 4 AS matches, 2 AS positive_matches")
def _(m: Model) -> DataFrame:
    return quality.scenario_statistics(*_scenario(m)).select(*[F.col(c).cast("int").alias(c) for c in ("scenarios", "parties", "clusters", "entities", "matches", "positive_matches")])


# Entities by customer segment, a chain of customers each; the ends of a chain conflict.
_CHAIN = "SELECT c_custkey, floor(c_custkey / 5) AS g, c_custkey % 5 AS i FROM customer"


@_register(
    "conflict_split_chains",
    f"""WITH c AS ({_CHAIN}), n AS (SELECT g, max(i) AS top FROM c GROUP BY g),
cut AS (SELECT g, arg_min(i, (w, lo)) AS at FROM (SELECT c.g, c.i, 0.5 + ((c.c_custkey * 7) % 5) / 10 AS w, {O.P} AS lo FROM c JOIN n USING (g) WHERE c.i < n.top) GROUP BY g),
part AS (SELECT {O.P} AS party, c.g, CASE WHEN cut.at IS NOT NULL AND c.i > cut.at THEN 1 ELSE 0 END AS side FROM c LEFT JOIN cut USING (g)),
named AS (SELECT party, min(party) OVER (PARTITION BY g, side) AS root FROM part)
SELECT party AS party_id, printf('ENTITY_%04d', CAST(dense_rank() OVER (ORDER BY root) AS INTEGER)) AS master_entity_id FROM named""",
)
def _(m: Model) -> DataFrame:
    """Chains of five customers whose ends conflict lose their lightest edge."""
    k = F.col("c_custkey")
    party = lambda c: F.concat(F.lit("SP_Sales_customer_"), c.cast("string"))
    c = m.table("customer").select("c_custkey", F.floor(k / 5).alias("g"), (k % 5).alias("i"))
    top = c.groupBy("g").agg(F.max("c_custkey").alias("last"), F.min("c_custkey").alias("first"))
    members = c.select(party(k).alias("party_id"), F.concat(F.lit("E"), F.col("g").cast("string")).alias("master_entity_id"))
    inner = c.join(top, "g").filter("c_custkey < last")
    edges = inner.select(F.least(party(k), party(k + 1)).alias("party_id_1"), F.greatest(party(k), party(k + 1)).alias("party_id_2"), (0.5 + (k * 7 % 5) / 10).alias("weight"))
    ends = top.filter("first < last").select(F.concat(F.lit("E"), F.col("g").cast("string")).alias("master_entity_id"), F.least(party(F.col("first")), party(F.col("last"))).alias("party_id_1"), F.greatest(party(F.col("first")), party(F.col("last"))).alias("party_id_2"))
    return conflicts.split_entities(members, edges, ends)


# -- reads and views ----------------------------------------------------------------------
_BIG = "(SELECT entity FROM ent GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 1)"


@_register("api_entity_evidence", O.with_(O.links(), f"SELECT m.a AS party_id_1, m.b AS party_id_2, m.subtype AS match_key, nm AS num_matches, nd AS num_differences, round(nm / (nm + nd), 6) AS match_score FROM matches m JOIN scored2 s USING (a, b) WHERE s.entity = {_BIG}", True))
def _(m: Model) -> DataFrame:
    big = m.master.orderBy(F.desc("party_count"), "master_entity_id").first()["master_entity_id"]
    d = reads.entity_detail(m.tables, big)["match_evidence"]
    return d.select("party_id_1", "party_id_2", "match_key", "num_matches", "num_differences", F.round("match_score", 6).alias("match_score"))


@_register("api_party", O.with_(O.ATTRS, "SELECT 'SP_Sales_customer_8' AS party_id, 'Sales' AS source_system, (SELECT cluster FROM blocks WHERE party = 'SP_Sales_customer_8') AS cluster_id, (SELECT count(*) FROM attrs WHERE party = 'SP_Sales_customer_8') AS n_attributes"))
def _(m: Model) -> DataFrame:
    return reads.party_detail(m.tables, "SP_Sales_customer_8").select("party_id", "source_system", "cluster_id", F.size("attributes").cast("long").alias("n_attributes"))


@_register("api_source_systems", "SELECT * FROM (VALUES ('Sales'), ('Supply')) t(system_name)")
def _(m: Model) -> DataFrame:
    t = m.tables
    return reads.source_systems(t, t["source_party"].select(F.col("source_party_id").alias("party_id")))


@_register("ui_focus_rows", O.with_(O.EVIDENCE, "SELECT a AS party_id_1, b AS party_id_2, subtype AS match_key FROM matches WHERE a = (SELECT min(a) FROM matches) OR b = (SELECT min(a) FROM matches)"))
def _(m: Model) -> DataFrame:
    rows = m.tables["match_evidence"]
    return views.focus_rows(rows, rows.agg(F.min("party_id_1")).first()[0]).select("party_id_1", "party_id_2", "match_key")


@_register("ui_party_rows", O.with_(O.ATTRS, f"SELECT {O.P} AS party_id, count(*) AS n_attributes FROM customer JOIN attrs ON party = {O.P} WHERE contains(lower(value), 'mach') OR contains(lower(subtype), 'mach') GROUP BY 1"))
def _(m: Model) -> DataFrame:
    t = m.tables
    listed = t["source_party"].select(F.col("source_party_id").alias("party_id"), F.lit("customer").alias("source_table"))
    return views.party_rows(listed, reads.attributes_with_lineage(t), search="MACH", table="customer").select("party_id", "n_attributes")


@_register("ui_entity_facets", O.with_(_API_PARTIES, "SELECT string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS source_systems, string_agg(DISTINCT party_type, ',' ORDER BY party_type) AS party_types, count(DISTINCT cluster_id) AS n_clusters FROM pl WHERE entity_id IS NOT NULL", True))
def _(m: Model) -> DataFrame:
    found = views.entity_facets(_party_list(m).withColumn("in_entity", F.col("entity_id").isNotNull()))
    return found.select(F.array_join("source_systems", ",").alias("source_systems"), F.array_join("party_types", ",").alias("party_types"), F.size("cluster_ids").cast("long").alias("n_clusters"))


@_register("ui_attribute_filter", O.with_(O.ATTRS, "SELECT subtype AS attribute_subtype_id, count(*) AS n_values FROM attrs WHERE subtype IN ('ATTR_FIRST_NAME', 'ATTR_LAST_NAME') GROUP BY 1"))
def _(m: Model) -> DataFrame:
    return views.attribute_table(reads.attributes_with_lineage(m.tables), search="name", source="Sales").select("attribute_subtype_id", "n_values")


@_register("ui_first_items", f"SELECT cluster AS cluster_id, array_to_string(list_sort(list(party))[1:3], ',') AS first_three FROM (SELECT {O.P} AS party, concat('C', CAST(floor(c_custkey / 8) AS BIGINT)) AS cluster FROM customer) GROUP BY cluster")
def _(m: Model) -> DataFrame:
    listed = m.blocks.groupBy("cluster_id").agg(F.array_sort(F.collect_list("party_id")).alias("items"))
    return listed.select("cluster_id", F.array_join(views.first_items("items", 3), ",").alias("first_three"))


@_register("ui_entity_summary", O.with_(_API_ENTITIES, "SELECT count(*) AS n_entities, round(avg(party_count), 6) AS avg_parties, round(avg(avg_pair_score), 3) AS avg_match_score, count(*) FILTER (WHERE has_conflicts) AS with_conflicts FROM el", True))
def _(m: Model) -> DataFrame:
    s = views.entity_summary(_entity_list(m))
    return s.select("n_entities", F.round("avg_parties", 6).alias("avg_parties"), F.round("avg_match_score", 3).alias("avg_match_score"), "with_conflicts")


@_register("ui_cluster_summary", "SELECT count(*) AS n_clusters, round(avg(n), 6) AS avg_parties, 100.0::DOUBLE AS avg_resolution_percent FROM (SELECT floor(c_custkey / 8) AS g, count(*) AS n FROM customer GROUP BY 1)")
def _(m: Model) -> DataFrame:
    s = views.cluster_summary(reads.clusters(m.tables))
    return s.select("n_clusters", F.round("avg_parties", 6).alias("avg_parties"), F.round("avg_resolution_percent", 6).alias("avg_resolution_percent"))


@_register("ui_party_summary", O.with_(_API_PARTIES, "SELECT count(*) AS n_parties, count(entity_id) AS with_entity, round(avg(match_score), 4) AS avg_match_score FROM pl", True))
def _(m: Model) -> DataFrame:
    return views.party_summary(_party_list(m)).withColumn("avg_match_score", F.round("avg_match_score", 4))


@_register("ui_graph_nodes", O.with_(f"{O.links()}, {O.CONFLICTS}", "SELECT party AS party_id, party IN (SELECT a FROM conf UNION SELECT b FROM conf) AS has_conflict FROM blocks", True))
def _(m: Model) -> DataFrame:
    return views.graph_nodes(m.blocks.select("party_id"), m.tables["match_blocking"]).select("party_id", "has_conflict")


@_register("ui_pair_counts", O.with_(O.ATTRS, "SELECT status, count(*) AS n_attributes FROM (SELECT CASE WHEN x.value IS NULL OR y.value IS NULL THEN 'missing' WHEN lower(x.value) = lower(y.value) THEN 'match' ELSE 'mismatch' END AS status FROM (SELECT * FROM attrs WHERE party = 'SP_Sales_customer_1') x FULL JOIN (SELECT * FROM attrs WHERE party = 'SP_Sales_customer_2') y USING (subtype)) GROUP BY status"))
def _(m: Model) -> DataFrame:
    return views.compare_counts(views.compare_pair(m.attributes, "SP_Sales_customer_1", "SP_Sales_customer_2"))


@_register("ui_cluster_entities", O.with_(O.entities(), "SELECT DISTINCT entity AS entity_id FROM ent JOIN blocks USING (party) WHERE cluster = 'C1'", True))
def _(m: Model) -> DataFrame:
    return views.cluster_entities(reads.cluster_detail(m.tables, "C1")["parties"].filter("in_cluster"))


@_register("attribute_maps", O.with_(O.ATTRS, "SELECT party AS party_id, count(*) AS n, max(value) FILTER (WHERE subtype = 'ATTR_FIRST_NAME') AS first_name FROM attrs GROUP BY 1"))
def _(m: Model) -> DataFrame:
    from kinweave.operators.standardized import attribute_maps

    return attribute_maps(m.standardized).select("party_id", F.size("attributes").cast("long").alias("n"), F.try_element_at("attributes", F.lit("ATTR_FIRST_NAME")).alias("first_name"))


@_register("sample_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def _(m: Model) -> DataFrame:
    rows = m.table("orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("_down"))
    return quality.sample_rows(rows, ["_down", "o_orderkey"]).drop("_down")


# -- values ---------------------------------------------------------------------------------
@_register(
    "text_formats",
    """SELECT c_custkey, concat(CAST(round(abs(c_acctbal) / 10000 * 100) AS BIGINT), '%') AS share, substr(sha1(c_mktsegment), 1, 8) AS prefix_id, upper(concat('COL_sales_customer_', c_mktsegment)) AS column_id,
CASE WHEN c_acctbal >= 9000 THEN 'high' WHEN c_acctbal >= 7000 THEN 'medium' ELSE 'low' END AS band, replace(upper(concat(c_mktsegment, '_blocks_match')), '_BLOCKS_MATCH', '') AS code,
CASE WHEN c_nationkey % 2 = 0 THEN concat('Same name, different gender (a=', c_mktsegment, ', b=', c_nationkey, ')') ELSE 'Some Other Code' END AS reason FROM customer""",
)
def _(m: Model) -> DataFrame:
    even = F.col("c_nationkey") % 2 == 0
    code = F.when(even, "GENDER_CONFLICT").otherwise("SOME_OTHER_CODE")
    details = F.when(even, F.create_map(F.lit("b"), F.col("c_nationkey").cast("string"), F.lit("a"), F.col("c_mktsegment"))).otherwise(F.create_map().cast("map<string,string>"))
    return m.table("customer").select(
        "c_custkey",
        values.percent(F.round(F.abs("c_acctbal") / 10000 * 100) / 100).alias("share"),
        values.prefix_id(F.col("c_mktsegment")).alias("prefix_id"),
        values.column_key(F.lit("sales"), F.lit("customer"), F.col("c_mktsegment")).alias("column_id"),
        values.score_band(F.col("c_acctbal") / 10000).alias("band"),
        values.reason_code(F.concat("c_mktsegment", F.lit("_blocks_match"))).alias("code"),
        values.reason_text(code, details).alias("reason"),
    )


# -- streams ----------------------------------------------------------------------------------
@_register("stream_late_windows", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n_rows FROM events GROUP BY 1, 2")
def _(m: Model) -> DataFrame:
    """Events arrive as a stream; the first hour's arrive again after the watermark has passed them and are left out."""
    from kinweave.streaming.deltas import late_windows

    top = shared_path(m.spark, "events")
    rows = m.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    start = rows.agg(F.min("ts")).first()[0]
    late = rows.filter(F.col("ts") < F.lit(start) + F.expr("INTERVAL 1 HOUR"))
    # an update replaces the count of its window; batches are told apart by their number
    seen = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{top}/out/batch={n}")
    for name, part in (("1", rows), ("2", late)):
        part.coalesce(1).write.mode("append").parquet(f"{top}/in")
        stream = m.spark.readStream.schema(rows.schema).parquet(f"{top}/in")
        query = late_windows(stream, "ts", ["event_type"], "1 hour", "2 hours").select("event_type", F.col("window.start").alias("window_start"), "n_rows")
        query.writeStream.outputMode("update").foreachBatch(lambda b, n: seen(b.drop("batch"), n)).option("checkpointLocation", f"{top}/checkpoint").queryName(f"late_{name}_{top[-8:]}").trigger(availableNow=True).start().awaitTermination()
    out = m.spark.read.schema("event_type string, window_start timestamp, n_rows long, batch long").parquet(f"{top}/out")
    return out.groupBy("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.max_by("n_rows", "batch").alias("n_rows"))



"""The registered queries over the star schema, each with its SQL oracle.

Every query applies operators of this package to whole tables; the SQL in
``ORACLES`` says the same without them.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import standardize, values
from kinweave.operators import bronze, clusters, conflicts, entities, evidence, quality, relationships, scd2, scoring, standardized
from kinweave.plans import oracles as O
from kinweave.plans import reads, views
from kinweave.plans.model import T1, Model, at
from kinweave.schemas import METADATA as CONTROL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None):
    def add(build: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Model.shared(spark, folder))
        if sql is not None:
            ORACLES[name] = O.stepwise(sql)
        return build

    return add


PARTY = "source_party_id", "system_table_id", "party_type_id", "source_record_id"
C_ID, O_ID = "concat('SP_Sales_customer_', c_custkey)", "concat('SP_Sales_orders_', o_orderkey)"
O_TYPE = "CASE WHEN o_orderstatus = 'F' THEN 'PT_ORDER_FILLED' ELSE 'PT_ORDER_OPEN' END"
LINE = "concat(l_orderkey, '-', l_linenumber)"


# -- parties and attributes ---------------------------------------------------
@_register("source_party_simple", f"SELECT {C_ID} AS source_party_id, 'TBL_CUSTOMER' AS system_table_id, 'PT_CUSTOMER' AS party_type_id, CAST(c_custkey AS VARCHAR) AS source_record_id FROM customer")
def _(m: Model) -> DataFrame:
    return m.customers.select(*PARTY)


@_register("source_party_conditional", f"SELECT {O_ID} AS source_party_id, 'TBL_ORDERS' AS system_table_id, {O_TYPE} AS party_type_id, CAST(o_orderkey AS VARCHAR) AS source_record_id FROM orders")
def _(m: Model) -> DataFrame:
    return m.orders.select(*PARTY)


@_register(
    "source_party_column_subset",
    f"SELECT concat('SP_Sales_lineitem_', {LINE}, '_part') AS source_party_id, 'PT_LINE_PART' AS party_type_id, {LINE} AS source_record_id FROM lineitem WHERE l_partkey IS NOT NULL UNION ALL SELECT concat('SP_Sales_lineitem_', {LINE}, '_supplier'), 'PT_LINE_SUPPLIER', {LINE} FROM lineitem WHERE l_suppkey IS NOT NULL",
)
def _(m: Model) -> DataFrame:
    return m.lines.select("source_party_id", "party_type_id", "source_record_id")


@_register(
    "source_party_by_type",
    f"SELECT party_type, count(*) AS n_parties FROM (SELECT 'sales.customer' AS party_type FROM customer UNION ALL SELECT {O_TYPE} FROM orders UNION ALL SELECT 'PT_LINE_PART' FROM lineitem UNION ALL SELECT 'PT_LINE_SUPPLIER' FROM lineitem UNION ALL SELECT 'supply.supplier' FROM supplier) GROUP BY party_type",
)
def _(m: Model) -> DataFrame:
    parties = bronze.union([m.customers, m.orders, m.lines, m.suppliers], "")
    types = m.spark.createDataFrame([("PT_CUSTOMER", "sales.customer"), ("PT_SUPPLIER", "supply.supplier")], "party_type_id string, party_type string")
    return quality.parties_by_type(parties, types)


@_register(
    "raw_attribute_unpivot",
    "SELECT CAST(c_custkey AS VARCHAR) AS source_record_id, a AS source_column, v AS raw_value FROM (SELECT c_custkey, unnest(['name', 'segment', 'nation']) AS a, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS v FROM customer) WHERE v IS NOT NULL",
)
def _(m: Model) -> DataFrame:
    return bronze.unpivot(m.table("customer"), "c_custkey", {"name": "c_name", "segment": "c_mktsegment", "nation": "c_nationkey"}).filter("raw_value is not null")


@_register("raw_attribute_missing_party", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def _(m: Model) -> DataFrame:
    """Only customers with an urgent order become parties."""
    active = m.table("customer").join(m.table("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    parties = bronze.simple_parties(active, "Sales", "customer", "c_custkey", "TBL_CUSTOMER", "PT_CUSTOMER", at())
    return bronze.rows_without_party(m.table("customer"), parties, "c_custkey", "TBL_CUSTOMER").select("c_custkey", "c_name")


@_register("attributes_by_table", f"WITH {O.ATTRS} SELECT 'customer' AS source_table, count(*) AS n_attributes FROM attrs")
def _(m: Model) -> DataFrame:
    return quality.attributes_by_table(m.tables["raw_attribute"])


# -- relationships --------------------------------------------------------------
EDGE = "party_relationship_id", "from_party_id", "to_party_id", "from_matching_value", "to_matching_value"


@_register("rel_fk_single", f"SELECT concat('REL_FK_', {O_ID}, '_', {C_ID}) AS party_relationship_id, {O_ID} AS from_party_id, {C_ID} AS to_party_id, CAST(o_custkey AS VARCHAR) AS from_matching_value, CAST(o_custkey AS VARCHAR) AS to_matching_value FROM orders JOIN customer ON o_custkey = c_custkey")
def _(m: Model) -> DataFrame:
    return m.order_edges().select(*EDGE)


@_register(
    "rel_fk_composite",
    "WITH l AS (SELECT DISTINCT concat('SP_Sales_lineitem_', l_orderkey, '-', l_linenumber, '_part') AS p, l_partkey, l_suppkey FROM lineitem) SELECT DISTINCT x.p AS from_party_id, y.p AS to_party_id, concat(x.l_partkey, '|', x.l_suppkey) AS from_matching_value FROM l x JOIN l y ON x.l_partkey = y.l_partkey AND x.l_suppkey = y.l_suppkey",
)
def _(m: Model) -> DataFrame:
    own = relationships.main_parties(m.lines, "TBL_LINEITEM", "PT_LINE_PART")
    rows, keys = m.line_rows, ["l_partkey", "l_suppkey"]
    return relationships.foreign_key(rows, rows, "l_key", "l_key", keys, keys, own, own, "REL_SAME_PART", at()).select("from_party_id", "to_party_id", "from_matching_value")


@_register(
    "rel_bridge",
    f"SELECT DISTINCT {O_ID} AS from_party_id, concat('SP_Supply_supplier_', s_suppkey) AS to_party_id, CAST(l_orderkey AS VARCHAR) AS from_matching_value, CAST(l_suppkey AS VARCHAR) AS to_matching_value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey",
)
def _(m: Model) -> DataFrame:
    edges = relationships.bridge(m.table("lineitem"), "l_orderkey", "l_suppkey", m.table("orders"), m.table("supplier"), "o_orderkey", "s_suppkey", "o_orderkey", "s_suppkey", relationships.main_parties(m.orders, "TBL_ORDERS", None), relationships.main_parties(m.suppliers, "TBL_SUPPLIER", "PT_SUPPLIER"), "REL_ORDER_SUPPLIER", at())
    return edges.select("from_party_id", "to_party_id", "from_matching_value", "to_matching_value")


@_register(
    "rel_same_row_bidirectional",
    f"WITH l AS (SELECT DISTINCT {LINE} AS k FROM lineitem) SELECT concat('REL_SR_SP_Sales_lineitem_', k, '_part_SP_Sales_lineitem_', k, '_supplier') AS party_relationship_id, k AS from_matching_value FROM l UNION ALL SELECT concat('REL_SR_SP_Sales_lineitem_', k, '_supplier_SP_Sales_lineitem_', k, '_part'), k FROM l",
)
def _(m: Model) -> DataFrame:
    return relationships.same_row(m.lines, "TBL_LINEITEM", "PT_LINE_PART", "PT_LINE_SUPPLIER", "PTR_PART_SUPPLIER", True, at()).select("party_relationship_id", "from_matching_value")


@_register("rel_type_counts", "SELECT (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS fk_relationships, (SELECT 2 * count(DISTINCT concat(l_orderkey, '-', l_linenumber)) FROM lineitem) AS semantic_relationships")
def _(m: Model) -> DataFrame:
    rows = relationships.same_row(m.lines, "TBL_LINEITEM", "PT_LINE_PART", "PT_LINE_SUPPLIER", "PTR_PART_SUPPLIER", True, at())
    return quality.relationship_counts(m.order_edges().unionByName(rows))


# -- clusters --------------------------------------------------------------------
STAR = f"star AS (SELECT {C_ID} AS party_id, {C_ID} AS root FROM customer UNION ALL SELECT {O_ID}, coalesce(concat('SP_Sales_customer_', c_custkey), {O_ID}) FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"


@_register("clusters_full", f"WITH {STAR} SELECT party_id, md5(concat('cluster', chr(31), root)) AS cluster_id FROM star")
def _(m: Model) -> DataFrame:
    return m.order_clusters.select("party_id", "cluster_id")


@_register("cluster_stats", f"WITH {STAR}, s AS (SELECT root, count(*) AS n FROM star GROUP BY root) SELECT count(*) AS total_clusters, count(*) FILTER (WHERE n > 1) AS multi_clusters, count(*) FILTER (WHERE n = 1) AS singleton_clusters, max(n) AS largest_cluster, round(avg(n), 6) AS mean_size FROM s")
def _(m: Model) -> DataFrame:
    return clusters.cluster_stats(m.order_clusters).withColumn("mean_size", F.round("mean_size", 6))


@_register(
    "clusters_incremental",
    f"""WITH o0 AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), o1 AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'),
n0 AS (SELECT c_custkey, 1 + count(o_orderkey) AS n FROM customer LEFT JOIN o0 ON o_custkey = c_custkey GROUP BY 1),
n1 AS (SELECT c_custkey, count(*) AS added FROM customer JOIN o1 ON o_custkey = c_custkey GROUP BY 1),
c AS (SELECT n0.c_custkey, n, coalesce(added, 0) AS added, md5(concat('cluster', chr(31), 'SP_Sales_customer_', n0.c_custkey)) AS id0, md5(concat('cluster', chr(31), 'SP_Sales_customer_', n0.c_custkey, chr(31), '{T1}')) AS idn FROM n0 LEFT JOIN n1 USING (c_custkey)),
old AS (SELECT {C_ID} AS party_id, id0 AS cluster_id, added > 0 AS closed FROM c UNION ALL SELECT {O_ID}, id0, added > 0 FROM o0 JOIN c ON o_custkey = c_custkey),
new AS (SELECT {C_ID} AS party_id, CASE WHEN 2 * n > n + added THEN id0 ELSE idn END AS cluster_id, false AS closed FROM c WHERE added > 0 UNION ALL SELECT {O_ID}, CASE WHEN 2 * n > n + added THEN id0 ELSE idn END, false FROM orders JOIN c ON o_custkey = c_custkey WHERE added > 0)
SELECT * FROM old UNION ALL SELECT * FROM new""",
)
def _(m: Model) -> DataFrame:
    early, late = F.col("o_orderdate") < "1997-01-01", F.col("o_orderdate") >= "1997-01-01"
    rows = m.table("orders").join(m.table("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    known = lambda r: bronze.union([m.customers.select(F.col("source_party_id").alias("party_id")), r.select(F.concat(F.lit("SP_Sales_orders_"), F.col("o_orderkey").cast("string")).alias("party_id"))], "")
    first = m.order_edges(rows.filter(early))
    before = clusters.full_clusters(known(rows.filter(early)), first, at())
    after = clusters.incremental_clusters(known(rows), first.unionByName(m.order_edges(rows.filter(late), T1)), before, at(T1))
    return after.select("party_id", "cluster_id", F.col("rec_end_date").isNotNull().alias("closed"))


# -- versions -----------------------------------------------------------------------
@_register(
    "scd2_party_merge",
    f"SELECT {O_ID} AS source_party_id, true AS is_active, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS closed FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT concat({O_ID}, '_v2'), false, false FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 6 = 0 UNION ALL SELECT {O_ID}, o_orderkey % 3 <> 0, false FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 2 = 0",
)
def _(m: Model) -> DataFrame:
    """Four fifths of the orders are held; a delta names the even ones and ends every third."""
    key = F.col("source_record_id").cast("long")
    delta = m.orders.filter(key % 2 == 0).withColumn("is_active", key % 3 != 0).withColumn("rec_start_date", at(T1))
    merged = scd2.merge_parties(m.orders.filter(key % 5 != 0), delta, at(T1))
    return merged.select("source_party_id", "is_active", F.col("rec_end_date").isNotNull().alias("closed"))


@_register(
    "scd2_attribute_merge",
    f"SELECT concat('RA_', {C_ID}, '_SEGMENT') AS raw_attribute_id, c_mktsegment AS raw_value, c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS closed FROM customer UNION ALL SELECT concat('RA_', {C_ID}, '_SEGMENT_v2'), concat(c_mktsegment, '*'), false FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0",
)
def _(m: Model) -> DataFrame:
    """A delta changes every fifth segment and removes every seventh."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    long = lambda v: m.table("customer").select(F.concat(F.lit("SP_Sales_customer_"), key.cast("string")).alias("source_party_id"), F.lit("SEGMENT").alias("column_id"), v.alias("raw_value"))
    changed = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, F.concat(segment, F.lit("*"))).otherwise(segment)
    merged = scd2.merge_attributes(bronze.new_attributes(long(segment), at()), long(changed), at(T1))
    return merged.select("raw_attribute_id", "raw_value", F.col("rec_end_date").isNotNull().alias("closed"))


@_register(
    "scd2_rel_close_broken",
    f"WITH n AS (SELECT max(c_custkey) AS top FROM customer), o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS to_key FROM orders) SELECT {O_ID} AS from_party_id, {C_ID} AS to_party_id, o_orderkey % 10 = 0 AS closed FROM o JOIN customer ON o_custkey = c_custkey UNION ALL SELECT {O_ID}, {C_ID}, false FROM o JOIN customer ON to_key = c_custkey WHERE o_orderkey % 10 = 0",
)
def _(m: Model) -> DataFrame:
    """A delta moves every tenth order to the next customer."""
    moved = m.table("orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    delta = m.orders.select(F.col("source_party_id").alias("party_id"))
    merged = scd2.merge_relationships(m.order_edges(), m.order_edges(moved, T1), at(T1), delta)
    return merged.select("from_party_id", "to_party_id", F.col("rec_end_date").isNotNull().alias("closed"))


@_register("scd2_current_counts", "SELECT count(*) FILTER (WHERE NOT (c_custkey % 5 = 0 OR c_custkey % 7 = 0)) + count(*) FILTER (WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0) AS current_rows, count(*) FILTER (WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0) AS historical_rows, count(*) + count(*) FILTER (WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0) AS total_rows FROM customer")
def _(m: Model) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    long = lambda v: m.table("customer").select(F.concat(F.lit("SP_Sales_customer_"), key.cast("string")).alias("source_party_id"), F.lit("SEGMENT").alias("column_id"), v.alias("raw_value"))
    changed = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, F.concat(segment, F.lit("*"))).otherwise(segment)
    return scd2.version_counts(scd2.merge_attributes(bronze.new_attributes(long(segment), at()), long(changed), at(T1)))


# -- standardisation ------------------------------------------------------------------
def _std(name: str, raw: str, function, sql: str, table: str = "customer", key: str = "c_custkey") -> None:
    @_register(name, f"SELECT k, ({sql}) AS v FROM (SELECT {key} AS k, {raw} AS r FROM {table})")
    def _(m: Model) -> DataFrame:
        return m.table(table).select(F.col(key).alias("k"), F.expr(raw).alias("r")).select("k", function(F.col("r")).alias("v"))


_std("std_name", "concat('  ', lower(p_name), '.  ', p_brand, ', ', p_type, ' ')", standardize.normalize_name, r"translate(regexp_replace(upper(trim(r)), '\s+', ' ', 'g'), '.,', '')", "part", "p_partkey")
_std("std_date", "concat(' 19', CAST(c_custkey % 90 + 10 AS STRING), '-0', CAST(c_custkey % 9 + 1 AS STRING), '-15 ')", standardize.normalize_date, "trim(r)")
_std(
    "std_email",
    "CASE c_custkey % 4 WHEN 0 THEN concat(' ', c_mktsegment, '@Mail.Example.COM ') WHEN 1 THEN concat(c_mktsegment, '@local') WHEN 2 THEN c_mktsegment ELSE concat('a@b@', c_mktsegment, '.com') END",
    standardize.normalize_email,
    "CASE WHEN contains(r, '@') AND contains(split_part(lower(trim(r)), '@', 2), '.') THEN lower(trim(r)) END",
)
_std(
    "std_phone",
    "CASE c_custkey % 5 WHEN 0 THEN concat('+852-', CAST(90000000 + c_custkey AS STRING)) WHEN 1 THEN concat('852', CAST(90000000 + c_custkey AS STRING)) WHEN 2 THEN CAST(90000000 + c_custkey AS STRING) WHEN 3 THEN CAST(c_custkey AS STRING) ELSE 'none' END",
    standardize.normalize_phone,
    r"CASE WHEN regexp_replace(r, '\D', '', 'g') = '' THEN NULL WHEN NOT starts_with(r, '+') AND length(regexp_replace(r, '\D', '', 'g')) = 8 THEN concat('+852', regexp_replace(r, '\D', '', 'g')) ELSE concat('+', regexp_replace(r, '\D', '', 'g')) END",
)
_GOV = "CASE c_custkey % 4 WHEN 0 THEN concat(' a', CAST(100000 + c_custkey AS STRING), '(', CAST(c_custkey % 10 AS STRING), ')') WHEN 1 THEN concat('k', CAST(1000000 + c_custkey AS STRING)) WHEN 2 THEN concat('PA', CAST(10000000 + c_custkey AS STRING)) ELSE concat('X', CAST(c_custkey AS STRING)) END"
_GOV_SQL = r"regexp_replace(upper(trim(r)), '^([A-Z]\d{6})(\d)$', '\1(\2)')"
_std("std_gov_id", _GOV, standardize.normalize_gov_id, _GOV_SQL)
_GENDER = "CASE c_custkey % 6 WHEN 0 THEN ' male' WHEN 1 THEN 'F' WHEN 2 THEN 'Woman' WHEN 3 THEN 'non-binary' WHEN 4 THEN 'unknown' END"
_std("std_gender", _GENDER, standardize.normalize_gender, "CASE WHEN upper(trim(r)) IN ('M', 'MALE', 'MAN') THEN 'M' WHEN upper(trim(r)) IN ('F', 'FEMALE', 'WOMAN') THEN 'F' WHEN upper(trim(r)) IN ('O', 'OTHER', 'NON-BINARY') THEN 'O' ELSE upper(trim(r)) END")
_std("std_address", "concat(CAST(c_nationkey AS STRING), '   ', lower(c_mktsegment), '  st., ')", standardize.normalize_address, r"regexp_replace(upper(trim(r)), '\s+', ' ', 'g')")
_std("std_default", "concat(' ', lower(c_mktsegment))", standardize.normalize_default, "upper(trim(r))")
_std("classify_gov_id", _GOV, lambda r: standardize.classify_gov_id(standardize.normalize_gov_id(r))["subtype"], rf"CASE WHEN regexp_matches({_GOV_SQL}, '^[A-Z]{{1,2}}\d{{6}}\(\d\)$') THEN 'HKID' WHEN regexp_matches({_GOV_SQL}, '^[A-Z]{{1,2}}\d{{6,8}}$') THEN 'PASSPORT' WHEN regexp_matches({_GOV_SQL}, '^[A-Z]\d{{7,10}}$') THEN 'DRIVERS_LICENSE' ELSE 'GOV_ID_UNKNOWN' END")
_std("classify_phone", "concat('+852', CAST(20000000 + (c_custkey * 7919) % 80000000 AS STRING))", lambda r: standardize.classify_phone(r)["confidence"], r"CAST(CASE WHEN regexp_matches(r, '^\+852[96]\d{7}$') THEN 0.95 WHEN regexp_matches(r, '^\+852[23]\d{7}$') THEN 0.95 WHEN regexp_matches(r, '^\+\d{10,15}$') THEN 0.7 ELSE 0.5 END AS DOUBLE)")
_std("classify_email", "concat('x@', CASE c_custkey % 3 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'work.example' ELSE 'icloud.com' END)", lambda r: standardize.classify_email(r)["subtype"], "CASE WHEN split_part(r, '@', 2) IN ('gmail.com', 'yahoo.com', 'hotmail.com', 'outlook.com', 'icloud.com') THEN 'EMAIL_PERSONAL' ELSE 'EMAIL_GENERIC' END")


def _std_tables(m: Model) -> tuple[DataFrame, DataFrame]:
    make, at0 = m.spark.createDataFrame, at()
    types = {"Last Name": ("ATTR_LAST_NAME", "c_name", False), "Government ID": ("ATTR_GOV_ID", _GOV, True), "Gender": ("ATTR_GENDER", _GENDER, False)}
    cells = F.array(*[F.struct(F.lit(f"{t}@sales.customer").alias("c"), F.expr(x).alias("v")) for t, x, _ in types.values()])
    long = m.table("customer").select(F.concat(F.lit("SP_Sales_customer_"), F.col("c_custkey").cast("string")).alias("source_party_id"), F.explode(cells).alias("x")).select("source_party_id", F.col("x.c").alias("column_id"), F.col("x.v").alias("raw_value"))
    columns = make([(t, "Sales", "customer", t, True, False, False, None, None, "sales.customer", t, 1.0, 0.9, True, c) for t, _, c in types.values()], CONTROL["metadata_column"])
    kinds = make([(t, n, True, c) for n, (t, _, c) in types.items()], CONTROL["metadata_attribute_type"])
    subtypes = make([("SUB_HKID", "ATTR_GOV_ID", "HKID"), ("SUB_PASSPORT", "ATTR_GOV_ID", "Passport")], CONTROL["metadata_attribute_subtype"])
    raw = bronze.new_attributes(long, at0)
    return raw, standardized.standardize_attributes(raw, columns, kinds, subtypes, at0)


_STD_SQL = rf"""std AS (SELECT {C_ID} AS source_party_id, 'ATTR_LAST_NAME' AS attribute_subtype_id, translate(upper(trim(c_name)), '.,', '') AS standardized_value FROM customer
UNION ALL SELECT {C_ID}, 'SUB_HKID', {_GOV_SQL.replace('trim(r)', 'trim(r0)')} FROM (SELECT *, {_GOV} AS r0 FROM customer) WHERE regexp_matches({_GOV_SQL.replace('trim(r)', 'trim(r0)')}, '^[A-Z]{{1,2}}\d{{6}}\(\d\)$')
UNION ALL SELECT {C_ID}, 'ATTR_GENDER', CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'F' WHEN 3 THEN 'O' ELSE 'UNKNOWN' END FROM customer WHERE c_custkey % 6 < 5)"""


@_register("std_pipeline", f"WITH {_STD_SQL} SELECT * FROM std")
def _(m: Model) -> DataFrame:
    return _std_tables(m)[1].select("source_party_id", "attribute_subtype_id", "standardized_value")


@_register("std_coverage", f"WITH {_STD_SQL}, n AS (SELECT count(*) AS s, count(DISTINCT source_party_id) AS p FROM std), r AS (SELECT 2 * count(*) + count(*) FILTER (WHERE c_custkey % 6 < 5) AS raw FROM customer) SELECT raw AS raw_values, s AS standardized_values, p AS parties, round(s / raw * 100, 6) AS coverage_percent FROM n, r")
def _(m: Model) -> DataFrame:
    return standardized.coverage(*_std_tables(m)).withColumn("coverage_percent", F.round("coverage_percent", 6))


@_register("std_class_counts", f"WITH {_STD_SQL} SELECT attribute_subtype_id, count(*) AS n_values FROM std GROUP BY 1")
def _(m: Model) -> DataFrame:
    return standardized.classification_stats(_std_tables(m)[1])


# -- pairs, evidence, scores -------------------------------------------------------------
@_register("pairs_within_cluster", "SELECT x.o_custkey AS cluster_id, concat('SP_Sales_orders_', x.o_orderkey) AS party_id_1, concat('SP_Sales_orders_', y.o_orderkey) AS party_id_2 FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND concat('SP_Sales_orders_', x.o_orderkey) < concat('SP_Sales_orders_', y.o_orderkey)")
def _(m: Model) -> DataFrame:
    rows = m.table("orders").select(F.col("o_custkey").alias("cluster_id"), F.concat(F.lit("SP_Sales_orders_"), F.col("o_orderkey").cast("string")).alias("party_id"))
    return evidence.self_pairs(rows, ["cluster_id"])


@_register("pairs_blocking", f"WITH {O.PAIRS} SELECT a AS party_id_1, b AS party_id_2, label AS blocking_keys FROM pairs")
def _(m: Model) -> DataFrame:
    return m.pairs


@_register("pairs_blocking_stats", f"WITH {O.PAIRS}, f AS (SELECT *, min(CASE WHEN NOT same THEN ord END) OVER (PARTITION BY a, b) AS first FROM cand) SELECT label AS blocking_keys, count(*) AS candidates, count(*) FILTER (WHERE same) AS same_cluster, count(*) FILTER (WHERE NOT same AND ord > first) AS seen, count(*) FILTER (WHERE NOT same AND ord = first) AS compared FROM f GROUP BY label")
def _(m: Model) -> DataFrame:
    return evidence.across_stats(m.attributes, m.blocks)


@_register("evidence_match", f"WITH {O.EVIDENCE} SELECT a AS party_id_1, b AS party_id_2, concat('RULE_EXACT_', subtype) AS match_rule_id, subtype AS match_key, va AS evidence_value, CAST(conf AS DOUBLE) AS confidence_score, label AS blocking_keys FROM matches")
def _(m: Model) -> DataFrame:
    return m.matches.select("party_id_1", "party_id_2", "match_rule_id", "match_key", "evidence_value", "confidence_score", "blocking_keys")


@_register("evidence_difference", f"WITH {O.EVIDENCE} SELECT a AS party_id_1, b AS party_id_2, subtype AS attribute_subtype_id, va AS value_1, vb AS value_2, CAST(severity AS DOUBLE) AS severity_score FROM diffs WHERE NOT hard")
def _(m: Model) -> DataFrame:
    return m.differences.filter("not is_hard_block").select("party_id_1", "party_id_2", "attribute_subtype_id", "value_1", "value_2", "severity_score")


@_register("evidence_hard_block", f"WITH {O.EVIDENCE} SELECT a AS party_id_1, b AS party_id_2, subtype AS attribute_subtype_id, 'HARD_CONFLICT' AS difference_type FROM diffs WHERE hard")
def _(m: Model) -> DataFrame:
    return m.differences.filter("is_hard_block").select("party_id_1", "party_id_2", "attribute_subtype_id", "difference_type")


@_register("evidence_phase_stats", f"WITH {O.EVIDENCE}, m AS (SELECT a, b, count(*) AS m FROM matches GROUP BY 1, 2), d AS (SELECT a, b, bool_or(hard) AS h FROM diffs GROUP BY 1, 2) SELECT label AS blocking_keys, count(*) AS pairs, count(m.m) AS with_matches, count(d.h) AS with_differences, count(*) FILTER (WHERE d.h) AS hard_blocked, count(*) FILTER (WHERE m.m IS NULL AND d.h IS NULL) AS without_evidence FROM pairs LEFT JOIN m USING (a, b) LEFT JOIN d USING (a, b) GROUP BY label")
def _(m: Model) -> DataFrame:
    return evidence.phase_stats(m.pairs, m.matches, m.differences)


def _score(profile: str) -> None:
    sql = f"WITH {O.scored(profile)} SELECT a AS party_id_1, b AS party_id_2, decision, round(score, 6) AS score, tier AS confidence_tier, round(ratio, 6) AS match_ratio, nm AS num_matches, nd AS num_differences FROM scored"

    @_register(f"pair_score_{profile}", sql)
    def _(m: Model) -> DataFrame:
        s = Model.shared(m.spark, m.folder, profile).scored
        return s.select("party_id_1", "party_id_2", "decision", F.round("score", 6).alias("score"), "confidence_tier", F.round("match_ratio", 6).alias("match_ratio"), "num_matches", "num_differences")


for _name in ("default", "operational", "analytics"):
    _score(_name)


@_register("decision_histogram", f"WITH {O.scored()} SELECT decision, count(*) AS n_pairs FROM scored GROUP BY decision")
def _(m: Model) -> DataFrame:
    return scoring.decision_histogram(m.scored)


@_register("review_queue", f"WITH {O.scored()} SELECT a AS party_id_1, b AS party_id_2, round(ratio, 6) AS match_ratio FROM scored WHERE decision = 'REVIEW_REQUIRED'")
def _(m: Model) -> DataFrame:
    return scoring.review_queue(m.scored).select("party_id_1", "party_id_2", F.round("match_ratio", 6).alias("match_ratio"))


# -- entities -------------------------------------------------------------------------------
@_register("entities", O.with_(O.entities(), "SELECT party AS party_id, entity AS master_entity_id FROM ent", True))
def _(m: Model) -> DataFrame:
    return m.entities


@_register(
    "master_entity_analytics",
    O.with_(O.master(), "SELECT entity AS master_entity_id, n AS party_count, CAST(total_pairs AS BIGINT) AS total_pairs, u AS unique_attributes, CAST(i AS BIGINT) AS total_attribute_instances, f AS fully_matching_attributes, c AS contradicting_attributes, round(av, 3) AS avg_pair_score, round(mi, 3) AS min_pair_score, round(ma, 3) AS max_pair_score, CAST(m AS BIGINT) AS total_match_evidence, CAST(d AS BIGINT) AS total_difference_evidence, round(er, 3) AS evidence_match_ratio FROM mst", True),
)
def _(m: Model) -> DataFrame:
    out = m.exact_master
    r = lambda c: F.round(c, 3).alias(c)
    return out.select("master_entity_id", "party_count", "total_pairs", "unique_attributes", "total_attribute_instances", "fully_matching_attributes", "contradicting_attributes", r("avg_pair_score"), r("min_pair_score"), r("max_pair_score"), "total_match_evidence", "total_difference_evidence", r("evidence_match_ratio"))


@_register(
    "party_entity_links",
    O.with_(O.links(), "SELECT party AS party_id, entity AS master_entity_id, link_type, link_decision, round(confidence, 3) AS confidence_score, tier AS confidence_tier, round(av, 3) AS avg_score_with_peers, CAST(m AS BIGINT) AS num_matches, CAST(d AS BIGINT) AS num_differences, CAST(h AS BIGINT) AS num_hard_blocks FROM lnk", True),
)
def _(m: Model) -> DataFrame:
    r = lambda c: F.round(c, 3).alias(c)
    return m.exact_links.select("party_id", "master_entity_id", "link_type", "link_decision", r("confidence_score"), "confidence_tier", r("avg_score_with_peers"), "num_matches", "num_differences", "num_hard_blocks")


@_register("transitive_conflicts", O.with_(f"{O.links()}, {O.CONFLICTS}", "SELECT entity AS master_entity_id, a AS party_id_1, b AS party_id_2, rid AS blocking_rule_id, 'TRANSITIVE' AS conflict_type FROM conf", True))
def _(m: Model) -> DataFrame:
    return m.conflicts.select("master_entity_id", "party_id_1", "party_id_2", "blocking_rule_id", "conflict_type")


@_register("conflict_split", None)
def _(m: Model) -> DataFrame:
    return conflicts.split_entities(m.entities, entities.merge_edges(m.scored), m.conflicts)


@_register("doc_exact_duplicates", "WITH g AS (SELECT md5(text) AS h, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1) SELECT doc_id, first AS representative, n AS copies FROM documents JOIN g ON md5(text) = h")
def _(m: Model) -> DataFrame:
    docs = m.table("documents").select("doc_id", F.md5("text").alias("h"))
    groups = docs.groupBy("h").agg(F.min("doc_id").alias("representative"), F.count("*").alias("copies"))
    return docs.join(groups, "h").select("doc_id", "representative", "copies")


# -- read queries ----------------------------------------------------------------------------
@_register(
    "api_clusters",
    O.with_(
        f"""{O.links()}, ci AS (SELECT cluster, count(*) AS n FROM blocks GROUP BY 1), li AS (SELECT cluster, count(DISTINCT entity) AS ec, count(*) AS l FROM blocks JOIN lnk USING (party) GROUP BY 1),
ri AS (SELECT cluster, count(*) AS rc FROM (SELECT DISTINCT b.cluster, r.p, r.q FROM rel r JOIN blocks b ON b.party IN (r.p, r.q)) GROUP BY 1),
ei AS (SELECT x.cluster, count(*) AS ev FROM matches m JOIN blocks x ON x.party = m.a JOIN blocks y ON y.party = m.b AND x.cluster = y.cluster GROUP BY 1)""",
        "SELECT cluster AS cluster_id, n AS party_count, coalesce(ec, 0) AS entity_count, round(coalesce(l, 0) / n, 6) AS resolution_rate, coalesce(rc, 0) AS relationship_count, coalesce(ev, 0) AS evidence_count, 'Sales' AS source_systems FROM ci LEFT JOIN li USING (cluster) LEFT JOIN ri USING (cluster) LEFT JOIN ei USING (cluster)",
        True,
    ),
)
def _(m: Model) -> DataFrame:
    return reads.clusters(m.tables).select("cluster_id", "party_count", "entity_count", F.round("resolution_rate", 6).alias("resolution_rate"), "relationship_count", "evidence_count", F.array_join("source_systems", ",").alias("source_systems"))


_API_ENTITIES = f"{O.master()}, {O.NAMES}, {O.CONFLICTS}, cc AS (SELECT entity, count(*) AS k FROM conf GROUP BY 1), rs2 AS (SELECT entity, avg(confidence) AS r FROM lnk GROUP BY 1), el AS (SELECT mst.entity AS entity_id, coalesce(primary_name, 'Unknown') AS primary_name, n AS party_count, CAST(m AS BIGINT) AS match_evidence_count, coalesce(k, 0) AS conflict_count, coalesce(k, 0) > 0 AS has_conflicts, round(r, 4) AS resolution_score, CASE WHEN n > 1 THEN round(av, 3) END AS avg_pair_score FROM mst LEFT JOIN nm2 USING (entity) LEFT JOIN cc USING (entity) LEFT JOIN rs2 USING (entity))"


def _entity_list(m: Model) -> DataFrame:
    exact = ChainMap({"master_entity": m.exact_master, "party_to_entity_link": m.exact_links}, m.tables)
    return reads.entities(exact).select("entity_id", "primary_name", "party_count", "match_evidence_count", "conflict_count", "has_conflicts", F.round("resolution_score", 4).alias("resolution_score"), F.round("avg_pair_score", 3).alias("avg_pair_score"))


@_register("api_entities", O.with_(_API_ENTITIES, "SELECT * FROM el", True))
def _(m: Model) -> DataFrame:
    return _entity_list(m)


_API_PARTIES = f"""{O.links()}, pc AS (SELECT a, b, coalesce(nm, 0) AS nm, coalesce(nd, 0) AS nd FROM ms FULL JOIN dsum USING (a, b)),
pr AS (SELECT party, avg(CASE WHEN nm + nd > 0 THEN nm / (nm + nd) END) AS s FROM (SELECT e.a AS party, nm, nd FROM epairs e JOIN pc USING (a, b) UNION ALL SELECT e.b, nm, nd FROM epairs e JOIN pc USING (a, b)) GROUP BY 1),
es AS (SELECT entity, count(*) AS n FROM ent GROUP BY 1), ac AS (SELECT party, count(*) AS n, max(value) FILTER (WHERE subtype = 'ATTR_FIRST_NAME') AS f, max(value) FILTER (WHERE subtype = 'ATTR_LAST_NAME') AS l, max(value) FILTER (WHERE subtype = 'ATTR_EMAIL') AS em FROM attrs GROUP BY 1),
pl AS (SELECT party AS party_id, 'sales.customer' AS party_type, 'Sales' AS source_system, 'customer' AS source_table, cluster AS cluster_id, lnk.entity AS entity_id, es.n AS entity_party_count, round(CASE WHEN es.n = 1 THEN confidence ELSE s END, 6) AS match_score, concat(f, ' ', l) AS display_name, em AS email, ac.n AS attribute_count FROM blocks JOIN lnk USING (party) JOIN es USING (entity) LEFT JOIN pr USING (party) JOIN ac USING (party)
 UNION ALL SELECT concat('SP_Supply_supplier_', s_suppkey), 'supply.supplier', 'Supply', 'supplier', NULL, NULL, 0, NULL, NULL, NULL, 0 FROM supplier)"""


def _party_list(m: Model) -> DataFrame:
    return reads.parties(m.tables).select("party_id", "party_type", "source_system", "source_table", "cluster_id", "entity_id", "entity_party_count", F.round("match_score", 6).alias("match_score"), "display_name", "email", "attribute_count")


@_register("api_parties", O.with_(_API_PARTIES, "SELECT * FROM pl", True))
def _(m: Model) -> DataFrame:
    return _party_list(m)


@_register("api_entity_detail", O.with_(O.links(), "SELECT lnk.party AS party_id, cluster AS cluster_id, link_type AS resolution_method, round(confidence, 4) AS link_confidence, n AS n_attributes FROM lnk JOIN blocks USING (party) JOIN (SELECT party, count(*) AS n FROM attrs GROUP BY 1) USING (party) WHERE entity = 'ENTITY_0001'", True))
def _(m: Model) -> DataFrame:
    d = reads.entity_detail(m.tables, "ENTITY_0001")["parties"]
    return d.select("party_id", "cluster_id", "resolution_method", F.round("link_confidence", 4).alias("link_confidence"), F.size("attributes").cast("long").alias("n_attributes"))


_NEAR = "near AS (SELECT party FROM core UNION SELECT p FROM rel WHERE p IN (SELECT party FROM core) OR q IN (SELECT party FROM core) UNION SELECT q FROM rel WHERE p IN (SELECT party FROM core) OR q IN (SELECT party FROM core))"


@_register("api_cluster_detail", O.with_(f"{O.links()}, core AS (SELECT party FROM blocks WHERE cluster = 'C1'), {_NEAR}", "SELECT near.party AS party_id, near.party IN (SELECT party FROM core) AS in_cluster, entity AS entity_id FROM near LEFT JOIN lnk USING (party)", True))
def _(m: Model) -> DataFrame:
    return reads.cluster_detail(m.tables, "C1")["parties"].select("party_id", "in_cluster", "entity_id")


@_register("api_cluster_relationships", O.with_(f"{O.ATTRS}, {O._rels()}, core AS (SELECT party FROM blocks WHERE cluster = 'C1'), {_NEAR}", "SELECT p AS from_party_id, q AS to_party_id, CASE WHEN sure THEN 'SAME_PARTY' ELSE 'SOFT_LINK' END AS relationship_type FROM rel WHERE p IN (SELECT party FROM near) OR q IN (SELECT party FROM near)"))
def _(m: Model) -> DataFrame:
    return reads.cluster_detail(m.tables, "C1")["relationships"].select("from_party_id", "to_party_id", F.col("metadata.relationship_type").alias("relationship_type"))


@_register("api_party_detail", O.with_(f"{O.links()}, ic AS (SELECT party FROM blocks WHERE cluster = 'C1'), ie AS (SELECT party FROM ent WHERE entity = (SELECT entity FROM ent WHERE party = 'SP_Sales_customer_8')), core AS (SELECT party FROM ic UNION SELECT party FROM ie), {_NEAR}", "SELECT party AS party_id, party IN (SELECT party FROM ic) AS in_cluster, party IN (SELECT party FROM ie) AS in_entity, party = 'SP_Sales_customer_8' AS is_focus FROM near", True))
def _(m: Model) -> DataFrame:
    return reads.party_context(m.tables, "SP_Sales_customer_8")["parties"].select("party_id", "in_cluster", "in_entity", "is_focus")


@_register("api_party_attributes", O.with_(O.ATTRS, "SELECT party AS party_id, subtype AS attribute_subtype_id, value AS standardized_value, lower(subtype) AS source_column FROM attrs"))
def _(m: Model) -> DataFrame:
    return reads.attributes_with_lineage(m.tables).select("party_id", "attribute_subtype_id", "standardized_value", "source_column")


@_register("api_search", O.with_(f"{O.entities()}, {O.NAMES}", "SELECT entity AS entity_id, primary_name, n AS party_count FROM (SELECT entity, count(*) AS n FROM ent GROUP BY 1) JOIN nm2 USING (entity) WHERE entity IN (SELECT entity FROM ent JOIN attrs USING (party) WHERE contains(lower(value), 'build')) ORDER BY entity LIMIT 20", True))
def _(m: Model) -> DataFrame:
    return reads.search(m.tables, "BUILD")


@_register("api_blocking", O.with_(f"{O.links()}, {O.CONFLICTS}", "SELECT a AS party_id_1, b AS party_id_2, 'TRANSITIVE_CONFLICT' AS blocking_reason_code, rname AS rule_name, CAST(CASE WHEN rid = 'RULE_PHONE' THEN 2 ELSE 3 END AS BIGINT) AS n_details FROM conf", True))
def _(m: Model) -> DataFrame:
    t = m.tables
    d = reads.blocking_for(t, t["source_party"].select(F.col("source_party_id").alias("party_id")))
    return d.select("party_id_1", "party_id_2", "blocking_reason_code", F.col("rule_info.rule_name").alias("rule_name"), F.size("conflict_details").cast("long").alias("n_details"))


# -- dashboard ---------------------------------------------------------------------------------
@_register("dashboard_totals", O.with_(f"{O.entities()}", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS total_parties, (SELECT count(DISTINCT entity) FROM ent) AS total_entities, CAST(2 AS BIGINT) AS total_systems, (SELECT count(DISTINCT value) FROM attrs WHERE subtype = 'SUB_HKID') AS distinct_hkids, (SELECT count(*) FROM attrs) AS total_attributes, (SELECT count(*) FROM rel) AS total_relationships, (SELECT count(DISTINCT subtype) FROM attrs) AS unique_attribute_types", True))
def _(m: Model) -> DataFrame:
    return reads.dashboard_totals(m.tables)


@_register("dashboard_score_buckets", O.with_(O.master(), "SELECT count(*) FILTER (WHERE round(av, 4) >= 0.99) AS perfect_match, count(*) FILTER (WHERE round(av, 4) >= 0.8 AND round(av, 4) < 0.99) AS high_match, count(*) FILTER (WHERE round(av, 4) >= 0.5 AND round(av, 4) < 0.8) AS medium_match, count(*) FILTER (WHERE round(av, 4) > 0 AND round(av, 4) < 0.5) AS low_match, count(*) FILTER (WHERE av = 0) AS no_match FROM mst", True))
def _(m: Model) -> DataFrame:
    return reads.score_buckets(m.tables)


@_register("dashboard_size_buckets", O.with_(O.master(), "SELECT count(*) FILTER (WHERE n = 1) AS single_party, count(*) FILTER (WHERE n = 2) AS two_parties, count(*) FILTER (WHERE n = 3) AS three_parties, count(*) FILTER (WHERE n >= 4) AS four_plus_parties FROM mst", True))
def _(m: Model) -> DataFrame:
    return reads.size_buckets(m.tables)


@_register("dashboard_quality", O.with_(f"{O.master()}, {O.CONFLICTS}", "SELECT count(*) FILTER (WHERE c > 0) AS entities_with_contradictions, round(avg(round(av, 4)) FILTER (WHERE n > 1), 4) AS avg_entity_match_score, round(avg(u), 4) AS avg_unique_attrs_per_entity, round(avg(c), 4) AS avg_contradicting_attrs, (SELECT count(*) FROM matches) AS total_match_evidence, (SELECT count(*) FROM conf) AS total_blocking_pairs, round(sum(m) / count(*), 4) AS avg_match_evidence_per_entity FROM mst", True))
def _(m: Model) -> DataFrame:
    q = reads.quality_metrics(m.tables)
    return q.select(*[F.round(c, 4).alias(c) if c.startswith("avg") else F.col(c) for c in q.columns])


@_register("parties_by_system", "SELECT 'SYS_SALES' AS system_id, count(*) AS n_parties FROM customer UNION ALL SELECT 'SYS_SUPPLY', count(*) FROM supplier")
def _(m: Model) -> DataFrame:
    return reads.parties_by_system(m.tables)


@_register("steward_review", O.with_(O.links(), "SELECT party AS party_id, link_decision, tier AS confidence_tier FROM lnk WHERE link_decision = 'REVIEW_REQUIRED' OR tier = 'MEDIUM'", True))
def _(m: Model) -> DataFrame:
    m.links.createOrReplaceTempView("party_to_entity_link")
    return reads.steward_review(m.spark).select("party_id", "link_decision", "confidence_tier")


@_register("steward_tiers", O.with_(O.links(), "SELECT tier AS confidence_tier, count(*) AS n_links FROM lnk WHERE link_type LIKE 'HARD_LINK%' GROUP BY tier", True))
def _(m: Model) -> DataFrame:
    m.links.createOrReplaceTempView("party_to_entity_link")
    return reads.steward_tiers(m.spark)


# -- views ----------------------------------------------------------------------------------------
@_register("ui_entity_filter_sort", O.with_(_API_ENTITIES, "SELECT * FROM el WHERE contains(lower(primary_name), 'a') AND party_count > 1 AND avg_pair_score >= 0.6", True))
def _(m: Model) -> DataFrame:
    return views.sort_by(views.filter_entities(_entity_list(m), search="A", hide_singletons=True, min_score=0.6), "avg_pair_score", True, views.ENTITY_SORTS)


@_register("ui_party_filter_sort", O.with_(_API_PARTIES, "SELECT * FROM pl WHERE source_system = 'Sales' AND contains(lower(display_name), 'mach') AND match_score >= 0.5", True))
def _(m: Model) -> DataFrame:
    found = views.filter_parties(_party_list(m).withColumn("gov_id", F.lit(None).cast("string")), search="mach", source="Sales", has_entity=True, min_score=0.5)
    return views.sort_by(found.drop("gov_id"), "display_name", False, views.PARTY_SORTS)


@_register("ui_cluster_filter_sort", "SELECT concat('C', CAST(floor(c_custkey / 8) AS BIGINT)) AS cluster_id, count(*) AS party_count FROM customer GROUP BY 1 HAVING contains(concat('C', CAST(floor(any_value(c_custkey) / 8) AS BIGINT)), '1') AND count(*) BETWEEN 2 AND 8")
def _(m: Model) -> DataFrame:
    found = views.filter_clusters(clusters.cluster_sizes(m.blocks), search="1", min_parties=2, max_parties=8)
    return views.sort_by(found, "party_count", True)


_SHOWN = "('ATTR_GOV_ID_TYPE', 'ATTR_RELATIONSHIP_TYPE', 'ATTR_GENDER')"


@_register("ui_attribute_mode_share", O.with_(O.ATTRS, f"SELECT subtype AS attribute_subtype_id, sum(n)::BIGINT AS n_values, count(*) AS n_distinct, round(max(n) / sum(n) * 100, 6) AS match_percent, replace(replace(subtype, 'ATTR_', ''), '_', ' ') AS label FROM (SELECT subtype, lower(value) AS v, count(*) AS n FROM attrs WHERE subtype NOT IN {_SHOWN} GROUP BY 1, 2) GROUP BY subtype"))
def _(m: Model) -> DataFrame:
    t = views.attribute_table(reads.attributes_with_lineage(m.tables))
    return t.select("attribute_subtype_id", "n_values", "n_distinct", F.round("match_percent", 6).alias("match_percent"), "label")


@_register("ui_pair_compare", O.with_(O.ATTRS, "SELECT subtype, x.value AS value_1, y.value AS value_2, CASE WHEN x.value IS NULL OR y.value IS NULL THEN 'missing' WHEN lower(x.value) = lower(y.value) THEN 'match' ELSE 'mismatch' END AS status FROM (SELECT * FROM attrs WHERE party = 'SP_Sales_customer_1') x FULL JOIN (SELECT * FROM attrs WHERE party = 'SP_Sales_customer_2') y USING (subtype)"))
def _(m: Model) -> DataFrame:
    return views.compare_pair(m.attributes, "SP_Sales_customer_1", "SP_Sales_customer_2")


@_register("ui_cluster_group", O.with_(_API_PARTIES, "SELECT coalesce(cluster_id, 'NO_CLUSTER') AS cluster_id, count(*) AS party_count, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS source_systems FROM pl GROUP BY 1", True))
def _(m: Model) -> DataFrame:
    return views.group_by_cluster(_party_list(m)).select("cluster_id", "party_count", F.array_join("source_systems", ",").alias("source_systems"))


@_register("ui_entity_group", O.with_(_API_PARTIES, "SELECT entity_id, count(*) AS party_count, string_agg(party_id, ',' ORDER BY party_id) AS party_ids FROM pl WHERE entity_id IS NOT NULL GROUP BY 1", True))
def _(m: Model) -> DataFrame:
    return views.group_by_entity(_party_list(m)).select("entity_id", "party_count", F.array_join("party_ids", ",").alias("party_ids"))


@_register("ui_edge_labels", O.with_(O.SUMS, "SELECT a AS party_id_1, b AS party_id_2, CAST(round(nm / (nm + coalesce(nd, 0)) * 100) AS DOUBLE) AS match_percent FROM ms LEFT JOIN dsum USING (a, b)"))
def _(m: Model) -> DataFrame:
    t = m.tables
    rows = reads.evidence_for(t, t["source_party"].select(F.col("source_party_id").alias("party_id")))
    return views.edge_labels(rows).select("party_id_1", "party_id_2", "match_percent")


@_register("ui_graph_edges", O.with_(f"{O.links()}, {O.CONFLICTS}, vis AS (SELECT {O.P} AS party FROM customer)", "SELECT * FROM (SELECT a AS source, b AS target, 'evidence' AS edge_type FROM ms UNION ALL SELECT a, b, 'blocking' FROM conf UNION ALL SELECT DISTINCT p, q, 'relationship' FROM rel) WHERE source IN (SELECT party FROM vis) AND target IN (SELECT party FROM vis)", True))
def _(m: Model) -> DataFrame:
    visible = m.table("customer").select(F.concat(F.lit("SP_Sales_customer_"), F.col("c_custkey").cast("string")).alias("party_id"))
    t = m.tables
    return views.graph_edges(t["match_evidence"], t["match_blocking"], t["relationship"], visible)


@_register("ui_filter_options", "SELECT DISTINCT c_mktsegment AS option FROM customer")
def _(m: Model) -> DataFrame:
    return views.filter_options(m.table("customer"), "c_mktsegment")


@_register("ui_share_of_total", "SELECT c_mktsegment, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer) * 100, 6) AS percent FROM customer GROUP BY 1")
def _(m: Model) -> DataFrame:
    shares = views.share_of_total(m.table("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "n")
    return shares.withColumn("percent", F.round("percent", 6))


# -- values -----------------------------------------------------------------------------------------
@_register("json_conflict_details", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def _(m: Model) -> DataFrame:
    return m.table("events").select("event_id", values.parsed_json(F.col("props"))["k"].alias("k"))


@_register("event_late_windows", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n_rows FROM events GROUP BY 1, 2")
def _(m: Model) -> DataFrame:
    from kinweave.streaming.deltas import late_windows

    out = late_windows(m.table("events"), "ts", ["event_type"], "1 hour", "2 hours")
    return out.select("event_type", F.col("window.start").alias("window_start"), "n_rows")


@_register("id_versions", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('k', c_custkey, '_v2') WHEN 1 THEN concat('k_v', c_custkey + 1) ELSE concat('k_vx', c_custkey, '_v2') END AS next_id FROM customer")
def _(m: Model) -> DataFrame:
    k = F.col("c_custkey")
    row_id = F.when(k % 3 == 0, F.concat(F.lit("k"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("k_v"), k.cast("string"))).otherwise(F.concat(F.lit("k_vx"), k.cast("string")))
    return m.table("customer").select("c_custkey", values.next_version(row_id).alias("next_id"))


@_register("duplicate_keys", "SELECT l_orderkey, l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(m: Model) -> DataFrame:
    return quality.duplicates(m.table("lineitem"), ["l_orderkey", "l_partkey"])

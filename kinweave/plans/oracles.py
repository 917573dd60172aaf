"""DuckDB SQL that says independently what the registered queries compute."""

from __future__ import annotations

import re

from kinweave.plans.model import ATTRIBUTE_SQL, BLOCKING_RULES, EVIDENCE_RULES, T0, T1
from kinweave.profiles import BUILT_IN

P = "concat('SP_Sales_customer_', c_custkey)"
AT, AT1 = f"TIMESTAMP '{T0}'", f"TIMESTAMP '{T1}'"


def _null(v: object) -> str:
    return "NULL" if v is None else ("'" + v + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v))


_RULES = ", ".join(f"({', '.join(_null(v) for v in r)})" for r in EVIDENCE_RULES)
_BLOCKING = ", ".join(f"({', '.join(_null(v) for v in r)})" for r in BLOCKING_RULES)
_ATTRS = " UNION ALL ".join(f"SELECT {P} AS party, '{s}' AS subtype, {x} AS value FROM customer" for s, x in ATTRIBUTE_SQL.items())

ATTRS = f"""attrs AS (SELECT * FROM ({_ATTRS}) WHERE value IS NOT NULL),
rules(subtype, mw, dw, hl, hb, active, prio) AS (VALUES {_RULES}),
blocks AS (SELECT {P} AS party, concat('C', CAST(floor(c_custkey / 8) AS BIGINT)) AS cluster FROM customer)"""

PAIRS = f"""{ATTRS},
keys(subtype, label, ord) AS (VALUES ('SUB_HKID','EXACT_HKID',0),('SUB_PASSPORT','EXACT_PASSPORT',1),('ATTR_EMAIL','EXACT_EMAIL',2),('ATTR_DOB','EXACT_DOB',3)),
p1 AS (SELECT a.party AS a, b.party AS b, 'PHASE_1' AS label FROM blocks a JOIN blocks b ON a.cluster = b.cluster AND a.party < b.party),
cand AS (SELECT x.party AS a, y.party AS b, k.label, k.ord, cx.cluster = cy.cluster AS same
  FROM attrs x JOIN attrs y ON x.subtype = y.subtype AND x.value = y.value AND x.party < y.party JOIN keys k ON k.subtype = x.subtype
  JOIN blocks cx ON cx.party = x.party JOIN blocks cy ON cy.party = y.party),
p2 AS (SELECT a, b, arg_min(label, ord) AS label FROM cand WHERE NOT same GROUP BY a, b),
pairs AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""

EVIDENCE = f"""{PAIRS},
cmp0 AS (SELECT p.a, p.b, p.label, x.subtype, x.value AS va, y.value AS vb, x.value = y.value AS eq, r.*  EXCLUDE (subtype),
    (x.value <> y.value AND coalesce(r.hb = 1.0, false)) AS hard
  FROM pairs p JOIN attrs x ON x.party = p.a JOIN attrs y ON y.party = p.b AND y.subtype = x.subtype JOIN rules r ON r.subtype = x.subtype
  WHERE r.active AND x.value <> '' AND y.value <> ''),
cmp AS (SELECT *, bool_or(hard) OVER (PARTITION BY a, b) AS blocked, row_number() OVER (PARTITION BY a, b ORDER BY hard DESC, prio DESC, subtype) AS rn FROM cmp0),
matches AS (SELECT a, b, label, subtype, va, CASE WHEN coalesce(hl = 1.0, false) THEN 1.0 ELSE 0.95 END AS conf, mw FROM cmp WHERE eq AND NOT blocked AND mw > 0),
diffs AS (SELECT a, b, label, subtype, va, vb, CASE WHEN hard THEN 1.0 ELSE dw END AS severity, hard FROM cmp WHERE (hard AND rn = 1) OR (NOT blocked AND NOT eq AND dw > 0))"""


def _rels() -> str:
    return """rel AS (SELECT concat('SP_Sales_customer_', x.c_custkey) AS p, concat('SP_Sales_customer_', y.c_custkey) AS q, x.c_custkey % 10 = 0 AS sure
  FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1),
relp AS (SELECT least(p, q) AS a, greatest(p, q) AS b, sum(CASE WHEN sure THEN 0.0 ELSE 0.9 * 0.3 END) AS rs, bool_or(sure) AS sure FROM rel GROUP BY 1, 2)"""


SUMS = f"""{EVIDENCE}, {_rels()},
ms AS (SELECT a, b, count(*) AS nm, sum(conf * mw) AS msc, min(subtype) FILTER (WHERE conf = 1.0) AS hm FROM matches GROUP BY a, b),
dsum AS (SELECT a, b, count(*) AS nd, count(*) FILTER (WHERE hard) AS nh, sum(severity) AS pen FROM diffs GROUP BY a, b)"""


def decided(profile: str, universe: str) -> str:
    """CTE ``scored`` over the pairs of ``universe`` (a, b)."""
    p = BUILT_IN[profile]
    return f"""summ AS (SELECT u.*, coalesce(nm, 0) AS nm, coalesce(nd, 0) AS nd, coalesce(nh, 0) AS nh, coalesce(msc, 0.0) AS msc, coalesce(pen, 0.0) AS pen, coalesce(rs, 0.0) AS rs, coalesce(sure, false) AS sure, hm
  FROM {universe} u LEFT JOIN ms USING (a, b) LEFT JOIN dsum USING (a, b) LEFT JOIN relp USING (a, b)),
scr AS (SELECT *, CASE WHEN nm + nd > 0 THEN nm / (nm + nd) ELSE 0.0 END AS ratio, greatest(0.0, least(1.0, (msc + rs - pen) / (SELECT sum(mw) FROM rules WHERE mw > 0))) AS agg FROM summ),
scored AS (SELECT *,
  CASE WHEN nh > 0 THEN 'MUST_NOT_MERGE' WHEN (hm IS NOT NULL OR sure) AND ratio >= {p.hard_link_tier2_ratio} THEN 'MUST_MERGE' WHEN hm IS NOT NULL OR sure THEN 'REVIEW_REQUIRED' WHEN agg >= {p.merge_threshold} THEN 'MERGE' ELSE 'NO_MERGE' END AS decision,
  CASE WHEN nh > 0 THEN 0.0 WHEN hm IS NOT NULL OR sure THEN CASE WHEN ratio >= {p.hard_link_tier1_ratio} THEN 1.0 WHEN ratio >= {p.hard_link_tier2_ratio} THEN 0.85 ELSE 0.5 END ELSE agg END AS score,
  CASE WHEN nh > 0 THEN NULL WHEN hm IS NOT NULL OR sure THEN CASE WHEN ratio >= {p.hard_link_tier1_ratio} THEN 'HIGH' WHEN ratio >= {p.hard_link_tier2_ratio} THEN 'MEDIUM' ELSE 'LOW' END END AS tier
  FROM scr)"""


def scored(profile: str = "default") -> str:
    return f"""{SUMS}, universe AS (SELECT a, b FROM matches UNION SELECT a, b FROM diffs UNION SELECT a, b FROM relp), {decided(profile, 'universe')}"""


def entities(profile: str = "default") -> str:
    """CTEs up to ``ent`` (party, entity)."""
    return f"""{scored(profile)},
e AS (SELECT a, b FROM scored WHERE decision IN ('MUST_MERGE', 'MERGE') UNION ALL SELECT b, a FROM scored WHERE decision IN ('MUST_MERGE', 'MERGE')),
reach(p, q) AS (SELECT DISTINCT party, party FROM attrs UNION SELECT r.p, e.b FROM reach r JOIN e ON e.a = r.q),
comp AS (SELECT p AS party, min(q) AS root FROM reach GROUP BY p),
ent AS (SELECT party, root, printf('ENTITY_%04d', CAST(dense_rank() OVER (ORDER BY root) AS INTEGER)) AS entity FROM comp)"""


def links(profile: str = "default") -> str:
    """CTEs up to ``lnk``: one row per party with its entity link."""
    base = entities(profile)
    # the pairs inside entities are scored again over the same sums
    inner = decided(profile, "epairs").replace("summ AS", "summ2 AS").replace("FROM summ)", "FROM summ2)").replace("scr AS", "scr2 AS").replace("FROM scr)", "FROM scr2)").replace("scored AS", "scored2 AS")
    return f"""{base},
epairs AS (SELECT x.entity, x.party AS a, y.party AS b FROM ent x JOIN ent y ON x.entity = y.entity AND x.party < y.party),
{inner},
both_ways AS (SELECT entity, a AS party, decision, score, tier, nm, nd, nh FROM scored2 UNION ALL SELECT entity, b, decision, score, tier, nm, nd, nh FROM scored2),
pp AS (SELECT entity, party, bool_or(decision = 'MUST_MERGE') AS mu, bool_or(decision = 'REVIEW_REQUIRED') AS re, bool_or(decision = 'MERGE') AS me, min(CASE tier WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 END) AS t, avg(score) AS av, max(score) AS be, sum(nm) AS m, sum(nd) AS d, sum(nh) AS h FROM both_ways GROUP BY 1, 2),
lnk AS (SELECT ent.party, ent.entity,
  CASE WHEN av IS NULL THEN 'SINGLETON' WHEN mu THEN 'HARD_LINK' WHEN re THEN 'HARD_LINK_LOW_CONFIDENCE' WHEN me THEN 'SCORED' ELSE 'MATCH_EVIDENCE' END AS link_type,
  CASE WHEN av IS NULL THEN 'SINGLETON' WHEN mu THEN 'MUST_MERGE' WHEN re THEN 'REVIEW_REQUIRED' WHEN me THEN 'MERGE' ELSE 'UNKNOWN' END AS link_decision,
  CASE WHEN av IS NULL THEN 1.0 ELSE be END AS confidence, CASE t WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' END AS tier,
  av, coalesce(m, 0) AS m, coalesce(d, 0) AS d, coalesce(h, 0) AS h
  FROM ent LEFT JOIN pp ON pp.entity = ent.entity AND pp.party = ent.party)"""


def master(profile: str = "default") -> str:
    """CTEs up to ``mst``: one row per entity with its analytics."""
    return f"""{links(profile)},
sz AS (SELECT entity, count(*) AS n FROM ent GROUP BY entity),
agree AS (SELECT entity, count(*) FILTER (WHERE v = 1) AS f, count(*) FILTER (WHERE v > 1) AS c, count(*) AS u, sum(i) AS i FROM (SELECT entity, subtype, count(DISTINCT value) AS v, count(*) AS i FROM attrs JOIN ent USING (party) GROUP BY 1, 2) GROUP BY entity),
px AS MATERIALIZED (SELECT p.entity, p.a, p.b, x.subtype, x.value FROM epairs p JOIN attrs x ON x.party = p.a),
ps AS (SELECT p.entity, p.a, p.b, avg(CASE WHEN p.value = y.value THEN 1.0 ELSE 0.0 END) AS s FROM px p JOIN attrs y ON y.party = p.b AND p.subtype = y.subtype GROUP BY 1, 2, 3),
pss AS (SELECT entity, avg(s) AS av, min(s) AS mi, max(s) AS ma FROM ps GROUP BY entity),
ev AS (SELECT entity, sum(nm) AS m, sum(nd) AS d, avg(CASE WHEN nm + nd > 0 THEN nm / (nm + nd) END) AS r FROM scored2 GROUP BY entity),
mst AS (SELECT sz.entity, n, n * (n - 1) // 2 AS total_pairs, u, i, CASE WHEN n > 1 THEN f ELSE 0 END AS f, CASE WHEN n > 1 THEN c ELSE 0 END AS c, coalesce(pss.av, 0.0) AS av, coalesce(mi, 1.0) AS mi, coalesce(ma, 0.0) AS ma, coalesce(ev.m, 0) AS m, coalesce(ev.d, 0) AS d, CASE WHEN coalesce(ev.m + ev.d, 0) > 0 THEN ev.m / (ev.m + ev.d) ELSE 0.0 END AS er, coalesce(ev.r, 0.0) AS ar
  FROM sz LEFT JOIN agree USING (entity) LEFT JOIN pss USING (entity) LEFT JOIN ev USING (entity))"""


NAMES = """nm2 AS (SELECT entity, arg_min(concat(f.value, ' ', l.value), ent.party) AS primary_name FROM ent JOIN attrs f ON f.party = ent.party AND f.subtype = 'ATTR_FIRST_NAME' JOIN attrs l ON l.party = ent.party AND l.subtype = 'ATTR_LAST_NAME' GROUP BY entity)"""

#: Pairs inside entities that a rule of the conflict stage blocks.
CONFLICTS = f"""brules(rid, rname, subtype, prio) AS (VALUES {_BLOCKING}),
full_names AS MATERIALIZED (SELECT party, max(value) FILTER (WHERE subtype = 'ATTR_FIRST_NAME') AS f, max(value) FILTER (WHERE subtype = 'ATTR_LAST_NAME') AS l FROM attrs GROUP BY party),
cx AS MATERIALIZED (SELECT q.a, q.b, c.subtype, c.value FROM epairs q JOIN attrs c ON c.party = q.a),
bcand AS (SELECT p.entity, p.a, p.b, r.rid, r.rname, r.subtype, x.value AS va, y.value AS vb, row_number() OVER (PARTITION BY p.a, p.b ORDER BY r.prio DESC, r.rid) AS rn
  FROM cx x JOIN attrs y ON y.party = x.b AND y.subtype = x.subtype JOIN epairs p ON p.a = x.a AND p.b = x.b JOIN brules r ON x.subtype = replace(r.subtype, 'SUB_GENDER', 'ATTR_GENDER')
  JOIN full_names na ON na.party = p.a JOIN full_names nb ON nb.party = p.b
  WHERE x.value <> y.value AND (r.subtype <> 'SUB_GENDER' OR (na.f = nb.f AND na.l = nb.l))),
conf AS (SELECT * FROM bcand WHERE rn = 1)"""


def with_(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"


_STEPS = re.compile(r"\b(attrs|pairs|cmp|matches|diffs|rel|relp|ms|dsum|scored|e|comp|ent|epairs|scored2|lnk|pss|conf) AS \(")


def stepwise(sql: str) -> str:
    """The SQL with its large steps computed once each, so that no plan multiplies them."""
    return _STEPS.sub(r"\1 AS MATERIALIZED (", sql)

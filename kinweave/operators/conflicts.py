"""Conflicts inside entities, and splitting entities that hold one (optional stage)."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import values
from kinweave.functions.conditions import present
from kinweave.operators.entities import inside, numbered_entities
from kinweave.operators.joins import dealt_pairs
from kinweave.operators.metadata import control_rows
from kinweave.operators.patterns import wide

# Blocking rules name subtypes that unclassified attributes carry as types.
ALIASES = {"SUB_GENDER": "ATTR_GENDER", "SUB_DOB": "ATTR_DOB", "SUB_FIRST_NAME": "ATTR_FIRST_NAME", "SUB_LAST_NAME": "ATTR_LAST_NAME"}


_VERDICT = "struct<blocking_rule_id:string,reason_code:string,conflicting_attribute_subtype_id:string,conflict_details:string>"


class _Blocks:
    """The active DIFFERENT_VALUES rules, highest first, and the attributes that they and names read."""

    def __init__(self, rules: DataFrame, alias: bool):
        active = [r for r in control_rows(rules) if r["is_active"] and r["blocking_logic"] == "DIFFERENT_VALUES"]
        self.rules = sorted(active, key=lambda r: (r["priority"] is None, -(r["priority"] or 0), r["blocking_rule_id"]))
        self.seen = lambda s: ALIASES.get(s, s) if alias else s
        self.names = [self.seen("SUB_FIRST_NAME"), self.seen("SUB_LAST_NAME")]
        self.subtypes = list(dict.fromkeys([*self.names, *[self.seen(r["attribute_subtype_id"]) for r in self.rules]]))

    def wide(self, attributes: DataFrame) -> DataFrame:
        return wide(attributes.filter(present(F.col("value"))), self.subtypes)

    def verdict(self) -> Column:
        """The first rule that blocks a pair with the columns of ``wide`` on both sides, or null."""
        value = lambda s, side: F.col(f"v{self.subtypes.index(s)}_{side}")
        named = F.concat_ws(" ", *[value(n, 1) for n in self.names])
        namesakes = F.lit(True)
        for n in self.names:
            namesakes = namesakes & (value(n, 1) == value(n, 2))
        cases = []
        for r in self.rules:
            own = r["attribute_subtype_id"]
            x, y = value(self.seen(own), 1), value(self.seen(own), 2)
            if own == "SUB_GENDER":
                hit, code, details = (x != y) & namesakes, F.lit("GENDER_CONFLICT"), F.to_json(F.struct(x.alias("party1_gender"), y.alias("party2_gender"), named.alias("shared_name")))
            else:
                hit, code, details = x != y, values.reason_code(F.lit(r["rule_name"])), F.to_json(F.create_map(F.lit(f"party1_{own}"), x, F.lit(f"party2_{own}"), y))
            cases.append(F.when(hit, F.struct(F.lit(r["blocking_rule_id"]), code, F.lit(own), details).cast(_VERDICT)))
        return F.coalesce(*cases, F.lit(None).cast(_VERDICT))


def blocked_pairs(pairs: DataFrame, attributes: DataFrame, rules: DataFrame, alias: bool = True) -> DataFrame:
    """Pairs that an active DIFFERENT_VALUES rule blocks, by its highest rule.

    Gender differences block only parties with equal first and last names.
    ``alias`` lets rules on SUB_ names see the attribute types of ``ALIASES``.
    """
    blocks = _Blocks(rules, alias)
    given = blocks.wide(attributes)
    side = lambda n: given.select(*[F.col(c).alias(f"{c}_{n}") for c in given.columns])
    both = pairs.select("party_id_1", "party_id_2").join(side(1), "party_id_1").join(side(2), "party_id_2")
    return both.select("party_id_1", "party_id_2", blocks.verdict().alias("_b")).filter("_b is not null").select("party_id_1", "party_id_2", "_b.*")


def entity_conflicts(entities: DataFrame, attributes: DataFrame, rules: DataFrame, match_blocking: DataFrame, alias: bool = True) -> DataFrame:
    """Conflicting pairs of each entity: DIRECT where an active block is known, else TRANSITIVE.

    Members take their values into the join that pairs them, so only pairs that
    conflict leave it.
    """
    key = "master_entity_id"
    a, b = values.pair(F.col("party_id_1"), F.col("party_id_2"))
    known = match_blocking.filter("is_active").groupBy(a.alias("party_id_1"), b.alias("party_id_2")).agg(F.min(F.struct("blocking_id", "blocking_rule_id", "blocking_reason_code", "conflicting_attribute_subtype_id", "conflict_details")).alias("k"))
    direct = inside(known, entities).filter("party_id_1 < party_id_2").select(key, "party_id_1", "party_id_2", F.lit("DIRECT").alias("conflict_type"), F.col("k.blocking_rule_id").alias("blocking_rule_id"), F.col("k.blocking_reason_code").alias("reason_code"), F.col("k.conflicting_attribute_subtype_id").alias("conflicting_attribute_subtype_id"), F.col("k.conflict_details").alias("conflict_details"))
    blocks = _Blocks(rules, alias)
    members = entities.select("party_id", key).join(blocks.wide(attributes), "party_id")
    side = lambda n: {c: f"{c}_{n}" for c in members.columns if c != key}
    pairs = dealt_pairs(members, [key], side(1), side(2), spread=True).filter("party_id_1 < party_id_2")
    found = pairs.select(key, "party_id_1", "party_id_2", blocks.verdict().alias("_b")).filter("_b is not null").join(known.select("party_id_1", "party_id_2"), ["party_id_1", "party_id_2"], "left_anti")
    return direct.unionByName(found.select(key, "party_id_1", "party_id_2", F.lit("TRANSITIVE").alias("conflict_type"), "_b.*"))


def conflict_counts(entities: DataFrame, attributes: DataFrame, rules: DataFrame, alias: bool = True) -> DataFrame:
    """(master_entity_id, conflict_count): how many pairs ``entity_conflicts`` finds where no block is known yet.

    Members with the same values that rules read are one row with a count.
    """
    key = "master_entity_id"
    blocks = _Blocks(rules, alias)
    given = blocks.wide(attributes)
    read = [c for c in given.columns if c != "party_id"]
    kinds = entities.select("party_id", key).join(given, "party_id").groupBy(key, *read).agg(F.count("*").alias("n"), F.min("party_id").alias("party_id"))
    side = lambda n: {c: f"{c}_{n}" for c in kinds.columns if c != key}
    pairs = dealt_pairs(kinds, [key], side(1), side(2), by=["party_id"], spread=True).filter("party_id_1 < party_id_2")
    return pairs.filter(blocks.verdict().isNotNull()).groupBy(key).agg(F.sum(F.col("n_1") * F.col("n_2")).alias("conflict_count"))


def new_blocks(conflicts: DataFrame, at: Column) -> DataFrame:
    """MATCH_BLOCKING rows for the transitive conflicts."""
    return conflicts.filter("conflict_type = 'TRANSITIVE'").select(
        values.stable_id(F.lit("block"), F.col("party_id_1"), F.col("party_id_2")).alias("blocking_id"),
        "party_id_1",
        "party_id_2",
        F.lit("TRANSITIVE_CONFLICT").alias("blocking_reason_code"),
        "blocking_rule_id",
        F.lit("AUTOMATIC_TRANSITIVE").alias("blocking_source"),
        "conflicting_attribute_subtype_id",
        "conflict_details",
        at.alias("created_at"),
        F.lit(True).alias("is_active"),
        F.lit("system").alias("created_by"),
    )


def shortest_path(links: dict[str, dict[str, float]], a: str, b: str) -> list[str]:
    """A shortest path between two nodes, neighbours in name order; empty if there is none."""
    before: dict[str, str | None] = {a: None}
    queue = deque([a])
    while queue and b not in before:
        here = queue.popleft()
        for there in sorted(links.get(here, {})):
            if there not in before:
                before[there] = here
                queue.append(there)
    if b not in before:
        return []
    path, at = [], b
    while at is not None:
        path.append(at)
        at = before[at]
    return path[::-1]


def split_one(parties: list[str], edges: list[tuple[str, str, float]], conflicts: list[tuple[str, str]]) -> dict[str, str]:
    """Party to part after removing, for each conflict in order, its own edge or
    the lightest edge on a shortest path between its ends; a part is named by
    its smallest party."""
    links: dict[str, dict[str, float]] = {p: {} for p in parties}
    for a, b, w in edges:
        links[a][b] = links[b][a] = w
    for a, b in conflicts:
        path = [a, b] if b in links.get(a, {}) else shortest_path(links, a, b)
        steps = list(zip(path, path[1:], strict=False))
        if steps:
            x, y = min(steps, key=lambda s: links[s[0]][s[1]])
            del links[x][y], links[y][x]
    part: dict[str, str] = {}
    for p in sorted(parties):
        stack = [p] if p not in part else []
        while stack:
            here = stack.pop()
            if here not in part:
                part[here] = p
                stack += links[here]
    return part


def split_entities(entities: DataFrame, edges: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(party_id, master_entity_id) after splitting the entities with conflicts.

    Only those entities go through Python, one at a time; they are small, as
    their pairs were all compared.  The result is numbered anew.
    """
    hit = conflicts.select("master_entity_id").distinct()
    whole = entities.join(hit, "master_entity_id", "left_anti").withColumn("component", F.min("party_id").over(Window.partitionBy("master_entity_id"))).select("party_id", "component")
    sick = entities.join(hit, "master_entity_id", "left_semi")
    own = entities.select(F.col("party_id").alias("party_id_1"), "master_entity_id")
    rows = sick.select("master_entity_id", F.lit("party").alias("kind"), F.col("party_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w"))
    rows = rows.unionByName(edges.join(own, "party_id_1").join(hit, "master_entity_id", "left_semi").select("master_entity_id", F.lit("edge").alias("kind"), F.col("party_id_1").alias("a"), F.col("party_id_2").alias("b"), F.col("weight").alias("w")))
    rows = rows.unionByName(conflicts.select("master_entity_id", F.lit("conflict").alias("kind"), F.col("party_id_1").alias("a"), F.col("party_id_2").alias("b"), F.lit(0.0).alias("w")))

    def split(group: pd.DataFrame) -> pd.DataFrame:
        of = lambda kind: group[group["kind"] == kind].sort_values(["a", "b"])
        part = split_one(of("party")["a"].tolist(), list(of("edge")[["a", "b", "w"]].itertuples(index=False, name=None)), list(of("conflict")[["a", "b"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"party_id": list(part), "component": list(part.values())})

    parts = rows.groupBy("master_entity_id").applyInPandas(split, "party_id string, component string")
    return numbered_entities(whole.unionByName(parts))

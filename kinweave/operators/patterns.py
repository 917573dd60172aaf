"""Evidence of pairs, judged in the row where a pair is found.

Every party takes its values along into the self-join that finds its pairs, so
a pair needs no join, window or grouping of its own afterwards: what matches
and what differs is a bit per rule, and all that evidence and scores say about
a pair follows from these bits.  Pairs, and rows of evidence, are many times
the parties; here only parties are shuffled, and no pair is written.

Parties with the same values are of one kind, and all pairs between two kinds
say the same.  ``bundled_pairs`` judges a pair of bundles, of parties of a kind
each, once before it is expanded; ``kind_pairs`` only counts what it stands
for, which is all that sums need.

A party has one current cluster and one value per attribute at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import values
from kinweave.functions.conditions import present
from kinweave.operators.evidence import PHASE_1, STRONG_KEYS
from kinweave.operators.joins import MOST_PARTS, dealt_pairs, hot_keys
from kinweave.operators.metadata import control_rows
from kinweave.sources.tables import current

#: Bits for what is equal, and as many above them for what differs.
MOST_RULES = 31
ENDS = ["party_id_1", "party_id_2"]


@dataclass(frozen=True)
class Weight:
    """An active rule: its attribute, its bit, and what a match or difference counts."""

    subtype: str
    bit: int
    match: float
    difference: float
    hard_link: bool
    hard_block: bool
    priority: int | None
    scored: float

    @property
    def confidence(self) -> float:
        return 1.0 if self.hard_link else 0.95


@dataclass(frozen=True)
class Judge:
    """The active evidence rules and the strong keys."""

    weights: list[Weight]
    keys: list[tuple[str, str]]

    @classmethod
    def of(cls, rules: DataFrame, keys: list[tuple[str, str]] = STRONG_KEYS) -> Judge:
        rows = control_rows(rules)
        active = [r for r in rows if r["is_active"]]
        names = [r["attribute_subtype_id"] for r in active]
        if len(set(names)) < len(names) or len(names) > MOST_RULES:
            raise ValueError(f"an attribute has one active evidence rule, of {MOST_RULES} at most")
        known = {n: [r["match_weight"] for r in rows if r["attribute_subtype_id"] == n and r["match_weight"] is not None] for n in names}
        return cls([Weight(r["attribute_subtype_id"], 1 << i, r["match_weight"] or 0.0, r["difference_weight"] or 0.0, r["hard_link_threshold"] == 1.0, r["hard_block_threshold"] == 1.0, r["priority"], max(known[r["attribute_subtype_id"]], default=0.0)) for i, r in enumerate(active)], keys)

    def table(self, chosen, points) -> Column:
        """The chosen weights as a constant: bit, at (place among the values), subtype and points."""
        return F.array(*[F.struct(F.lit(w.bit).cast("long").alias("bit"), F.lit(i).alias("at"), F.lit(w.subtype).alias("subtype"), F.lit(float(points(w))).alias("points")) for i, w in enumerate(self.weights) if chosen(w)])

    def mask(self, chosen) -> Column:
        return F.lit(sum(w.bit for w in self.weights if chosen(w))).cast("long")


def _total(table: Column, bits: Column) -> Column:
    return F.aggregate(table, F.lit(0.0), lambda sum_, w: sum_ + F.when(w["bit"].bitwiseAND(bits) != 0, w["points"]).otherwise(0.0))


def _set(table: Column, bits: Column) -> Column:
    return F.explode(F.filter(table, lambda w: w["bit"].bitwiseAND(bits) != 0))


def _has(bits: Column, w: Weight) -> Column:
    return bits.bitwiseAND(F.lit(w.bit).cast("long")) != 0


def _first(bits: Column, ordered: list[Weight], what) -> Column:
    return F.coalesce(*[F.when(_has(bits, w), what(w)) for w in ordered], F.lit(None))


def wide(attributes: DataFrame, subtypes: Sequence[str]) -> DataFrame:
    """One row per party with attributes: party_id, and the value of each subtype as v0, v1, ..."""
    return attributes.groupBy("party_id").agg(*[F.max(F.when(F.col("subtype") == s, F.col("value"))).alias(f"v{i}") for i, s in enumerate(subtypes)])


def placed(attributes: DataFrame, clusters: DataFrame, judge: Judge) -> DataFrame:
    """One row per party with attributes or a cluster: vals (by rule, where present), strong (by key), given, cluster_id."""
    now = current(clusters).select("party_id", "cluster_id")
    subtypes = list(dict.fromkeys([w.subtype for w in judge.weights] + [s for s, _ in judge.keys]))
    value = lambda s: F.col(f"v{subtypes.index(s)}")
    vals = F.array(*[F.when(present(value(w.subtype)), value(w.subtype)) for w in judge.weights])
    strong = F.array(*[value(s) for s, _ in judge.keys])
    return wide(attributes, subtypes).select("party_id", vals.alias("vals"), strong.alias("strong"), F.lit(True).alias("given")).join(now, "party_id", "full")


def _same(i: int) -> Column:
    return F.coalesce(F.col("strong_1")[i] == F.col("strong_2")[i], F.lit(False))


def related(parties: DataFrame, pairs: DataFrame, judge: Judge) -> DataFrame:
    """The relationship ``pairs`` whose parties have attributes, and whether they are compared (``met``).

    ``strong`` says whether they share a strong value.
    """
    shown = parties.filter("given").drop("given")
    side = lambda n: shown.select(*[F.col(c).alias(f"{c}_{n}") for c in shown.columns])
    both = pairs.filter("party_id_1 < party_id_2").join(side(1), "party_id_1").join(side(2), "party_id_2")
    strong = reduce(lambda a, b: a | b, [_same(i) for i in range(len(judge.keys))], F.lit(False))
    near = F.col("cluster_id_1").eqNullSafe(F.col("cluster_id_2"))
    met = F.when(near, F.col("cluster_id_1").isNotNull()).otherwise(strong)
    return both.select(*pairs.columns, met.alias("met"), strong.alias("strong"))


def with_related(parties: DataFrame, known: DataFrame) -> DataFrame:
    """Parties with what ``related`` knows of their later parties, for the pairs that are compared.

    ``apart_0`` and ``apart_1`` mark the parties that have a relationship with
    one that shares a strong value with them, and with another one: among the
    pairs of that sort they are of a kind of their own.
    """
    fact = F.struct("relationship_score", "guaranteed", "guaranteed_by")
    ends = known.select(F.explode(F.array("party_id_1", "party_id_2")).alias("party_id"), "strong", F.lit(None).cast("string").alias("other"), F.lit(None).alias("fact"))
    told = known.filter("met").select(F.col("party_id_1").alias("party_id"), F.lit(None).cast("boolean").alias("strong"), F.col("party_id_2").alias("other"), fact.alias("fact"))
    listed = F.collect_list(F.when(F.col("other").isNotNull(), F.struct("other", "fact")))
    facts = ends.unionByName(told).groupBy("party_id").agg(F.map_from_entries(listed).alias("related"), F.max("strong").alias("apart_0"), F.max(~F.col("strong")).alias("apart_1"))
    rows = parties.join(facts, "party_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("apart_0", "apart_1")})


def pairs_of(parties: DataFrame, judge: Judge, within: Sequence[str] = (), phases: Sequence[int] | None = None) -> DataFrame:
    """The pairs to compare, each once, by the first key that finds it.

    Pairs of one cluster come from phase -1, others from the first strong key
    that they share; ``phases`` leaves others out.  ``within`` names columns
    that both parties have to share.  Adds blocking_keys, ``matched`` and
    ``differed`` (bits of the rules; of a pair with a hard conflict only the
    conflict that is shown) and ``blocked``; other columns get _1 and _2.
    """
    numbered = [(-1, F.col("cluster_id"))] + [(i, F.col("strong")[i]) for i in range(len(judge.keys))]
    found = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), x.alias("shared")) for i, x in numbered if phases is None or i in phases]))
    rows = parties.withColumn("_key", found).filter("_key.shared is not null").withColumns({"_k": F.col("_key.k"), "_shared": F.col("_key.shared")}).drop("_key")
    carried = [c for c in parties.columns if c not in within]
    pairs = dealt_pairs(rows, ["_k", "_shared", *within], {c: f"{c}_1" for c in carried}, {c: f"{c}_2" for c in carried}, by=["party_id"], spread=True)
    near = F.col("cluster_id_1").eqNullSafe(F.col("cluster_id_2"))
    earlier = [(F.col("_k") > i) & _same(i) for i in range(len(judge.keys))]
    pairs = pairs.filter(F.col("party_id_1") < F.col("party_id_2")).filter((F.col("_k") == -1) | ~reduce(lambda a, b: a | b, earlier, near))
    return _judged(pairs, judge).drop("_k", "_shared")


def _judged(pairs: DataFrame, judge: Judge) -> DataFrame:
    """Adds blocking_keys, ``matched``, ``differed`` and ``blocked`` to pairs of ``vals`` found by key ``_k``."""
    label = F.coalesce(*[F.when(F.col("_k") == i, n) for i, (_, n) in enumerate(judge.keys)], F.lit(PHASE_1))
    zero, one, two = F.lit(0).cast("long"), F.col("vals_1"), F.col("vals_2")
    states = [F.when(one[i] == two[i], F.lit(w.bit)).when(one[i] != two[i], F.lit(w.bit << MOST_RULES)).otherwise(0).cast("long") for i, w in enumerate(judge.weights)]
    # Exploding the one sum keeps it from being computed again wherever it is read.
    bits = F.explode(F.array(F.aggregate(F.array(*states), zero, lambda a, b: a + b)))
    judged = pairs.withColumn("blocking_keys", label).withColumn("_bits", bits).withColumns({"_equal": F.col("_bits").bitwiseAND((1 << MOST_RULES) - 1), "_differ": F.shiftright("_bits", MOST_RULES)}).withColumn("blocked", F.col("_differ").bitwiseAND(judge.mask(lambda w: w.hard_block)) != 0)
    ordered = sorted((w for w in judge.weights if w.hard_block), key=lambda w: (w.priority is None, -(w.priority or 0), w.subtype))
    shown = _first(F.col("_differ"), ordered, lambda w: F.lit(w.bit).cast("long"))
    matched = F.when(F.col("blocked"), zero).otherwise(F.col("_equal").bitwiseAND(judge.mask(lambda w: w.match > 0)))
    differed = F.when(F.col("blocked"), shown).otherwise(F.col("_differ").bitwiseAND(judge.mask(lambda w: w.difference > 0)))
    return judged.withColumns({"matched": matched, "differed": differed}).drop("_bits", "_equal", "_differ")


def _by_sort(parties: DataFrame, within: Sequence[str]) -> DataFrame:
    """Each party once for the pairs that share a strong value (``near`` false) and once for those that share only a cluster.

    Adds ``kind``, of the parties that are the same in all that pairs of this
    sort and ``within`` compare; parties ``apart`` are of their own.
    """
    apart = [F.col(f"apart_{i}") if f"apart_{i}" in parties.columns else F.lit(False) for i in (0, 1)]
    none = F.lit(None).cast("string")
    sorts = F.array(F.struct(F.lit(False).alias("near"), none.alias("cluster"), F.when(apart[0], F.col("party_id")).alias("alone")), F.struct(F.lit(True).alias("near"), F.col("cluster_id").alias("cluster"), F.when(apart[1], F.col("party_id")).alias("alone")))
    rows = parties.withColumn("_s", F.explode(sorts)).select("*", "_s.near", "_s.cluster", "_s.alone").drop("_s")
    return rows.withColumn("kind", F.md5(F.to_json(F.struct("near", "cluster", "alone", "vals", "strong", *within))))


def kinds(parties: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """One row per kind of ``parties``: kind, near, cluster, vals, strong, n parties, the smallest as party_id."""
    rows = _by_sort(parties, within)
    told = [F.first(F.when(F.col("alone").isNotNull(), F.col("related"))).alias("related")] if "related" in parties.columns else []
    one = [F.first(c).alias(c) for c in ("near", "cluster", "vals", "strong", *within)]
    return rows.groupBy("kind").agg(*one, *told, F.count("*").alias("n"), F.min("party_id").alias("party_id"))


def kind_pairs(parties: DataFrame, judge: Judge, within: Sequence[str] = ()) -> DataFrame:
    """The pairs of ``pairs_of``, one row for all pairs of two kinds or inside one.

    A pair that shares a strong value is found by that, others by the cluster.
    ``peers_1`` and ``peers_2`` say with how many parties of the other kind a
    party of either is paired, ``pairs`` with how many pairs in all; party_id_1
    and party_id_2 are the smallest parties of the kinds, the same inside one.
    """
    rows = kinds(parties, within)
    found = F.explode(F.when(F.col("near"), F.array(F.struct(F.lit(-1).alias("k"), F.col("cluster").alias("shared")))).otherwise(F.array(*[F.struct(F.lit(i).alias("k"), F.col("strong")[i].alias("shared")) for i in range(len(judge.keys))])))
    rows = rows.withColumn("_key", found).filter("_key.shared is not null").withColumns({"_k": F.col("_key.k"), "_shared": F.col("_key.shared")})
    carried = [c for c in ("party_id", "vals", "strong", "n", "related") if c in rows.columns]
    pairs = dealt_pairs(rows.select("_k", "_shared", "near", *within, *carried), ["_k", "_shared", "near", *within], {c: f"{c}_1" for c in carried}, {c: f"{c}_2" for c in carried}, by=["party_id"], spread=True)
    same = F.col("party_id_1") == F.col("party_id_2")
    seen = [(F.col("near") | (F.col("_k") > i)) & _same(i) for i in range(len(judge.keys))]
    pairs = pairs.filter((F.col("party_id_1") < F.col("party_id_2")) | same & (F.col("n_1") > 1)).filter(~reduce(lambda a, b: a | b, seen, F.lit(False)))
    one = F.when(same, 1).otherwise(0)
    every = F.when(same, (F.col("n_1") * (F.col("n_1") - 1) / 2).cast("long")).otherwise(F.col("n_1") * F.col("n_2"))
    pairs = pairs.withColumns({"peers_1": F.col("n_2") - one, "peers_2": F.col("n_1") - one, "pairs": every})
    return _judged(pairs, judge).drop("_k", "_shared", "blocking_keys", "n_1", "n_2")


def per_kind_party(pairs: DataFrame, within: Sequence[str], *told: str) -> DataFrame:
    """Each of ``kind_pairs`` from both of its kinds: within, near, party_id, ``told`` and ``times``, the pairs a party of the kind has."""
    same = F.col("party_id_1") == F.col("party_id_2")
    sides = F.array(F.struct(F.col("party_id_1").alias("party_id"), F.col("peers_1").alias("times")), F.struct(F.col("party_id_2").alias("party_id"), F.col("peers_2").alias("times")))
    side = F.explode(F.when(same, F.slice(sides, 1, 1)).otherwise(sides))
    return pairs.select(*within, "near", *told, side.alias("_p")).select(*within, "near", *told, "_p.party_id", "_p.times")


def to_parties(parties: DataFrame, sums: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``sums`` (within, near, party_id and more, of the smallest party of each kind) for every party: party_id, within and more; two rows a party at most."""
    rows = _by_sort(parties, within).select("party_id", "kind", *within)
    named = kinds(parties, within).select("kind", "near", "party_id", *within).join(sums, ["near", "party_id", *within])
    return rows.join(named.drop("party_id", "near", *within), "kind").drop("kind")


#: Parties of a kind that a bundle holds, about.
BUNDLE = 256


def bundles(parties: DataFrame, judge: Judge) -> DataFrame:
    """``parties`` by the keys that find their pairs: ``_k``, ``_shared``, vals, strong and ``members`` (party_id, cluster_id).

    Parties of a kind that share a strong value stand in one row, or in several
    of about ``BUNDLE`` each; for the pairs of a cluster each stands alone.
    """
    told = [c for c in ("related",) if c in parties.columns]
    member = F.struct("party_id", "cluster_id")
    near = parties.filter("cluster_id is not null").select(F.lit(-1).alias("_k"), F.col("cluster_id").alias("_shared"), "party_id", "vals", "strong", *told, F.array(member).alias("members"))
    rows = _by_sort(parties, ()).filter("not near").filter(F.exists("strong", lambda v: v.isNotNull()))
    hot = F.broadcast(hot_keys(rows.groupBy("kind").agg(F.count("*").alias("n")), ["kind"], MOST_PARTS))
    dealt = rows.join(hot, "kind", "left").withColumn("_part", F.pmod(F.xxhash64("party_id"), F.coalesce("_parts", F.lit(1))))
    one = [F.first(c).alias(c) for c in ("vals", "strong")] + [F.first(F.when(F.col("alone").isNotNull(), F.col(c))).alias(c) for c in told]
    held = dealt.groupBy("kind", "_part").agg(F.min("party_id").alias("party_id"), *one, F.collect_list(member).alias("members"))
    found = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("strong")[i].alias("shared")) for i in range(len(judge.keys))]))
    keyed = held.withColumn("_key", found).filter("_key.shared is not null").select(F.col("_key.k").alias("_k"), F.col("_key.shared").alias("_shared"), "party_id", "vals", "strong", *told, "members")
    return near.unionByName(keyed)


def bundled_pairs(parties: DataFrame, judge: Judge) -> DataFrame:
    """The pairs of ``pairs_of`` with what it says of them, as pairs of bundles: members_1 and members_2, for ``expanded``.

    A pair of bundles stands for its pairs of members in their order; every two
    bundles come in both orders.
    """
    rows = bundles(parties, judge)
    carried = [c for c in rows.columns if not c.startswith("_")]
    pairs = dealt_pairs(rows, ["_k", "_shared"], {c: f"{c}_1" for c in carried}, {c: f"{c}_2" for c in carried}, by=["party_id"], spread=True)
    many = lambda i: F.size(f"members_{i}") > 1
    pairs = pairs.filter(many(1) | many(2) | (F.col("party_id_1") < F.col("party_id_2")))
    seen = [(F.col("_k") > i) & _same(i) for i in range(len(judge.keys))]
    return _judged(pairs.filter(~reduce(lambda a, b: a | b, seen, F.lit(False))), judge).drop("_shared")


def _shown(pairs: DataFrame) -> list[str]:
    return ["_k", "members_1", "members_2"] if "members_1" in pairs.columns else ENDS


def expanded(rows: DataFrame) -> DataFrame:
    """Rows of pairs of bundles as rows of pairs: party_id_1 and party_id_2 instead of the members."""
    if "members_1" not in rows.columns:
        return rows
    kept = [c for c in rows.columns if c not in _shown(rows)]
    rows = rows.withColumn("_a", F.explode("members_1")).drop("members_1").withColumn("_b", F.explode("members_2"))
    apart = (F.col("_k") == -1) | ~F.col("_a.cluster_id").eqNullSafe(F.col("_b.cluster_id"))
    return rows.filter((F.col("_a.party_id") < F.col("_b.party_id")) & apart).select(F.col("_a.party_id").alias("party_id_1"), F.col("_b.party_id").alias("party_id_2"), *kept)


def match_rows(pairs: DataFrame, judge: Judge, at: Column) -> DataFrame:
    """MATCH_EVIDENCE of the pairs, as ``evidence.match_rows`` gives it."""
    table = judge.table(lambda w: w.match > 0, lambda w: w.confidence)
    ends = _shown(pairs)
    rows = pairs.filter("matched <> 0").select(*ends, "blocking_keys", "vals_1", _set(table, F.col("matched")).alias("w")).select(*ends, "blocking_keys", F.col("w.subtype").alias("subtype"), F.col("vals_1")[F.col("w.at")].alias("value"), F.col("w.points").alias("confidence"))
    return expanded(rows).select(
        values.stable_id(F.lit("match"), *[F.col(e) for e in ENDS], F.col("subtype")).alias("evidence_id"),
        *ENDS,
        F.lit("EXACT_MATCH").alias("match_type"),
        values.rule_id(F.col("subtype")).alias("match_rule_id"),
        F.col("subtype").alias("match_key"),
        F.col("value").alias("evidence_value"),
        F.col("confidence").alias("confidence_score"),
        at.alias("created_at"),
        "blocking_keys",
    )


def difference_rows(pairs: DataFrame, judge: Judge, at: Column) -> DataFrame:
    """DIFFERENCE_EVIDENCE of the pairs, as ``evidence.difference_rows`` gives it."""
    blocked = F.col("blocked")
    table = judge.table(lambda w: w.difference > 0 or w.hard_block, lambda w: w.difference)
    ends = _shown(pairs)
    rows = pairs.filter("differed <> 0").select(*ends, "blocked", "vals_1", "vals_2", _set(table, F.col("differed")).alias("w"))
    rows = rows.select(*ends, "blocked", F.col("w.subtype").alias("subtype"), F.col("vals_1")[F.col("w.at")].alias("value_1"), F.col("vals_2")[F.col("w.at")].alias("value_2"), F.when(blocked, 1.0).otherwise(F.col("w.points")).alias("severity"))
    return expanded(rows).select(
        values.stable_id(F.lit("difference"), *[F.col(e) for e in ENDS], F.col("subtype")).alias("evidence_id"),
        *ENDS,
        F.col("subtype").alias("attribute_subtype_id"),
        "value_1",
        "value_2",
        F.col("severity").alias("severity_score"),
        blocked.alias("is_hard_block"),
        F.when(blocked, "HARD_CONFLICT").otherwise("SOFT_CONFLICT").alias("difference_type"),
        at.alias("created_at"),
    )


_SILENT = {"num_matches": "0L", "match_score": "0D", "hard_match": "CAST(NULL AS STRING)", "num_differences": "0L", "num_hard_blocks": "0L", "penalty": "0D", "hard_block": "CAST(NULL AS STRING)"}


def summary(pairs: DataFrame, judge: Judge, *kept: str) -> DataFrame:
    """What ``scoring.pair_summary`` says, for pairs with evidence or a relationship that are compared.

    ``pairs`` carry what ``with_related`` adds; ``kept`` are columns to keep.
    """
    matched, differed, blocked = F.col("matched"), F.col("differed"), F.col("blocked")
    by_name = sorted(judge.weights, key=lambda w: w.subtype)
    told = F.col("related_1")[F.col("party_id_2")]
    rows = pairs.withColumn("_told", told).filter((matched != 0) | (differed != 0) | F.col("_told").isNotNull())
    return rows.select(
        *kept,
        F.bit_count(matched).cast("long").alias("num_matches"),
        _total(judge.table(lambda w: True, lambda w: w.confidence * w.scored), matched).alias("match_score"),
        _first(matched, [w for w in by_name if w.hard_link], lambda w: F.lit(w.subtype)).cast("string").alias("hard_match"),
        F.bit_count(differed).cast("long").alias("num_differences"),
        F.when(blocked, 1).otherwise(0).cast("long").alias("num_hard_blocks"),
        F.when(blocked, 1.0).otherwise(_total(judge.table(lambda w: True, lambda w: w.difference), differed)).alias("penalty"),
        F.when(blocked, _first(differed, by_name, lambda w: F.lit(w.subtype))).cast("string").alias("hard_block"),
        F.coalesce("_told.relationship_score", F.lit(0.0)).alias("relationship_score"),
        F.coalesce("_told.guaranteed", F.lit(False)).alias("guaranteed"),
        F.col("_told.guaranteed_by").alias("guaranteed_by"),
    )


def unmet(known: DataFrame, *kept: str) -> DataFrame:
    """``summary`` of the pairs with a relationship that are not compared."""
    rows = known.filter("not met").withColumns({n: F.expr(x) for n, x in _SILENT.items()})
    return rows.select(*kept, "num_matches", "match_score", "hard_match", "num_differences", "num_hard_blocks", "penalty", "hard_block", "relationship_score", "guaranteed", "guaranteed_by")

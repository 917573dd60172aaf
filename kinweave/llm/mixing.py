"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources.  The operator works in three steps:

1. documents are aggregated by *membership pattern* (their sorted set of
   sources), so the flow network has one node per pattern, not per document;
2. a min-cost flow routes the token capacity of patterns to source quotas.
   The cost of a unit is convex in the repetition: the first use of a token is
   free, the second costs 1, the third 2, and so on up to ``max_repeats``;
3. each (pattern, source) flow is turned into documents by a seeded order:
   the first ``flow`` tokens of that order are taken.

Step 3 needs a running sum over all documents of a pattern.  One pattern may
hold a third of all rows, so the sum is taken over two levels: hash cells
inside a pattern are summed first, cell starts come from the small table of
cells, and only inside one cell are documents ordered.  Equal rows are one unit
with a count, so however many there are, they are never numbered one by one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.rows import packed, unpacked
from kinweave.storage import materialize

#: The words of a text, and weights that repeat over the sources.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHT_CYCLE = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
#: Rows of a hash cell, about.
CELL_ROWS = 64
#: Equal rows that are told apart by one task at a time.
CHUNK_ROWS = 4096
#: Membership patterns that the driver's network takes.
MAX_PATTERNS = 20_000
#: Tables of patterns or sources up to this many rows are broadcast.
BROADCAST_ROWS = 10_000


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


@dataclass(frozen=True)
class Quota:
    """What one source holds and what the mix should take from it."""

    source: str | None
    size: int
    target: float


def share_targets(sizes: list[tuple[str | None, int]], weights: list[float], total: float, cap: float) -> list[Quota]:
    """Share ``total`` by weight; a target stops at ``cap`` times its source's size.

    The excess of capped sources is shared again by weight among the others
    until no target is above its cap.  Sources without tokens get 0.
    """
    target = [0.0] * len(sizes)
    open_ = [i for i, (_, n) in enumerate(sizes) if n > 0]
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > cap * sizes[i][1]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = float(cap * sizes[i][1])
            left -= target[i]
        open_ = [i for i in open_ if i not in full]
    return [Quota(s, n, t) for (s, n), t in zip(sizes, target, strict=True)]


def min_cost_flow(supply: list[int], members: list[list[int]], demand: list[int], max_repeats: int) -> list[list[list[int]]]:
    """Tokens that pattern p gives to source s at repetition r, at least cost.

    Successive shortest augmenting paths with potentials (all costs are 0 or
    positive, so Dijkstra applies).  The network is source -> pattern (one arc
    per repetition, cost r) -> member source -> sink; its size depends on the
    number of patterns only.
    """
    n_p, n_s = len(supply), len(demand)
    start, sink, base = 0, 1 + n_p + n_s, 1 + n_p
    graph: list[list[list[int]]] = [[] for _ in range(sink + 1)]

    def arc(u: int, v: int, cap: int, cost: int) -> list[int]:
        fwd, back = [v, cap, cost, len(graph[v])], [u, 0, -cost, len(graph[u])]
        graph[u].append(fwd)
        graph[v].append(back)
        return back

    for p, tokens in enumerate(supply):
        for r in range(max_repeats):
            arc(start, 1 + p, tokens, r)
    sent = {(p, s): arc(1 + p, base + s, max_repeats * supply[p], 0) for p in range(n_p) for s in members[p]}
    for s, want in enumerate(demand):
        arc(base + s, sink, want, 0)
    potential = [0] * (sink + 1)
    while True:
        dist: list[float] = [float("inf")] * (sink + 1)
        via: list[tuple[int, int] | None] = [None] * (sink + 1)
        dist[start], heap = 0, [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for i, (v, cap, cost, _) in enumerate(graph[u]):
                nd = d + cost + potential[u] - potential[v]
                if cap > 0 and nd < dist[v]:
                    dist[v], via[v] = nd, (u, i)
                    heapq.heappush(heap, (nd, v))
        if via[sink] is None:
            break
        potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, dist, strict=True)]
        push, v = None, sink
        while via[v]:
            u, i = via[v]
            push = graph[u][i][1] if push is None else min(push, graph[u][i][1])
            v = u
        v = sink
        while via[v]:
            u, i = via[v]
            graph[u][i][1] -= push
            graph[v][graph[u][i][3]][1] += push
            v = u
    flow = [[[0] * max_repeats for _ in range(n_s)] for _ in range(n_p)]
    for p in range(n_p):
        room = [supply[p]] * max_repeats
        for s in members[p]:
            left = sent[p, s][1]
            for r in range(max_repeats):
                use = min(left, room[r])
                flow[p][s][r] += use
                room[r] -= use
                left -= use
    return flow


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _ordered_starts(units: DataFrame, seed: int) -> DataFrame:
    """Add ``before``: the tokens of a pattern that precede a unit.

    Units of a pattern are ordered by (cell, hash, doc_id, row key).  The
    number of ``cells`` grows with the pattern, so a cell stays small however
    large the pattern is.
    """
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("row_key"))
    units = units.withColumns({"weight": F.col("size") * F.col("rows"), "_order": order, "_cell": F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("row_key")), F.col("cells"))})
    per_cell = units.groupBy("pattern", "_cell").agg(F.sum("weight").alias("_tokens"))
    group = (F.col("_cell") / 1024).cast("long")
    per_group = per_cell.groupBy("pattern", group.alias("_group")).agg(F.sum("_tokens").alias("_group_tokens"))
    up_to = (Window.unboundedPreceding, -1)
    per_group = per_group.withColumn("_group_start", F.coalesce(F.sum("_group_tokens").over(Window.partitionBy("pattern").orderBy("_group").rowsBetween(*up_to)), F.lit(0)))
    per_cell = per_cell.withColumn("_group", group).join(per_group.drop("_group_tokens"), ["pattern", "_group"])
    inside = Window.partitionBy("pattern", "_group").orderBy("_cell").rowsBetween(*up_to)
    per_cell = per_cell.select("pattern", "_cell", (F.col("_group_start") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).alias("_cell_start"))
    in_cell = Window.partitionBy("pattern", "_cell").orderBy("_order", "doc_id", "row_key", "size").rowsBetween(*up_to)
    placed = units.withColumn("_inside", F.coalesce(F.sum("weight").over(in_cell), F.lit(0)))
    return placed.join(per_cell, ["pattern", "_cell"]).withColumn("before", F.col("_cell_start") + F.col("_inside")).drop("_cell", "_order", "_inside", "_cell_start", "weight", "cells")


def _one_by_one(counted: DataFrame, count: str) -> DataFrame:
    """Each row as often as ``count`` says, with ``at`` from 0; large counts are dealt out in chunks first."""
    few = counted.filter(F.col(count) <= CHUNK_ROWS).filter(F.col(count) > 0)
    many = counted.filter(F.col(count) > CHUNK_ROWS).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / CHUNK_ROWS).cast("long"))))
    first = F.col("_chunk") * CHUNK_ROWS
    dealt = many.repartition("_chunk").withColumn("at", F.explode(F.sequence(first, F.least(first + CHUNK_ROWS, F.col(count)) - 1))).drop("_chunk")
    return few.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))).unionByName(dealt)


def mix(
    members: DataFrame,
    weights: tuple[float, ...] = WEIGHT_CYCLE,
    total_share: float = TOTAL_SHARE,
    max_repeats: int = MAX_REPEATS,
    seed: int = 17,
) -> tuple[DataFrame, list[Quota]]:
    """Choose how often each document is used.

    ``members`` has doc_id, row_key (tells rows with the same doc_id apart),
    size (long) and sources (array of strings, a null element is the unnamed
    source); other columns are ignored.  Equal rows are one *unit*.  Returns
    the units with ``rows`` (how many rows are equal) and ``taken`` (array of
    ``max_repeats``: how many of them are used at least once, twice, ...), and
    the quotas by source, ordered by code point with null last.

    Sources name data sets: the driver sees one row per membership pattern,
    and more than ``MAX_PATTERNS`` of them are refused, never cut off.
    Documents of size 0 are never taken.  A document is taken when its middle
    token lies inside the flow, so the taken tokens differ from a quota by half
    a document at most.
    """
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct("sources")).alias("s")))
    units = members.groupBy("doc_id", "row_key", "size", pattern.alias("pattern")).agg(F.count("*").alias("rows"), F.first("sources").alias("sources"))
    found = units.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum(F.col("size") * F.col("rows")).alias("size"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources; group the sources first")
    found = sorted(found, key=lambda r: r["pattern"])
    names = sorted({s for r in found for s in r["sources"]}, key=lambda s: (s is None, s or ""))
    size = dict.fromkeys(names, 0)
    for r in found:
        for s in set(r["sources"]):
            size[s] += r["size"]
    everything = sum(r["size"] for r in found)
    quotas = share_targets([(s, size[s]) for s in names], [float(weights[i % len(weights)]) for i in range(len(names))], total_share * everything, max_repeats)
    at = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([r["size"] for r in found], [[at[s] for s in dict.fromkeys(r["sources"])] for r in found], [round(q.target) for q in quotas], max_repeats)
    plan = [(r["pattern"], -(-r["n"] // CELL_ROWS), [sum(by_source[k] for by_source in flow[p]) for k in range(max_repeats)]) for p, r in enumerate(found)]
    limits = members.sparkSession.createDataFrame(plan, "pattern string, cells long, limits array<long>")
    sized = units.join(_small(limits.select("pattern", "cells"), len(found)), "pattern")
    placed = _ordered_starts(sized, seed).join(_small(limits.select("pattern", "limits"), len(found)), "pattern")
    # of the equal rows at before, before + size, ... those with their middle inside the limit
    inside = lambda most: F.greatest(F.lit(0), F.least(F.col("rows"), F.ceil(F.try_divide(most - F.col("before") - F.col("size") / 2, F.col("size")))))
    taken = F.transform("limits", lambda most: F.when(F.col("size") > 0, inside(most)).otherwise(0).cast("long"))
    return placed.withColumn("taken", taken).drop("limits", "before", "pattern"), quotas


def _decided(documents: DataFrame, seed: int) -> tuple[DataFrame, list[Quota]]:
    """Units of ``documents`` (doc_id, row_key, source, size, rows, taken) and the quotas."""
    sized = documents.select("doc_id", F.array("source").alias("sources"), F.xxhash64("text").alias("row_key"), word_count(F.col("text")).alias("size"))
    units, quotas = mix(materialize(sized, "mix-sizes"), seed=seed)
    return units.withColumn("source", F.col("sources")[0]).drop("sources"), quotas


def mix_documents(documents: DataFrame, seed: int = 17) -> DataFrame:
    """Mix ``documents`` by their ``source`` column: one row per document row.

    Gives doc_id, source, row_key, size, source_size, target and copies.  Null
    source: a source of its own, last in order.  Null or empty text: size 0,
    never taken.  Rows that repeat a doc_id are documents of their own, told
    apart by a hash of their text; equal rows are counted, and each of them has
    its own copies.  An empty table gives an empty result.
    """
    units, quotas = _decided(documents, seed)
    known = documents.sparkSession.createDataFrame([(q.source, q.size, q.target) for q in quotas], "q_source string, source_size long, target double")
    joined = units.join(_small(known, len(quotas)), F.col("source").eqNullSafe(F.col("q_source")))
    copies = F.aggregate("taken", F.lit(0).cast("long"), lambda n, rows: n + (F.col("at") < rows).cast("long"))
    return _one_by_one(materialize(joined, "mix-units"), "rows").select("doc_id", "source", "row_key", "size", "source_size", "target", copies.alias("copies"))


def mixed_texts(documents: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, same columns.

    Texts are joined to the decisions by (doc_id, row key, source).  Equal
    rows are used alike; where their uses can't be shared out evenly, which
    happens at the end of a flow only, the rest goes to the first of them by a
    hash of all columns, once each.
    """
    units = _decided(documents, seed)[0]
    uses = F.aggregate("taken", F.lit(0).cast("long"), lambda n, rows: n + rows)
    each = F.floor(uses / F.col("rows")).cast("long")
    names = ["mix_id", "mix_key", "mix_source"]
    shared = units.select(F.col("doc_id").cast("long").alias("mix_id"), F.col("row_key").alias("mix_key"), F.col("source").alias("mix_source"), each.alias("each"), (uses - each * F.col("rows")).alias("over"))
    shared = materialize(shared.filter("each > 0 or over > 0"), "mix-decisions")
    rows = packed(documents, "source").withColumn("key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("key") == F.col("mix_key")) & F.col("source").eqNullSafe(F.col("mix_source"))
    out = unpacked(rows.join(shared.filter("each > 0").drop("over"), same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "each"))))
    rest = shared.filter("over > 0").drop("each")
    n_rest = rest.count()
    if not n_rest:
        return out
    whole = F.xxhash64(F.to_json("row"))
    kinds = rows.join(_small(rest, n_rest), same).groupBy(*names, "over", whole.alias("whole")).agg(F.first("row").alias("row"), F.count("*").alias("n"))
    before = Window.partitionBy(*names).orderBy("whole").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("over") - F.coalesce(F.sum("n").over(before), F.lit(0))
    return out.unionByName(unpacked(_one_by_one(materialize(kinds.withColumn("extra", F.least("n", left)).filter("extra > 0"), "mix-rest"), "extra")))

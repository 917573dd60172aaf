"""Connected components by alternating large-star and small-star.

Each round reads the current edges from a table in the shared folder and
writes the next, so lineage stays one round long and survives lost executors.
A star step joins every edge with the smallest neighbour of its node; the side
with the minima has one row per node, and the edges of a hub, which may be a
third of all, are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import joins
from kinweave.operators.joins import dealt_join
from kinweave.storage import discard, materialize

#: Nodes that a task of ``spanning_forest`` remembers at most, and a batch's more.
FOREST_NODES = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(edges: DataFrame, low: DataFrame, hot: bool) -> DataFrame:
    """Edges with ``m`` of ``low`` (a, m, n) for their node a; edges of hubs are dealt over tasks."""
    least = low.select("a", "m")
    return dealt_join(edges, least, ["a"], low.select("a", "n")) if hot else edges.join(least, "a")


def _large_star(edges: DataFrame, hot: bool) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    sym = _both_ways(edges)
    low = sym.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
    return _with_least(sym.filter("b > a"), low, hot).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, hot: bool) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    linked = _with_least(down, low, hot).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple[bool, bool]:
    """Whether all edges form stars (a node has one parent, and no parent has one), and whether there are hubs."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    row = nodes.agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).alias("open"), F.max(F.col("up") + F.col("down")).alias("most")).first()
    return not row["open"], (row["most"] or 0) > joins.HOT_ROWS


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Nodes with edges and the smallest node they reach: (node, component).

    ``edges`` has two columns of one orderable type; direction, self loops and
    repeats don't matter, rows with a null end are ignored.
    """
    left, right = edges.columns[:2]
    start = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    now = materialize(start.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        settled, hot = _state(now)
        if settled:
            break
        large = _large_star(now, hot)
        if hot:  # a step that deals hubs out reads its edges several times, and two such steps in one plan multiply
            large = materialize(large, "edges")
        after = materialize(_small_star(large, hot), "edges")
        discard(now)
        if hot:
            discard(large)
        now = after
    else:
        raise RuntimeError(f"no stars after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges that connect what ``edges`` connect, fewer of them: those that close a circle inside a task go.

    A task remembers ``FOREST_NODES`` nodes, then starts anew.
    """
    a, b = edges.columns[:2]

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict = {}
        for batch in batches:
            kept = []
            for x, y in zip(batch[a].tolist(), batch[b].tolist(), strict=True):
                if x is None or y is None:
                    continue
                tops = []
                for node in (x, y):
                    top = node
                    while (up := above.get(top, top)) != top:
                        top = above[top] = above.get(up, up)
                    if top != node:
                        above[node] = top
                    tops.append(top)
                if tops[0] != tops[1]:
                    above[tops[1]] = tops[0]
                    kept.append((x, y))
            yield pd.DataFrame(kept, columns=[a, b])
            if len(above) > FOREST_NODES:
                above.clear()

    pairs = edges.select(a, b)
    return pairs.mapInPandas(thin, pairs.schema)

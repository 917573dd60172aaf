"""Nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors are scaled by the largest norm and get one more dimension that makes
all of them unit vectors; the distance to a unit query then orders them as the
inner product does.  A fixed random rotation spreads what tells two vectors
apart evenly over the dimensions, which are scanned in column blocks.

A query scans its nearest list, then the other lists it probes with the
distance of its k-th find as threshold.  After each block a hypothesis test
abandons candidates: with ``d`` of ``D`` rotated dimensions seen, the partial
distance must not exceed ``threshold * d/D * (1 + EPSILON/sqrt(d))**2``.  What
survives all blocks is scored exactly, in double precision on the original
vectors.

Lists have two levels: the nearest centroid, and the nearest of a codebook of
differences from it that all centroids share.  So the number of lists grows
with the table and a list stays at about ``LIST_ROWS`` rows, while the index
keeps a bounded size.  Centroids, codebook and the number of probed lists are
fitted on a bounded sample; every row is indexed.

A list is split into chunks of its rows and blocks of the queries that probe
it, and rows go to the blocks of their own list only: what is shuffled is in
proportion to rows and queries, and one vector shared by a third of all rows
makes more cells, not a larger one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from kinweave.llm.batches import bound_batches
from kinweave.storage import materialize

TOP = 20
#: Rows the fit sees at most, and the floats they may hold together.
SAMPLE_ROWS, SAMPLE_FLOATS = 20_000, 4_000_000
#: Queries of the sample that set how many lists are probed.
SAMPLE_QUERIES = 256
#: Share of the true neighbours that the probed lists must hold on the sample.
SAMPLE_RECALL = 0.97
MAX_LISTS, MAX_PARTS = 4096, 1024
#: Rows of a list, as aimed at by the number of lists.
LIST_ROWS = 1024
CHUNK_ROWS, BLOCK_QUERIES = 256, 512
#: Lists up to this many are broadcast with their chunks and blocks.
BROADCAST_LISTS = 200_000
BLOCK_DIMS = 16
EPSILON = 2.1
#: Once less than one candidate in this many is left, the others are no longer computed.
FEW = 16
_SLACK = 1e-5


@dataclass(frozen=True)
class Index:
    """What the fit found; small, and of a size that rows don't change."""

    dim: int
    largest: float
    rotation: np.ndarray
    centroids: np.ndarray
    parts: np.ndarray
    probes: int

    def unit(self, x: np.ndarray) -> np.ndarray:
        """Rows as rotated unit vectors with the added dimension."""
        scaled = x / self.largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(1)))
        return np.hstack([scaled, rest[:, None]]) @ self.rotation

    def query(self, q: np.ndarray) -> np.ndarray:
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        return np.hstack([unit, np.zeros((len(q), 1))]) @ self.rotation

    def lists(self, rot: np.ndarray) -> np.ndarray:
        """The list of each row: number of the centroid, then of the part."""
        own = _nearest(rot, self.centroids)
        return own * len(self.parts) + _nearest(rot - self.centroids[own], self.parts)

    def ranked(self, rot: np.ndarray, probes: int) -> np.ndarray:
        """The nearest ``probes`` lists of one query, nearest first, among those of as many centroids."""
        far = ((rot - self.centroids) ** 2).sum(1)
        near = np.argsort(far, kind="stable")[: min(probes, len(far))]
        left = rot - self.centroids[near]
        full = (left**2).sum(1)[:, None] - 2.0 * left @ self.parts.T + (self.parts**2).sum(1)
        lists = (near[:, None] * len(self.parts) + np.arange(len(self.parts))).ravel()
        return lists[np.lexsort((lists, full.ravel()))[:probes]]


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centre.T - 0.5 * (centre * centre).sum(1), axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: an id, and a vector with finite components, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter("vec_id is not null and embedding is not null and size(embedding) > 0").filter(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0.0))


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centre)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        full = counts > 0
        centre[full] = sums[full] / counts[full, None]
    return centre


def fit(vectors: DataFrame, top: int = TOP) -> Index | None:
    """Fit rotation, centroids, parts and probes on a bounded sample; None without rows.

    Vectors of another length than most have no inner product with them and
    take no part.
    """
    lengths = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return None
    dim, n, largest = lengths["dim"], lengths["n"], math.sqrt(lengths["norm2"])
    rng = np.random.Generator(np.random.PCG64(11))
    rotation = np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0]
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_FLOATS // dim))
    rows = vectors.filter(F.size("embedding") == dim).orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(bound).select("embedding").collect()
    x = np.array([r["embedding"] for r in rows])
    lists = max(1, min(MAX_LISTS, int(math.sqrt(n)), len(x) // 16 or 1))
    parts = min(MAX_PARTS, len(x) // 16 or 1, -(-n // (lists * LIST_ROWS)))
    index = Index(dim, largest, rotation, np.zeros((1, dim + 1)), np.zeros((1, dim + 1)), 1)
    unit = index.unit(x)
    centre = _kmeans(unit, lists)
    left = unit - centre[_nearest(unit, centre)]
    index = Index(dim, largest, rotation, centre, _kmeans(left, parts) if parts > 1 else np.zeros((1, dim + 1)), 1)
    own = index.lists(unit)
    asked = x[:SAMPLE_QUERIES]
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, : min(top, len(x) - 1)]
    # where, in the order of lists by distance to the query, the true neighbours lie
    seen = []
    for q, row in zip(index.query(asked), best, strict=True):
        place = np.empty(lists * parts, np.int64)
        place[index.ranked(q, lists * parts)] = np.arange(lists * parts)
        seen += place[own[row]].tolist()
    seen.sort()
    probes = seen[min(len(seen) - 1, math.ceil(SAMPLE_RECALL * len(seen)))] + 1 if seen else 1
    return Index(dim, largest, rotation, index.centroids, index.parts, probes)


def scan(rot: np.ndarray, ids: np.ndarray, own: np.ndarray, q_rot: np.ndarray, q_ids: np.ndarray, q_own: np.ndarray, limit: np.ndarray, largest: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best candidates of each query in one cell: (query place, candidate place, score).

    ``limit`` holds each query's squared distance to beat, infinite if none is
    known; then the nearest by the first block, measured in full, set it.
    While most candidates are left, a block is one product of matrices; once
    few are, only those are looked at.
    """
    dims = rot.shape[1]
    first = min(BLOCK_DIMS, dims)
    norms, q_norms = np.cumsum(rot**2, axis=1), np.cumsum(q_rot**2, axis=1)
    dots = q_rot[:, :first] @ rot[:, :first].T
    other = q_ids[:, None] != ids[None, :]
    if len(ids) > top and not np.isfinite(limit).all():
        partial = np.where(other, norms[None, :, first - 1] - 2.0 * dots, np.inf)
        lead = np.argpartition(partial, top, axis=1)[:, : top + 1]
        full = np.stack([((q_rot[i] - rot[lead[i]]) ** 2).sum(1) for i in range(len(q_rot))])
        full[~np.take_along_axis(other, lead, axis=1)] = np.inf
        limit = np.minimum(limit, np.sort(full, axis=1)[:, top - 1])
    reach = lambda d: limit * (d / dims) * (1.0 + EPSILON / math.sqrt(d)) ** 2 + _SLACK if d < dims else limit + _SLACK
    d = first
    while True:
        left = (norms[None, :, d - 1] - 2.0 * dots <= (reach(d) - q_norms[:, d - 1])[:, None]) & other
        if d == dims or np.count_nonzero(left) * FEW < left.size:
            break
        b = min(dims, d + BLOCK_DIMS)
        dots += q_rot[:, d:b] @ rot[:, d:b].T
        d = b
    qi, ci = np.nonzero(left)
    seen = q_norms[qi, d - 1] + norms[ci, d - 1] - 2.0 * dots[qi, ci]
    while d < dims:
        b = min(dims, d + BLOCK_DIMS)
        step = np.empty(len(qi))
        for c in range(0, len(qi), 1 << 16):
            step[c : c + (1 << 16)] = ((q_rot[qi[c : c + (1 << 16)], d:b] - rot[ci[c : c + (1 << 16)], d:b]) ** 2).sum(1)
        seen = seen + step
        d = b
        keep = seen <= reach(d)[qi]
        qi, ci, seen = qi[keep], ci[keep], seen[keep]
    score = np.empty(len(qi))
    for c in range(0, len(qi), 1 << 16):
        score[c : c + (1 << 16)] = np.einsum("ij,ij->i", q_own[qi[c : c + (1 << 16)]], own[ci[c : c + (1 << 16)]])
    order = np.lexsort((ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left")
    keep = rank < top
    return qi[keep], ci[keep], score[keep]


_FOUND = "query_id long, vec_id long, score double"


def _stack(column: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1).astype(np.float64)


def search(vectors: DataFrame, is_query, top: int = TOP, index: Index | None = None) -> DataFrame:
    """The ``top`` nearest rows found for each row that ``is_query`` selects.

    Result: query_id, rank (from 1), vec_id, score, nearest first, ties to the
    smaller vec_id; a query is no candidate of its own.  Null ids, null or
    empty vectors, zero vectors and those with null or non-finite components
    take no part, nor do vectors of another length than most.  Rows that
    repeat a vec_id are candidates of their own; a repeated query id is asked
    once, by the smallest of its vectors.  With fewer candidates all found are
    returned; without rows, nothing.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    dtype = "<f4" if single else "<f8"  # what is sent; all is computed in double precision
    rows = usable(vectors)
    index = index or fit(rows, top)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == index.dim)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for a in range(0, len(part), 4096):
                p = part.iloc[a : a + 4096]
                x = np.array(p["embedding"].tolist(), np.float64)
                yield pd.DataFrame({"vec_id": p["vec_id"].array, "list": index.lists(index.unit(x)), "own": [r.tobytes() for r in x.astype(dtype)]})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for a in range(0, len(part), 512):
                p = part.iloc[a : a + 512]
                near = [index.ranked(q, index.probes) for q in index.query(_stack(p["own"], dtype))]
                yield pd.DataFrame({"query_id": np.repeat(p["vec_id"].to_numpy(), [len(x) for x in near]), "list": np.concatenate(near), "at": np.concatenate([np.arange(len(x), dtype=np.int32) for x in near])})

    placed = materialize(rows.mapInPandas(place, "vec_id long, list long, own binary"), "vectors")
    asked = materialize(placed.filter(is_query).groupBy("vec_id").agg(F.min("own").alias("own")), "queries")
    spots = materialize(asked.mapInPandas(probe, "query_id long, list long, at int"), "spots")
    sizes = materialize(placed.groupBy("list").agg(F.count("*").alias("n")), "lists")
    n_lists = sizes.count()
    parts = lambda n, of: F.ceil(F.col(n) / of).cast("int")

    def cells(wanted: DataFrame) -> DataFrame:
        """Lists that have rows and are probed, with their chunks and blocks."""
        found = wanted.groupBy("list").agg(F.count("*").alias("q")).join(sizes, "list").select("list", parts("n", CHUNK_ROWS).alias("chunks"), parts("q", BLOCK_QUERIES).alias("blocks"))
        return F.broadcast(found) if n_lists <= BROADCAST_LISTS else found

    deal = lambda seed, most, *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.col(most)).cast("int")
    each = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))

    def scan_cell(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, own = _stack(queries["q_own"], dtype), _stack(candidates["own"], dtype)
        worst = queries["worst"].to_numpy(np.float64, na_value=np.nan)
        limit = np.where(np.isnan(worst), np.inf, 2.0 - 2.0 * worst / (index.largest * np.linalg.norm(q, axis=1)))
        ids, q_ids = candidates["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        qi, ci, score = scan(index.unit(own), ids, own, index.query(q), q_ids, q, limit, index.largest, top)
        return pd.DataFrame({"query_id": q_ids[qi], "vec_id": ids[ci], "score": score})

    keys = ["list", "chunk", "block"]

    def run(wanted: DataFrame, limits: DataFrame) -> DataFrame:
        plan = cells(wanted)
        dealt = placed.join(plan, "list").withColumn("chunk", deal(2, "chunks", "vec_id", "own")).withColumn("block", each("blocks")).select(*keys, "vec_id", "own")
        sent = wanted.join(plan, "list").withColumn("block", deal(1, "blocks", "query_id")).withColumn("chunk", each("chunks")).select("query_id", *keys)
        sent = sent.join(limits, "query_id").select("query_id", *keys, "q_own", "worst")
        return dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(scan_cell, _FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # a few rows of each cell
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("own").alias("q_own"))
    near = run(spots.filter("at = 0"), queries.withColumn("worst", F.lit(None).cast("double")))
    near = materialize(near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).drop("rank"), "nearest")
    limits = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).select("query_id", F.when(F.col("n") >= top, F.col("low")).alias("worst"))
    rest = run(spots.filter("at > 0"), queries.join(limits, "query_id", "left"))
    found = near.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return found.select("query_id", "rank", "vec_id", "score")

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, own string, list int, rot string, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "o", 1, "r", 0.5) for i, v in rows], SCHEMA)


def brute(rows, every, top=nb.TOP):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = np.array([np.float32(x) for x in v], np.float64)
    out = {}
    for q in ok:
        if q % every == 0:
            scores = sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q))[:top]
            out[q] = [(i, -s) for s, i in scores]
    return out


def got(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(found, want):
    hits = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize(("scale", "list_rows"), [(0.0, 1024), (1.0, 1024), (1.0, 10)])
def test_recall_and_scores(spark, monkeypatch, scale, list_rows):
    monkeypatch.setattr(nb, "LIST_ROWS", list_rows)  # small lists have two levels
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 24))
    rows = [(i, (centres[i % 8] + rng.normal(size=24)) * np.exp(scale * rng.normal())) for i in range(1500)]
    want = brute(rows, 20)
    found = got(nb.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert set(found) == set(want) and all(len(found[q]) == 20 for q in want)
    assert recall(found, want) >= 0.9
    exact = {(q, i): s for q in want for i, s in brute(rows, 20, 1500)[q]} if scale == 0 else {}
    for q, hits in found.items():
        assert [s for _, s in hits] == sorted((s for _, s in hits), reverse=True)
        assert q not in {i for i, _ in hits}
        for i, s in hits if exact else []:
            assert s == pytest.approx(exact[q, i], rel=1e-12)


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0, 0]), (1, [1, 0, 0]), (2, [1, 0, 0]), (20, [0, 1, 0]), (3, None), (4, []), (5, [0, 0, 0]), (40, [0, 0, 0]), (6, [1, None, 0]), (7, [nan, 1, 0]), (8, [inf, 1, 0]), (None, [1, 1, 1]), (9, [1, 2])]
    found = got(nb.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert found == {0: [(1, 1.0), (2, 1.0), (20, 0.0)], 20: [(0, 0.0), (1, 0.0), (2, 0.0)]}


def test_one_vector_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(nb, "CHUNK_ROWS", 64)
    monkeypatch.setattr(nb, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(2)
    hot = rng.normal(size=12)
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=12)) for i in range(900)]
    want = brute(rows, 20)
    found = got(nb.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    for q in want:
        if q % 3 == 0:
            assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
    assert recall(found, want) >= 0.9


def test_empty(spark):
    assert nb.search(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert nb.search(table(spark, [(20, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_rows_that_repeat_an_id(spark):
    rows = [(1, [1, 0]), (1, [0, 1]), (20, [1, 0]), (20, [0.5, 0]), (3, [2, 0])]
    found = got(nb.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert found == {20: [(3, 1.0), (1, 0.5), (1, 0.0)]}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_recall_on_the_larger_tables(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 20)
    assert recall(got(nb.search(vectors, F.col("vec_id") % 20 == 0)), want) >= 0.95

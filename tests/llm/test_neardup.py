import itertools
import re

import numpy as np
import pytest

from kinweave.llm import neardup
from kinweave.llm.shingles import common, shingle_sets
from kinweave.operators import graph
from kinweave.storage import materialize

from .helpers import documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def edited(text, every, mark):
    w = text.split()
    return " ".join(f"{mark}{i}" if i % every == every - 1 else x for i, x in enumerate(w))


def family(n):
    """Near copies of one text, edited to different degrees, and chains between them."""
    base = prose(3, 220)
    rows = [(100 + i, edited(base, 18 + i % 60, f"m{i}x")) for i in range(n)]
    rows += [(900 + i, prose(3, 220 - 12 * i)) for i in range(8)]
    return rows


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


@pytest.mark.parametrize("small", [2, 32])
def test_components_equal_brute_force(spark, small):
    rows = [(1, prose(1, 80)), (2, prose(1, 80)), (3, prose(1, 80).upper()), (4, "one two"), (5, "one  two"), (6, ""), (7, None), (8, " \t\n"), (9, "one two three"), (10, prose(1, 90)), (11, prose(9, 5000)), (12, prose(9, 5100)), (13, "é " * 30), (14, "É " * 30)]
    rows += family(70)
    assert got(neardup.near_duplicates(documents(spark, rows), small_bucket=small)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (None, None)]
    out = neardup.near_duplicates(documents(spark, rows)).collect()
    assert len(out) == 6
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)] * 3
    assert {(r.doc_id, r.component_id, r.kept) for r in out if r.doc_id is not None} == {(3, 3, True), (4, 3, False)}
    docs = documents(spark, rows)
    kept = neardup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 0), (False, 0), (True, 3)]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert neardup.near_duplicates(docs).count() == 0
    assert neardup.kept_documents(docs).columns == docs.columns


def test_shingle_hashes_agree_with_sets():
    texts = [prose(i, n) for i, n in enumerate((0, 1, 4, 5, 6, 40, 400))] + [None, "", "x" * 300 + " " + "x" * 299, "A\tb\x0bc\x0cd\re f", "word\x1cword"]
    hashed = [s for batch in shingle_sets(texts, 1000) for s in batch]
    exact = [shingles(t) for t in texts]
    assert [len(s) for s in hashed] == [len(s) for s in exact]
    for (a, x), (b, y) in itertools.combinations(zip(hashed, exact, strict=True), 2):
        assert common(a, b) == len(x & y)


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 64, 600, np.uint64)
    a = np.sort(np.concatenate([shared, rng.integers(0, 1 << 64, 100, np.uint64)]))
    b = np.sort(np.concatenate([shared, rng.integers(0, 1 << 64, 100, np.uint64)]))
    low = neardup.minima([a, b])
    assert abs((low[0] == low[1]).mean() - 0.75) < 0.16
    assert (neardup.minima([a, b], chunk=50) == low).all()


def test_rows_of_one_id_are_kept_by_their_own_texts(spark):
    rows = [(1, prose(1, 80)), (5, prose(1, 80)), (5, prose(2, 80)), (7, prose(3, 80)), (7, prose(3, 82)), (8, prose(3, 81)), (9, prose(4, 80)), (9, prose(5, 80)), (10, prose(5, 81))]
    kept = [(r.doc_id, r.text) for r in neardup.kept_documents(documents(spark, rows)).collect()]
    assert (5, prose(2, 80)) in kept and (5, prose(1, 80)) not in kept
    assert sorted(i for i, _ in kept) == [1, 5, 7, 9, 9]


def test_no_plan_holds_many_copies_of_another(spark, monkeypatch):
    joins = {}

    def noted(df, label):
        joins[label] = max(joins.get(label, 0), df._jdf.queryExecution().analyzed().toString().count("Join "))
        return materialize(df, label)

    monkeypatch.setattr(neardup, "materialize", noted)
    monkeypatch.setattr(graph, "materialize", noted)
    monkeypatch.setattr(graph.joins, "HOT_ROWS", 4)
    rows = family(70)
    assert got(neardup.near_duplicates(documents(spark, rows), small_bucket=2)) == brute(rows)
    assert {"open", "more", "stars"} <= joins.keys()
    assert max(joins.values()) <= 12, joins

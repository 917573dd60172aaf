import itertools
import random
from collections import Counter

import pytest
from pyspark.sql.functions import spark_partition_id

from kinweave.llm import mixing

from .helpers import documents, prose


def test_targets_share_by_weight_and_stop_at_the_cap():
    got = mixing.share_targets([("a", 100), ("b", 1000), ("c", 10), ("d", 0)], [3, 1, 2, 3], 1.5 * 1110, 2)
    assert [q.target for q in got] == [200, 1445, 20, 0]
    assert mixing.share_targets([], [], 0, 2) == []
    exact = mixing.share_targets([("a", 600), ("b", 600)], [3, 1], 800, 2)
    assert [q.target for q in exact] == [600, 200]


def cost(flow):
    return sum(r * n for by_source in flow for by_repeat in by_source for r, n in enumerate(by_repeat))


def test_flow_is_feasible_and_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        supply = [rng.randint(0, 4) for _ in range(3)]
        members = [sorted(rng.sample(range(2), rng.randint(1, 2))) for _ in range(3)]
        demand = [rng.randint(0, 6) for _ in range(2)]
        flow = mixing.min_cost_flow(supply, members, demand, 2)
        for p, s in itertools.product(range(3), range(2)):
            assert s in members[p] or sum(flow[p][s]) == 0
        for p in range(3):
            for r in range(2):
                assert sum(flow[p][s][r] for s in range(2)) <= supply[p]
        got = [sum(sum(flow[p][s]) for p in range(3)) for s in range(2)]
        assert all(g <= d for g, d in zip(got, demand, strict=True))
        # brute force: the most that can be sent, then the least total repetition
        best = (0, 0)
        for take in itertools.product(*[range(2 * n + 1) for n in supply]):
            both = sum(t for t, m in zip(take, members, strict=True) if len(m) == 2)
            only = [sum(t for t, m in zip(take, members, strict=True) if m == [s]) for s in range(2)]
            if all(o <= d for o, d in zip(only, demand, strict=True)) and both <= sum(d - o for d, o in zip(demand, only, strict=True)):
                best = max(best, (sum(take), -sum(max(0, t - n) for t, n in zip(take, supply, strict=True))))
        assert (sum(got), -cost(flow)) == best


def rows():
    out = [(i, prose(i, 5 + i % 40), ["b", "a", None, "c", "é"][i % 5 if i % 3 else 0]) for i in range(400)]
    return out + [(900, None, "a"), (901, "", "a"), (902, " \t", None), (None, "one two three", "b"), (5, "again with another text", "a"), (6, out[6][1], out[6][2])]


@pytest.mark.parametrize("cell_rows", [16, 4096])
def test_taken_words_come_near_their_targets(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell_rows)
    docs = documents(spark, rows())
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows())
    names = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r.size for r in got if r.source == s) for s in names}
    want = mixing.share_targets([(s, sizes[s]) for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    for q in want:
        own = [r for r in got if r.source == q.source]
        assert {(r.source_size, r.target) for r in own} == {(q.size, q.target)}
        assert abs(sum(r.size * r.copies for r in own) - q.target) <= max(r.size for r in own) + 1
        assert all(0 <= r.copies <= 2 for r in own)
        # no document twice while another isn't used at all
        used = [r.copies for r in own if r.size]
        assert not (2 in used and 0 in used) or sum(r.size * r.copies for r in own) >= q.size
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs).collect()))
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns
    assert sorted(r.text for r in texts.collect()) == sorted(t for t in _texts(got, rows()))


def _texts(got, source):
    """Texts as often as decided."""
    n = Counter()
    for doc_id, text, src in source:
        n[doc_id, src, len((text or "").split())] = text
    return [n[r.doc_id, r.source, r.size] for r in got for _ in range(r.copies)]


@pytest.mark.parametrize("chunk", [4, 4096])
def test_equal_rows_are_used_as_decided(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk)
    text = prose(1, 10)
    rows = [(i, prose(i, 100), "a") for i in range(10, 20)] + [(7, text, "b")] * 15 + [(None, text, None)] * 11
    docs = documents(spark, rows)
    # one text that differs in another column only
    docs = docs.withColumn("n", docs.n + (spark_partition_id() % 2))
    decided = mixing.mix_documents(docs).collect()
    assert len(decided) == len(rows)
    texts = Counter((r.doc_id, r.source) for r in mixing.mixed_texts(docs).collect())
    wanted = Counter()
    for r in decided:
        assert 0 <= r.copies <= 2
        wanted[r.doc_id, r.source] += r.copies
    assert texts == +wanted
    for source in ("a", "b", None):
        own = [r for r in decided if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= max(r.size for r in own)


def test_overlapping_sources_share_a_pattern(spark, monkeypatch):
    members = spark.createDataFrame([(i, i, 10, ["a", "b"] if i < 50 else ["a"], "p", 3) for i in range(100)], "doc_id long, row_key long, size long, sources array<string>, pattern string, before int")
    out, quotas = mixing.mix(members, weights=(1, 1), total_share=1.0)
    assert [(q.source, q.size) for q in quotas] == [("a", 1000), ("b", 500)]
    assert sum(r.size * sum(r.taken) for r in out.collect()) == 1000
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix(members)


def test_empty(spark):
    docs = documents(spark, [], "doc_id long, text string, source string")
    assert mixing.mix_documents(docs).count() == 0
    assert mixing.mixed_texts(docs).columns == docs.columns
    assert mixing.mix_documents(documents(spark, [(1, None, "a"), (2, "", None)])).filter("copies > 0").count() == 0

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import decontaminate as d

from .helpers import documents, prose


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=30))
def test_myers_equals_dynamic_programming(pattern, text):
    assert d.myers(pattern, text)[0] == distance(pattern, text)


def items():
    return [(1, prose(50, 30)), (2, prose(51, 45) + "."), (3, "short"), (4, None), (5, prose(52, 20)), (None, prose(53, 20))]


def noisy(text, edits, seed):
    rng, chars = random.Random(seed), list(text)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[i] = "z"
        elif kind == 1:
            del chars[i]
        else:
            chars.insert(i, "q")
    return "".join(chars)


def test_matches_equal_brute_force(spark):
    bench = items()
    rows = [(i, f"{prose(i, 60)} {noisy(bench[i % 3 if i % 3 < 2 else 4][1], i % 16, i)} {prose(i + 500, 40)}") for i in range(36)]
    rows += [(100, bench[0][1].upper().replace(" ", " \n- ")), (101, ""), (102, None), (103, prose(7, 20_000) + " " + bench[4][1]), (None, bench[1][1]), (104, bench[0][1][: len(bench[0][1]) // 2])]
    want = set()
    for doc_id, text in rows:
        for item_id, item in bench:
            p, t = d.normal_form(item), d.normal_form(text)
            if not p or len(t) > 50_000 and p not in t:
                continue
            best = 0 if p in t else distance(p, t)
            if best <= (int(len(p) * d.EDIT_SHARE) if len(p) >= 24 else 0) and (len(p) >= 24 or f" {p} " in f" {t} "):
                want.add((doc_id, item_id, best))
    docs = documents(spark, rows)
    table = spark.createDataFrame(bench, "item_id long, text string")
    for block in (d.BLOCK_CHARS, 100):
        got = {(r.doc_id, r.item_id, r.distance) for r in d.contaminated(docs, table, block_chars=block).collect()}
        assert got == want
    clean = d.clean_documents(docs, table)
    assert clean.columns == docs.columns
    dirty = {w[0] for w in want}
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and i not in dirty)


def test_repeated_and_empty(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    text = items()[0][1]
    assert d.contaminated(documents(spark, [(1, text), (1, text)]), bench).count() == 2
    assert d.contaminated(documents(spark, []), bench).count() == 0
    assert d.contaminated(documents(spark, [(1, text)]), bench.limit(0)).count() == 0
    assert d.clean_documents(documents(spark, [(1, text), (1, "fine")]), bench).count() == 1


def test_no_item_is_dropped_before_the_search(spark):
    bench = [(7, prose(60, 30)), (7, prose(61, 30)), (None, prose(62, 30)), (9, "What is 17 plus 25?"), (10, "中国的首都是哪里？"), (2**60 + 1, prose(63, 30)), (11, "?!")]
    rows = [(1, bench[0][1]), (2, bench[1][1]), (3, bench[2][1]), (4, "so: what is 17, plus 25"), (5, "我问你中国的首都是哪里吗"), (6, "what is 17 plus 256"), (7, bench[5][1]), (8, prose(90, 80) + " ?!")]
    docs, table = documents(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    want = [(1, 7), (2, 7), (3, None), (4, 9), (5, 10), (7, 2**60 + 1)]
    for block in (d.BLOCK_CHARS, 10):
        assert sorted(((r.doc_id, r.item_id) for r in d.contaminated(docs, table, block_chars=block).collect())) == want
    assert sorted(r.doc_id for r in d.clean_documents(docs, table).collect()) == [6, 8]


def test_every_length_has_its_share_of_edits(spark):
    for length in range(1, 80):
        item = prose(length, 60)[:length].strip()
        budget = d.error_budget(item, 0.06, 0)
        assert budget == min(int(len(item) * 0.06), len(item) - 1)
        assert len(d.pieces(item, budget)) == budget + 1
    item = prose(70, 3)[:18].strip()
    docs = documents(spark, [(1, f"ab {item[:5]}q{item[6:]} cd"), (2, "nothing of it")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert d.contaminated(docs, bench).count() == 0
    assert [(r.doc_id, r.distance) for r in d.contaminated(docs, bench, least_item=0).collect()] == [(1, 1)]

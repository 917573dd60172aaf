import itertools
import os
import random
import zlib

import numpy as np
import pytest

from kinweave.llm import quality, toxicity, transducers

from .helpers import documents, prose


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled(spark, n=400):
    """Clean prose, junk (repeats, capitals) and abuse with invented stems."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        text, good, bad = prose(i % 50 + 1000, 60 + i % 40, 300), 1, 0
        words = text.split()
        if i % 8 == 1:
            text, good = " ".join([words[0]] * 60), 0
        elif i % 8 == 3:
            text, good = "!! ".join(words).upper(), 0
        elif i % 8 == 5:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum"]) if i % 16 == 5 else "zorgu" + rng.choice("abcdefgh"))
            text, bad = " ".join(words), 1
        rows.append((i, text))
        labels.append((i, good, bad))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (g, b) for i, g, b in labels}


def check(out, truth, which, least):
    rows = out.collect()
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == held(r.doc_id) for r in rows)
    assert all(0.0 <= r.score <= 1.0 for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id][which] for r in test]) >= least


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    out = quality.quality_scores(docs, labels)
    check(out, truth, 0, 0.95)
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in out.collect())


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    lexicon = toxicity.fit(docs, labels)
    out = toxicity.score_documents(docs, lexicon)
    check(out, truth, 1, 0.97)
    assert any(s.startswith("zorg") for s in lexicon.stems)
    clean = toxicity.clean_documents(docs, labels)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in out.collect() if r.predicted == 0}


@pytest.mark.parametrize("what", ["quality", "toxicity"])
def test_odd_rows(spark, what):
    rows = [(1, None), (2, ""), (3, "  \n "), (None, "text without id"), (4, prose(1, 30_000)), (5, "same"), (5, "same"), (6, "\x00퟿ é 中文")]
    docs = documents(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (4, 0, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        if what == "quality":
            out = quality.quality_scores(docs, labels)
        else:
            out = toxicity.score_documents(docs, toxicity.fit(docs, labels))
        got = out.collect()
        assert len(got) == len(rows)
        assert all(0.0 <= r.score <= 1.0 and r.predicted in (0, 1) for r in got)
        assert len({r.score for r in got if r.doc_id == 5}) == 1
    empty = documents(spark, [])
    assert (quality.quality_scores(empty, none) if what == "quality" else toxicity.score_documents(empty, toxicity.fit(empty, none))).count() == 0


def test_grammar_reads_clauses():
    grammar = toxicity.Grammar(toxicity.Lexicon(words=dict.fromkeys(toxicity.INSULT, toxicity.SEED_WEIGHT)))
    weight = grammar.accepted
    assert weight("you are an idiot") > weight("an idiot walked by") > weight("you are not an idiot")
    assert weight('he said "idiot"') < weight("idiot")
    assert weight("i will kill you") > 0 == weight("to kill time")
    assert weight("plain words only") == weight(None) == weight("") == 0
    assert weight("not here. you idiot") == weight("you idiot")
    assert grammar.score("you are an idiot") >= toxicity.PREDICT_FROM > grammar.score("a plain text")


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = np.zeros((2000, quality.N_INPUTS))
    x[:, 0] = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = quality.train(x, y).scores(x)
    for lo, hi in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.0)):
        inside = (p >= lo) & (p < hi)
        assert abs(p[inside].mean() - y[inside].mean()) < 0.08


def test_neighbour_sums_equal_a_loop():
    texts = ["a b c", "", None, "d d a", "c"]
    t = quality.tokenize(texts)
    want = np.zeros((quality.BUCKETS, quality.DIMS))
    at = 0
    for end in t.ends:
        for i in range(at, end):
            for j in (i - 1, i + 1):
                if at <= j < end:
                    for k in range(quality.NONZERO):
                        want[t.bucket[i], quality._PLACE[t.bucket[j], k]] += quality._SIGN[t.bucket[j], k]
        at = end
    got, counts = quality.neighbour_sums(t)
    assert np.allclose(got, want) and counts.sum() == 7


def test_lone_words_do_not_add_up_over_a_text():
    lexicon = toxicity.Lexicon(words=dict.fromkeys(toxicity.INSULT, toxicity.SEED_WEIGHT) | {"zorgu": 6.0})
    grammar = toxicity.Grammar(lexicon)
    for lone in ("trash", "an idiot walked by", "zorgu"):
        assert grammar.score(f"{prose(1, 20_000)} {lone} {prose(2, 100)}") < toxicity.PREDICT_FROM
    far = " ".join(f"{prose(i, 300)} trash" for i in range(20))
    assert grammar.score(far) < toxicity.PREDICT_FROM < grammar.score(prose(1, 300) + " idiot clown trash " + prose(2, 300))
    assert grammar.score(prose(1, 20_000) + ". you idiot. " + prose(2, 300)) >= toxicity.PREDICT_FROM


def test_scale_is_fitted_on_training_rows(spark):
    docs, labels, _ = labelled(spark)
    lexicon = toxicity.fit(docs, labels)
    assert (lexicon.centre, lexicon.slope) != (toxicity.Lexicon().centre, toxicity.Lexicon().slope)
    assert toxicity.Grammar(lexicon).score(f"{prose(1, 20_000)} an idiot walked by") < toxicity.PREDICT_FROM


def test_threats_need_a_target_or_an_intent(spark):
    seeds = dict.fromkeys(toxicity.INSULT, toxicity.SEED_WEIGHT)
    grammar = toxicity.Grammar(toxicity.Lexicon(words=seeds))
    for text in ("I'll kill you", "I’ll kill you", "I want to hurt you", "we are coming to stab you", "kill yourself", "go kill yourself", "ich möchte dich töten", "I shall hurt him"):
        assert grammar.score(f"{prose(1, 300)}. {text}. {prose(2, 300)}") >= toxicity.PREDICT_FROM, text
    for text in ("to kill time", "they attack the problem", "she hurt her knee", "you beat the eggs"):
        assert grammar.score(text) < toxicity.PREDICT_FROM, text
    assert grammar.accepted("they attack her") > 0 == grammar.accepted("the attack")
    rows, labels = [], []
    for i in range(80):
        rows.append((i, f"{prose(i, 60)}. {('we hurt you', 'we punch you')[i % 2]}. {prose(i + 99, 60)}"))
        labels.append((i, 1, 1 - i % 2))
    lexicon = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    learned = toxicity.Grammar(lexicon)
    assert learned.accepted("we hurt you") > learned.accepted("we punch you") == 0


def paths(machine, symbols):
    """Every path of a machine over symbols: (weight, written), by enumeration."""
    found = [(0.0, "", 0)]
    for x in symbols:
        found = [(w + a.weight, out + a.out, a.to) for w, out, state in found for a in machine.arcs(state, x)]
    return [(w, out) for w, out, state in found if machine.is_final(state)]


def in_turn(machines, symbols):
    """Every path of machines that read what the one before wrote."""
    found = [(0.0, symbols)]
    for m in machines:
        found = [(w + v, out) for w, written in found for v, out in paths(m, written)]
    return found


VOCABULARY = "you him yourself not said will go idiot kill the cat".split() + ['"']


def test_composition_equals_machines_in_turn():
    rng = random.Random(5)
    machines = toxicity.cascade()
    whole = transducers.compose(*machines)
    assert all(len(m) > 1 for m in machines)
    for _ in range(300):
        symbols = "".join(rng.choice("otybnsqipavQU") for _ in range(rng.randint(0, 6)))
        assert sorted(paths(whole, symbols)) == sorted(in_turn(machines, symbols))


def test_clause_weight_equals_the_heaviest_of_all_paths():
    rng = random.Random(6)
    grammar = toxicity.Grammar(toxicity.Lexicon(words={"idiot": 4.0}))
    for _ in range(400):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(1, 7))]
        readings = [grammar.readings(w, grammar._classes[w]) for w in words]
        best = (0.0, "")
        for reading in itertools.product(*readings):
            given = sum(w for _, w in reading)
            best = max([best, *((given + w, out) for w, out in in_turn(toxicity.cascade(), "".join(x for x, _ in reading)))], key=lambda b: b[0])
        assert grammar.accepted(" ".join(words)) == pytest.approx(best[0]), words


def test_every_transducer_changes_decisions():
    grammar = toxicity.Grammar(toxicity.Lexicon(words=dict.fromkeys(toxicity.INSULT, toxicity.SEED_WEIGHT)))
    flagged = lambda text: grammar.score(text) >= toxicity.PREDICT_FROM
    around = lambda text: f"{prose(1, 60)}. {text}. {prose(2, 60)}"
    for plain, changed in (
        ("you are an idiot", "you are not an idiot"),
        ("you are an idiot", "she said you are an idiot"),
        ("you are an idiot", 'he wrote: "you are an idiot"'),
        ("you are an idiot", "the idiot"),
        ("i will kill you", "i will kill time"),
        ("i will kill you", "i will never kill you"),
        ("kill yourself", 'he said "kill yourself"'),
        ("hurt you", "hurt the"),
        ("wait, idiot, you know", "wait, idiot, and one two three you"),
    ):
        assert flagged(around(plain)) and not flagged(around(changed)), (plain, changed)
    assert not any(flagged(w) for w in toxicity.INSULT | toxicity.THREAT)


def test_one_lone_word_never_rejects_whatever_labels_say():
    for weight, y in ((np.full(50, 2.0), np.ones(50)), (np.array([2.0, 0.0] * 30), np.array([1.0, 0.0] * 30))):
        centre, slope = toxicity.fitted_scale(weight, y, 3.0, 1.5)
        assert 1 / (1 + np.exp(-slope * (toxicity.SEED_WEIGHT + toxicity.LONE - centre))) < toxicity.PREDICT_FROM


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_toxicity_on_the_larger_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_documents(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels, "doc_id").filter("toxic is not null")
    rows = out.select("toxic", "predicted").collect()
    assert sum(r.predicted for r in rows if r.toxic) >= 110
    assert sum(r.predicted for r in rows if not r.toxic) <= 5


@pytest.mark.parametrize("tokens", [3, 1 << 17])
def test_pooled_vectors_equal_a_loop(monkeypatch, tokens):
    monkeypatch.setattr(quality, "POOL_TOKENS", tokens)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    texts = ["a b c d e f g", "", None, "one", "Two two", "x!! 12 -", " ", "a a a a"]
    got = quality.pooled(texts, vectors)
    assert got.shape == (len(texts), quality.N_INPUTS)
    for text, row in zip(texts, got, strict=True):
        v = vectors[quality.tokenize([text]).bucket].astype(float)
        want = np.zeros((4, quality.DIMS))
        if len(v):
            want[0], want[1] = v.mean(0), v.std(0)
        if len(v) > 1:
            want[2] = np.mean([abs(x - y) for x, y in zip(v, v[1:], strict=False)], axis=0)
            want[3] = np.mean([x * y for x, y in zip(v, v[1:], strict=False)], axis=0)
        assert np.allclose(row, want.ravel(), atol=2e-3)  # a spread of zero is a root of rounding errors
    assert len(quality.tokenize(["x!! 12 -"]).bucket) == 4


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_quality_on_the_larger_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert len(rows) > 900 and sum(r.quality != r.predicted for r in rows) <= 8

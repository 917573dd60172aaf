from collections import Counter

import corpus_pipeline
import numpy as np

import __spark_entry__
from kinweave.llm import decontaminate, neardup, toxicity

from ..conftest import SF


def test_each_stage_keeps_its_promise(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    lexicon = toxicity.fit(docs, labels)
    grammar = toxicity.Grammar(lexicon)
    now = docs.collect()
    want = sorted(r.doc_id for r in now if grammar.score(r.text) < toxicity.PREDICT_FROM)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(now, docs.schema), SF)
        if name == "tokens":
            got = out.orderBy("start").collect()
            assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
            assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in now)
            break
        assert out.columns == docs.columns
        rows = out.collect()
        if name == "toxicity":
            assert sorted(r.doc_id for r in rows) == want
        elif name == "near_dedup":
            found = neardup.near_duplicates(spark.createDataFrame(now, docs.schema)).collect()
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in found if r.kept)
            assert len(rows) < len(now)
        elif name == "decontamination":
            hits = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(now, docs.schema), bench).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in now if r.doc_id not in hits)
        elif name == "mixing":
            words = lambda rs: sum(len(r.text.split()) for r in rs)
            assert max(Counter(r.doc_id for r in rows).values()) <= 2
            assert abs(words(rows) / (1.5 * words(now)) - 1) < 0.05
        now = rows


def test_run_equals_its_stages(spark):
    once = corpus_pipeline.run(spark, SF)
    again = __spark_entry__.queries()["pipeline"](spark, SF)
    assert once.count() > 0
    assert sorted(once.collect()) == sorted(again.collect())


def test_all_ten_queries_are_registered():
    found = {q.split("_")[0] for q in __spark_entry__.queries()}
    assert {f"op{n}" for n in range(1, 11)} <= found

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinweave.llm import tokens
from kinweave.llm.wavelet import Shard, build

from .helpers import documents, prose


def expected(rows):
    tok = Tokenizer.from_file(tokens.VOCABULARY)
    out, start = [], 0
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_shards_hold_every_document_in_order(spark):
    rows = [(5, prose(1, 300)), (2, None), (9, ""), (-3, "a<|endoftext|>b \x1c 中文 é"), (7, "word " * 40_000), (None, "no id"), (2_000_000_000_000, "far")]
    got = tokens.tokenized(documents(spark, rows)).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected(order)


def test_repeated_rows_and_small_shards(spark, tmp_path):
    rows = [(i % 7, prose(i % 3, 60)) for i in range(60)]
    path = f"file://{tmp_path}/shards"
    tokens.write_shards(documents(spark, rows), path, shard_tokens=200)
    got = tokens.read_shards(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((d, n, c) for d, _, n, c in expected(rows))
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert spark.read.parquet(path).count() > 5


def test_empty_table(spark):
    assert tokens.tokenized(documents(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z'stre vmld09²½\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 –…€éßªǅə_-.,!<|>１中")), max_size=20))
def test_piece_encoder_equals_the_tokenizer(text):
    enc = tokens.encoder(tokens.VOCABULARY)
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == Tokenizer.from_file(tokens.VOCABULARY).encode(text, add_special_tokens=False).ids if text else enc.encode(text) == b""


def test_wavelet_matrix_access_count_find():
    rng = random.Random(4)
    for n, k in ((1, 1), (1000, 1), (3000, 37), (600_000, 900)):
        ids = np.array([min(int(rng.expovariate(1 / k)), 50_000) for _ in range(n)], "<u2")
        shard = Shard(build(ids, [1], np.array([n])))
        assert (shard.decode() == ids).all()
        for _ in range(20):
            i = rng.randrange(n)
            token = int(ids[i])
            where = np.flatnonzero(ids == token)
            lo, hi = sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
            j = rng.randrange(len(where))
            assert shard.access(i) == token
            assert shard.count(token, lo, hi) == int((ids[lo:hi] == token).sum())
            assert shard.find(token, j) == where[j]
        assert shard.count(50_256) == 0 and shard.find(50_256, 0) == -1 and shard.find(int(ids[0]), n) == -1
    empty = Shard(build(np.zeros(0, "<u2"), [], np.zeros(0, np.int64)))
    assert len(empty.decode()) == 0 and empty.count(3) == 0


def test_access_reads_one_block_of_each_plane():
    ids = np.random.default_rng(1).integers(0, 3000, 200_000).astype("<u2")
    shard = Shard(build(ids, [1], np.array([len(ids)])))
    assert shard.access(123_456) == ids[123_456]
    assert len(shard._blocks) == shard.bits
    assert sum(len(b) for b in shard._blocks.values()) <= shard.bits * 8192


def test_an_id_with_many_rows_takes_several_ranges(spark, tmp_path):
    rows = [(5 if i % 3 else i, prose(i, 20 + i % 7)) for i in range(300)] + [(None, prose(i, 9)) for i in range(200)]
    path = f"file://{tmp_path}/shards"
    tokens.write_shards(documents(spark, rows), path)
    got = tokens.read_shards(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, n, c) for d, _, n, c in expected(rows))
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    assert len({r.range_no for r in got if r.doc_id == 5}) > 1
    again = tokens.write_shards(documents(spark, rows[::-1]), path + "2") or tokens.read_shards(spark, path + "2").orderBy("start").collect()
    assert [r.ids_crc32 for r in again] == [r.ids_crc32 for r in got]

"""Token-id output: documents to wavelet-matrix shards, and back.

Documents are encoded where they are read; only ids travel.  A range of
doc_id goes to one partition, is sorted there by Spark (which spills), and is
streamed into shards that close at ``shard_tokens`` tokens, so memory is
bounded by one shard and one document however long texts are.

The container is Parquet with one row per shard (range_no, shard_no, n_docs,
n_tokens, file): ``file`` is the complete wavelet-matrix file of the shard.
That way any store Spark writes to can hold the shards, and a failed task
leaves no half-written file behind.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.batches import bound_batches
from kinweave.llm.wavelet import Shard, build
from kinweave.storage import shared_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
SHARD_TOKENS = 1 << 20
#: Pieces whose ids a worker remembers, in entries.
CACHE_PIECES = 400_000
#: The letters and other number signs of the plain range, where all versions of
#: Unicode agree; texts with other characters are left to the tokenizer whole.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_BEYOND = "[^\x00-\x1b\x20-ɏ\u2000-\u200a\u2010-\u2027\u20ac]"
#: Separators that libraries class differently.
_DISPUTED = "\x1c\x1d\x1e\x1f"
#: The pre-tokenizer's pieces on that range.
_PIECE = rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, PieceEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library.

    BPE never crosses a piece of the pre-tokenizer, and prose repeats its
    pieces, so the tokenizer's model is asked for the ids of a piece once and
    they are then remembered.  Texts with an added token's string, or with
    characters outside the plain range, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        wide = self._tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self._code = "I" if wide else "H"
        self._pieces = re.compile(_PIECE).findall
        self._special = [*_DISPUTED, *(t.content for t in self._tokenizer.get_added_tokens_decoder().values())]
        self._beyond = re.compile(_BEYOND).search
        tokenize, letters, code = self._tokenizer.model.tokenize, _byte_letters(), self._code

        class Cache(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = array(code, [t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))]).tobytes()
                if len(self) < CACHE_PIECES and len(piece) < 64:
                    self[piece] = ids
                return ids

        self._cache = Cache()

    def _plain(self, text: str) -> bool:
        if any(s in text for s in self._special):
            return False
        try:
            text.encode("latin-1")  # far faster than a search, and enough for most texts
        except UnicodeEncodeError:
            return self._beyond(text) is None
        return True

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as packed integers; null counts as empty."""
        if not text:
            return b""
        if not self._plain(text):
            return array(self._code, self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._cache.__getitem__, self._pieces(text)))


def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker process for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


#: Where documents without an id stand: before all others.
NO_ID = -(1 << 63)


def _id_bounds(documents: DataFrame, ranges: int) -> list[int]:
    """Doc ids that cut the table into about equal ranges; reads that column only.

    An id that holds several ranges' worth of rows is there several times.
    """
    cuts = [i / ranges for i in range(1, ranges)]
    if not cuts:
        return []
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return sorted(documents.select(F.percentile_approx(known, cuts, 20 * ranges).alias("b")).first()["b"] or [])


def _ranges_of(ids: np.ndarray, marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each document; those of a bound that is repeated are dealt over its ranges by ``marks``."""
    low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    return np.where(high - low > 1, low + 1 + marks % np.maximum(1, high - low), high)


def write_shards(documents: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write them, in ascending doc_id order, as shards.

    Null text: no ids but the end id.  Null doc_id: first.  Rows that repeat a
    doc_id are documents of their own, in an order that depends on their ids
    only; a doc_id with many rows takes several ranges, dealt out by those ids.
    Other columns are ignored.  An empty table writes no shard.
    """
    bound_batches(documents.sparkSession)
    spark = documents.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _id_bounds(documents, ranges)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, cuts = encoder(vocabulary), np.array(bounds, np.int64)
        end = np.array([end_id], enc.dtype).tobytes()
        for rows in batches:
            for a in range(0, len(rows), 256):
                doc_ids = rows["doc_id"].iloc[a : a + 256]
                ids = [enc.encode(t) + end for t in rows["text"].iloc[a : a + 256]]
                at = _ranges_of(doc_ids.fillna(NO_ID).to_numpy(np.int64), np.array([zlib.crc32(x) for x in ids], np.int64), cuts)
                yield pd.DataFrame({"range_no": at.astype(np.int32), "doc_id": doc_ids, "ids": ids})

    def sharded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dtype = encoder(vocabulary).dtype
        held: list[tuple[int | None, bytes]] = []
        now, shard, size = None, 0, 0

        def close() -> pd.DataFrame:
            lengths = np.array([len(b) // dtype.itemsize for _, b in held], np.int64)
            raw = build(np.frombuffer(b"".join(b for _, b in held), dtype), [d for d, _ in held], lengths)
            return pd.DataFrame({"range_no": [now], "shard_no": [shard], "n_docs": [len(held)], "n_tokens": [int(lengths.sum())], "file": [raw]})

        for rows in batches:
            for range_no, doc_id, raw in zip(rows["range_no"], rows["doc_id"], rows["ids"], strict=True):
                if held and (range_no != now or size >= shard_tokens):
                    yield close()
                    shard = 0 if range_no != now else shard + 1
                    held, size = [], 0
                now = range_no
                held.append((None if pd.isna(doc_id) else int(doc_id), raw))
                size += len(raw) // dtype.itemsize
        if held:
            yield close()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(encoded, "range_no int, doc_id long, ids binary")
    rows = rows.repartitionById(ranges, F.col("range_no")).sortWithinPartitions("range_no", "doc_id", "ids")
    rows.mapInPandas(sharded, "range_no int, shard_no int, n_docs int, n_tokens long, file binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents of written shards: doc_id, start, n_tokens, ids_crc32, place.

    ``start`` counts the ids of all documents before; the table of shards is
    summed inside each range first, so only one row per range is ever ordered
    as a whole.
    """
    shards = spark.read.schema("range_no int, shard_no int, n_docs int, n_tokens long, file binary").parquet(path)
    before = (Window.unboundedPreceding, -1)
    per_range = shards.groupBy("range_no").agg(F.sum("n_tokens").alias("n")).withColumn("range_start", F.coalesce(F.sum("n").over(Window.orderBy("range_no").rowsBetween(*before)), F.lit(0)))
    starts = shards.select("range_no", "shard_no", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("range_no").orderBy("shard_no").rowsBetween(*before)), F.lit(0)).alias("in_range"))
    starts = starts.join(per_range, "range_no").select("range_no", "shard_no", (F.col("range_start") + F.col("in_range")).alias("shard_start"))

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for range_no, shard_no, raw in zip(rows["range_no"], rows["shard_no"], rows["file"], strict=True):
                shard = Shard(raw)
                doc_ids, lengths = shard.documents()
                ends = np.cumsum(lengths, dtype=np.int64)
                ids = memoryview(shard.decode().astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"range_no": range_no, "shard_no": shard_no, "doc_id": pd.array(doc_ids, "Int64"), "offset": ends - lengths, "n_tokens": lengths.astype(np.int64), "ids_crc32": np.array(crc, np.int64)})

    docs = shards.select("range_no", "shard_no", "file").mapInPandas(decoded, "range_no int, shard_no int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    placed = docs.join(starts, ["range_no", "shard_no"])
    return placed.select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "range_no", "shard_no")


def tokenized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write shards to the shared folder and return what their files hold."""
    spark = documents.sparkSession
    path = shared_path(spark, "token-shards")
    write_shards(documents, path, vocabulary)
    return read_shards(spark, path)

"""Benchmark decontamination by pigeonhole pieces and Myers bit-parallel distance.

A test item of n characters may differ from a passage by up to k edits
(``edit_share`` of n).  Cut the item into k + 1 pieces: whatever k edits do,
one piece stays whole.  Documents are searched for all pieces at once, and
around each hit Myers' algorithm computes the smallest edit distance between
the item and any passage there.  A document holds an item if that distance is
at most k; no passage within k edits is missed.

Texts and items are compared in normal form: lower case, every run of
characters that are neither letters nor digits a single space.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.batches import bound_batches
from kinweave.llm.rows import packed, unpacked
from kinweave.storage import materialize

#: Edits allowed, as a share of the item's characters.
EDIT_SHARE = 0.06
#: Items shorter than this in normal form match as whole words only, without
#: edits: an edit makes another short question of one.  0 gives all items edits.
LEAST_ITEM = 24
#: Characters of items that one pass over the documents searches for; a larger
#: benchmark takes several passes, one after another, so what is broadcast
#: never grows with it.
BLOCK_CHARS = 8_000_000
RESULT = "doc_id long, row_key long, item_id long, distance int, budget int, start int, stop int"

_APART = re.compile(r"[\W_]+")
#: Scripts that write words without spaces: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal_form(text: str | None) -> str:
    """Lower case; runs of other characters than letters and digits as one space."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _APART.sub(" ", text.lower()).strip()


def error_budget(item: str, share: float = EDIT_SHARE, least_item: int = LEAST_ITEM) -> int:
    """Edits allowed for an item in normal form; fewer than it has characters."""
    return max(0, min(int(len(item) * share), len(item) - 1)) if len(item) >= least_item else 0


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item as budget + 1 pieces of about equal length, with their places."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of the text, and where it ends.

    Myers 1999: a column of the distance matrix is two bit vectors of its
    vertical differences; Python's integers hold patterns of any length.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1 & full, left << 1 & full
        up, down = left | (full & ~((eq | down) | right)), right & (eq | down)
        if score < best:
            best, end = score, j
            if not best:
                break
    return best, end


def whole_words(text: str, start: int, stop: int) -> bool:
    """Whether a passage of a normal form begins and ends where words may."""
    cuts = [text[at - 1 : at + 1] for at in (start, stop) if 0 < at < len(text)]
    return all(" " in cut or _UNSPACED.search(cut) for cut in cuts)


class Matcher:
    """Finds a block of items in texts; items may share an id or have none."""

    def __init__(self, items: list[tuple[int | None, str]], share: float, least_item: int = LEAST_ITEM):
        import ahocorasick

        self._ids, self._least = [i for i, _ in items], least_item
        self._items = {no: (text, error_budget(text, share, least_item)) for no, (_, text) in enumerate(items)}
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (text, budget) in self._items.items():
            for at, piece in pieces(text, budget):
                places.setdefault(piece, []).append((i, at))
        self._auto = ahocorasick.Automaton()
        for piece, where in places.items():
            self._auto.add_word(piece, (len(piece), where))
        self._auto.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int, int]]:
        """(item id, distance, budget, start, stop) of the best passage of each item."""
        best: dict[int, tuple[int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        for end, (size, where) in self._auto.iter(text):
            for item, at in where:
                pattern, budget = self._items[item]
                if item in best and best[item][0] == 0:
                    continue
                start = end + 1 - size - at
                if len(pattern) < self._least:
                    if whole_words(text, start, start + size):
                        best[item] = (0, start, start + size)
                    continue
                zone = start // (budget + 1)
                if (item, zone) in done:
                    continue
                if text.startswith(pattern, max(0, start)):
                    best[item] = (0, start, start + len(pattern))
                    continue
                done.add((item, zone))
                # hits of one zone start within budget of each other
                low = max(0, zone * (budget + 1) - budget)
                high = (zone + 1) * (budget + 1) + len(pattern) + budget
                distance, stop = myers(pattern, text[low:high])
                if distance <= budget and (item not in best or distance < best[item][0]):
                    best[item] = (distance, max(0, low + stop - len(pattern)), low + stop)
        return [(self._ids[i], d, self._items[i][1], a, b) for i, (d, a, b) in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items in normal form, streamed to the driver, a bounded block at a time."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        item = normal_form(row["text"])
        if not item:
            continue
        held.append((row["item_id"], item))
        size += len(item)
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(documents: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, least_item: int = LEAST_ITEM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs of a document and a test item it holds, at most ``edit_share`` edits apart.

    Result: doc_id, row_key (hash of the text, tells rows of one doc_id
    apart), item_id, distance, budget, start and stop of the best passage in
    the document's normal form.  Null texts and items, and those without a letter
    or digit, match nothing; items under ``least_item`` characters match as whole
    words, without edits.  A null doc_id or item_id is carried through.  Repeated
    rows give repeated pairs; each text of a repeated item_id counts.  Other
    columns are ignored.
    """
    bound_batches(documents.sparkSession)
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64("text"))

    def found_in(items: list[tuple[int | None, str]]) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, edit_share, least_item)
            for rows in batches:
                hits = [(i, k, *hit) for i, k, t in zip(rows["doc_id"], rows["row_key"], rows["text"], strict=True) if t for hit in matcher.find(normal_form(t))]
                out = pd.DataFrame(hits, columns=["doc_id", "row_key", "item_id", "distance", "budget", "start", "stop"])
                yield out.assign(item_id=pd.array([h[2] for h in hits], "Int64"))

        return texts.mapInPandas(search, RESULT), shared

    parts: list[DataFrame] = []
    blocks = _blocks(benchmark, block_chars)
    items = next(blocks, None)
    while items is not None:
        part, shared = found_in(items)
        items = next(blocks, None)
        if parts or items is not None:  # of several blocks one is in memory at a time
            part = materialize(part, "contaminated")
            shared.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT)


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with their columns.

    Hits are few and leave the scan as (doc_id, row key); the anti join keeps
    documents with a null doc_id apart from each other by their text.
    """
    hits = contaminated(documents, benchmark).select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key")).distinct()
    rows = packed(documents).withColumn("key", F.xxhash64("text"))
    return unpacked(rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left_anti"))

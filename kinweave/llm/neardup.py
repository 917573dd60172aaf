"""MinHash near-duplicates: banding, verification, components by star steps.

1. Every document gets its set of word shingles, 128 universal-hash minima of
   it, 32 band keys of four minima each, and a 128-bit fingerprint of the set.
2. Documents with one fingerprint are one *class*; only its smallest doc_id
   goes on, so thousands of copies cost one row.
3. Classes that share a band key form a bucket.  Each is compared with the
   bucket's smallest class, its hub: the minima estimate the similarity and
   drop pairs far below the limit, the others are confirmed on full sets.
4. Buckets whose members still lie in several components are searched for
   links between components: small ones pair by pair, large ones by exact
   prefix filtering (two sets this similar must share one of their rarest
   quarter of shingles).  Pairs inside a component can't change the result.
5. Components come from alternating large-star and small-star.

At similarity 0.75 a pair misses all bands with probability
``(1 - 0.75**4)**32`` = 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from kinweave.llm.batches import bound_batches
from kinweave.llm.rows import packed, unpacked
from kinweave.llm.shingles import common, mix64, shingle_sets
from kinweave.operators.graph import connected_components
from kinweave.operators.joins import dealt_join, dealt_pairs
from kinweave.storage import discard, materialize

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Classes whose sets a task remembers to have written, so that rows that repeat id and text cost little.
SEEN_SETS = 100_000
#: A link: LIMIT[1] * shared >= LIMIT[0] * united.
LIMIT = (75, 100)
#: Share of equal minima below which a pair isn't confirmed on full sets: six
#: standard deviations under the limit.
ESTIMATE_FLOOR = 0.52
#: Buckets up to this many classes are searched pair by pair in step 4.
SMALL_BUCKET = 8

_RNG = np.random.Generator(np.random.PCG64(7))
_MUL = _RNG.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, HASHES, np.uint64)
_BAND = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND_NO = _RNG.integers(0, 1 << 64, BANDS, np.uint64)
_SIG = "doc_id long, row_key long, n_shingles long, set_lo long, set_hi long, bands array<long>, minima binary"


def minima(sets: list[np.ndarray], chunk: int = 1 << 14) -> np.ndarray:
    """The smallest value of each hash a*x+b (mod 2**64) over each non-empty set."""
    out = np.empty((len(sets), HASHES), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= chunk):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        first = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for h in range(HASHES):
            out[at:end, h] = np.minimum.reduceat(x * _MUL[h] + _ADD[h], first)
        at = end
    return out


def signatures(documents: DataFrame) -> DataFrame:
    """One row per document row: set size, set fingerprint, band keys, minima."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = 0
            for sets in shingle_sets(rows["text"].tolist()):
                full = [i for i, s in enumerate(sets) if len(s)]
                low = minima([sets[i] for i in full])
                keys = mix64((low.reshape(-1, BANDS, ROWS) * _BAND).sum(2) + _BAND_NO).view(np.int64)
                marks = mix64(low).astype(np.uint8)  # equal minima agree, others do 1 time in 256
                where = dict(zip(full, range(len(full)), strict=True))
                lo = [int(mix64(s).sum().astype(np.int64)) if len(s) else 0 for s in sets]
                hi = [int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)) if len(s) else 0 for s in sets]
                yield pd.DataFrame(
                    {
                        "doc_id": rows["doc_id"].iloc[at : at + len(sets)].array,
                        "row_key": rows["row_key"].iloc[at : at + len(sets)].array,
                        "n_shingles": [len(s) for s in sets],
                        "set_lo": lo,
                        "set_hi": hi,
                        "bands": [keys[where[i]] if i in where else None for i in range(len(sets))],
                        "minima": [marks[where[i]].tobytes() if i in where else None for i in range(len(sets))],
                    }
                )
                at += len(sets)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key")).mapInPandas(sign, _SIG)


@F.pandas_udf(DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of hashes on which two documents agree."""
    return pd.Series([float((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean()) for x, y in zip(a, b, strict=True)], dtype="float64")


def _full_sets(documents: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """Full shingle sets, as bytes, of the classes in ``wanted`` (rep), from one row of each."""

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for rows in batches:
            at = 0
            for sets in shingle_sets(rows["text"].tolist()):
                reps = rows["rep"].iloc[at : at + len(sets)].tolist()
                at += len(sets)
                new = [(r, s) for r, s in zip(reps, sets, strict=True) if r not in seen and not seen.add(r)]
                if len(seen) > SEEN_SETS:
                    seen.clear()
                yield pd.DataFrame({"rep": [r for r, _ in new], "members": [s.tobytes() for _, s in new]})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64("text"))
    rows = classes.join(wanted.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("first_id").alias("doc_id"), "row_key")
    found = texts.join(rows, ["doc_id", "row_key"]).select("rep", "text").mapInPandas(sets_of, "rep long, members binary")
    return found.dropDuplicates(["rep"])  # rows that repeat id and text


def _confirm(pairs: DataFrame, sets: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    need, of = limit

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keep = []
            for x, y in zip(rows["set_a"], rows["set_b"], strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = common(s, t) if of * min(len(s), len(t)) >= need * max(len(s), len(t)) else 0
                keep.append(of * both >= need * (len(s) + len(t) - both))
            yield rows.loc[keep, ["a", "b"]]

    sets_a, sets_b = sets.select(F.col("rep").alias("a"), F.col("members").alias("set_a")), sets.select(F.col("rep").alias("b"), F.col("members").alias("set_b"))
    n_a, n_b = (pairs.groupBy(end).agg(F.count("*").alias("n")) for end in "ab")
    return dealt_join(dealt_join(pairs, sets_a, ["a"], n_a), sets_b, ["b"], n_b).mapInPandas(linked, "a long, b long")


def _likely(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """Drop pairs whose minima and set sizes rule a link out."""
    side = classes.select("rep", "n_shingles", "minima")
    left = side.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("minima").alias("m_a"))
    right = side.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("minima").alias("m_b"))
    n_a, n_b = (pairs.groupBy(end).agg(F.count("*").alias("n")) for end in "ab")
    sized = dealt_join(dealt_join(pairs, left, ["a"], n_a), right, ["b"], n_b).filter(F.lit(LIMIT[1]) * F.least("n_a", "n_b") >= F.lit(LIMIT[0]) * F.greatest("n_a", "n_b"))
    return sized.withColumn("p", _agreement("m_a", "m_b")).filter(F.col("p") >= floor).select("a", "b")


def _across(members: DataFrame, parts: DataFrame, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Buckets with several components: (open members, pairs of small ones, classes of large ones)."""
    placed = members.join(parts, members["rep"] == parts["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
    state = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("p0"), F.max("part").alias("p1")).filter("n > 2 and p0 <> p1").select("key", "n")
    open_ = materialize(dealt_join(placed, state, ["key"], state), "open")
    few = open_.filter(F.col("n") <= small)
    x, y = few.select("key", F.col("rep").alias("a"), F.col("part").alias("pa")), few.select("key", F.col("rep").alias("b"), F.col("part").alias("pb"))
    pairs = x.join(y, "key").filter("a > b and pa <> pb").select("a", "b").distinct()
    return open_, pairs, open_.filter(F.col("n") > small).select("rep", "part").distinct()


def _prefix_pairs(many: DataFrame, sets: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """Pairs that share a shingle among the rarest of both, from different components.

    With ``p = n - ceil(0.75 n) + 1`` rarest shingles of each set, two sets
    that reach the limit share one of them, whatever else they hold.  Their
    first shared shingle, at places i and j of the order, leaves at most
    ``1 + min(n_a - i, n_b - j)`` to share; a pair comes out only where that
    is enough.  Copies with too many edits of their own, whose first places
    are shingles nobody shares, thus meet no one.
    """
    need, of = limit
    words = many.join(sets, "rep").select("rep", "part", F.explode(_as_longs("members")).alias("shingle"))
    rare = words.groupBy("shingle").agg(F.count("*").alias("df"))
    order = Window.partitionBy("rep").orderBy("df", "shingle")
    ranked = dealt_join(words, rare, ["shingle"], rare.withColumnRenamed("df", "n")).withColumn("at", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("rep")))
    head = ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * need / of) + 1).filter("df > 1")
    head = materialize(head.select("shingle", "rep", "part", "n", (F.col("n") - F.col("at")).alias("left")), "prefixes")
    pairs = dealt_pairs(head, ["shingle"], {"rep": "a", "part": "pa", "n": "na", "left": "ra"}, {"rep": "b", "part": "pb", "n": "nb", "left": "rb"})
    enough = F.lit(need + of) * (1 + F.least("ra", "rb")) >= F.lit(need) * (F.col("na") + F.col("nb"))
    fits = (F.lit(of) * F.least("na", "nb") >= F.lit(need) * F.greatest("na", "nb")) & enough
    return pairs.filter((F.col("a") > F.col("b")) & (F.col("pa") != F.col("pb")) & fits).select("a", "b").distinct()


@F.pandas_udf(ArrayType(LongType()))
def _as_longs(members: pd.Series) -> pd.Series:
    return members.map(lambda raw: np.frombuffer(raw, np.int64))


def near_duplicates(documents: DataFrame, limit: tuple[int, int] = LIMIT, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per document row: doc_id, row_key, n_shingles, component_id, kept, set_lo, set_hi.

    Null or empty text, or no words: n_shingles 0, linked with nothing, kept.
    Null doc_id: a component of its own with a null id, kept, and never linked.
    Rows that repeat a doc_id are judged by their own texts.  component_id is the
    smallest doc_id of a component, so components whose smallest id is the same
    share it; of several texts of a component under that id, the one with the
    smallest row_key (hash of the text) is kept.  An empty table gives an empty
    result; other columns are ignored.
    """
    bound_batches(documents.sparkSession)
    known = materialize(signatures(documents), "signatures")
    named = known.filter("doc_id is not null and n_shingles > 0")
    first_row = F.min_by(F.struct("n_shingles", "bands", "minima", "row_key"), F.struct("doc_id", "row_key"))
    classes = materialize(named.groupBy("set_lo", "set_hi").agg(F.min("doc_id").alias("first_id"), first_row.alias("x")).select("set_lo", "set_hi", "first_id", F.col("first_id").alias("rep"), "x.*"), "classes")
    shared = materialize(classes.groupBy("first_id").agg(F.count("*").alias("n"), F.min(F.struct("set_lo", "set_hi")).alias("own")).filter("n > 1").select("first_id", "own"), "shared")
    unique = shared.isEmpty()
    if not unique:  # a class needs a name of its own where one id has several texts
        other = F.col("own").isNotNull() & (F.struct("set_lo", "set_hi") != F.col("own"))
        classes = materialize(classes.join(shared, "first_id", "left").withColumn("rep", F.when(other, F.xxhash64("set_lo", "set_hi")).otherwise(F.col("rep"))).drop("own"), "classes")
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = materialize(dealt_join(keyed, hubs.select("key", "hub"), ["key"], hubs.select("key", "n")).select("key", "rep", "hub"), "buckets")
    stars = materialize(members.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    first = materialize(_likely(stars, classes, ESTIMATE_FLOOR), "pairs")
    sets = materialize(_full_sets(documents, first.select(F.col("a").alias("rep")).unionByName(first.select(F.col("b").alias("rep"))).unionByName(_inner_members(members)), classes), "sets")
    links = materialize(_confirm(first, sets, limit), "links")
    parts = materialize(connected_components(links), "parts")
    open_, few, many = _across(members, parts, small_bucket)
    more = few
    if not many.isEmpty():
        more = few.unionByName(_prefix_pairs(materialize(many, "many"), sets, limit)).distinct()
    more = materialize(more.join(first, ["a", "b"], "left_anti"), "more")  # read five times below: a driver holds each copy of its plan
    tested = materialize(_likely(more, classes, ESTIMATE_FLOOR), "pairs")
    if not tested.isEmpty():
        parts = materialize(connected_components(links.unionByName(_confirm(tested, sets, limit))), "parts")
    for table in (members, stars, first, open_, more, tested, sets, links):  # what follows reads none of them
        discard(table)
    own = classes.select("rep", "set_lo", "set_hi", "first_id", F.col("row_key").alias("kept_key"))
    label = own.join(parts, own["rep"] == parts["node"], "left").withColumn("component", F.coalesce("component", "rep"))
    if not unique:  # names of classes aren't ids
        winner = label.groupBy("component").agg(F.min(F.struct("first_id", "kept_key")).alias("w")).select("component", "w.*")
        label = label.drop("first_id", "kept_key").join(winner, "component").withColumn("component", F.col("first_id"))
    names = ["set_lo", "set_hi"]
    found = label.select(*names, "component", "kept_key")
    out = dealt_join(known.select("doc_id", "row_key", "n_shingles", *names), found, names, how="left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    kept = ~linked | ((F.col("doc_id") == F.col("component")) & (F.col("row_key") == F.col("kept_key")))
    result = materialize(out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), kept.alias("kept"), *names), "neardup")
    for table in (known, classes, shared, parts):
        discard(table)
    return result


def _inner_members(members: DataFrame) -> DataFrame:
    """Classes in buckets of three and more, which step 4 may compare with each other."""
    size = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 2").select("key")
    return members.join(size, "key", "left_semi").select("rep")


def kept_documents(documents: DataFrame) -> DataFrame:
    """One document of each group: that with the smallest id, then text hash, with its columns.

    Documents without words and without an id all stay.  Of rows that repeat
    both id and text one stays.
    """
    found = near_duplicates(documents)
    gone = found.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct()
    rows = packed(documents).withColumn("row_key", F.xxhash64("text"))
    left = rows.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("row_key") == F.col("gone_key")), "left_anti")
    again = documents.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("again_id")).agg(F.count("*").alias("n")).filter("n > 1").select("again_id")
    if not again.isEmpty():
        same = F.col("doc_id") == F.col("again_id")
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return unpacked(left)

"""Quality classifier: random-indexing word vectors and a small network.

1. *Random indexing.*  Every token falls into one of ``BUCKETS`` buckets by its
   hash; a bucket's index vector is sparse, random and fixed.  Over all
   documents, each bucket adds up the index vectors of its tokens' neighbours;
   the sums, damped and scaled to length 1, are the word vectors.  What this
   pass gathers is one table of fixed size, however large the corpus is; words
   that share a bucket share a vector.
2. *Pooling.*  A document is four means over its word vectors: the vectors,
   their spread, and for neighbouring words the distance and the product of
   their vectors, dimension by dimension.  Nothing else about a text is known.
3. *Network.*  Two layers in numpy, trained on a bounded sample of labelled
   rows; a temperature fitted on a part kept from training calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.batches import bound_batches
from kinweave.llm.samples import held_out, training_texts

BUCKETS, DIMS, NONZERO = 1 << 15, 32, 4
#: Labelled rows that teach the network, at most.
SAMPLE_ROWS = 6000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 64, 0.004, 1e-4
PREDICT_FROM = 0.7
N_INPUTS = 4 * DIMS
#: Tokens whose vectors are looked up at a time.
POOL_TOKENS = 1 << 17

_RNG = np.random.Generator(np.random.PCG64(99))
_PLACE = _RNG.integers(0, DIMS, (BUCKETS, NONZERO))
_SIGN = _RNG.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))
_TABLE = _RNG.integers(0, 1 << 64, (32, 256), np.uint64)
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)  # classes of bytes
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[[*range(0x30, 0x3A)]] = _DIGIT


@dataclass
class Tokens:
    """Tokens of a batch of texts: their buckets, and where each text ends."""

    bucket: np.ndarray
    ends: np.ndarray


def tokenize(texts: list[str | None]) -> Tokens:
    """Runs of letters, of digits and of other signs; white space parts them."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    kind = _CLASS[data]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(255)) != 0)
    kinds = kind[edge]
    stops = np.append(edge[1:], len(data))
    real = kinds != _SPACE
    begin, stop = edge[real], stops[real]
    ends = np.searchsorted(begin, np.cumsum([len(r) + 1 for r in raws]))
    if not len(begin):
        return Tokens(np.zeros(0, np.int64), ends)
    lengths = stop - begin
    at = np.flatnonzero(kind != _SPACE)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    value = np.add.reduceat(_TABLE[place & 31, data[at]], first)
    value ^= value >> np.uint64(29)
    return Tokens((value % np.uint64(BUCKETS)).astype(np.int64), ends)


def _batches(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """Texts, whole, some at a time."""
    held: list[str | None] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def neighbour_sums(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """What a batch adds to the context table, and to the bucket counts."""
    b = tokens.bucket
    table = np.zeros(BUCKETS * DIMS)
    if len(b) > 1:
        inside = np.ones(len(b) - 1, bool)  # neighbours in one text
        cuts = tokens.ends[:-1]
        inside[cuts[(cuts > 0) & (cuts < len(b))] - 1] = False
        left, right = b[:-1][inside], b[1:][inside]
        for word, other in ((left, right), (right, left)):
            for k in range(NONZERO):
                table += np.bincount(word * DIMS + _PLACE[other, k], _SIGN[other, k], BUCKETS * DIMS)
    return table.reshape(BUCKETS, DIMS), np.bincount(b, minlength=BUCKETS)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """The word vectors of all buckets, from every document."""

    bound_batches(documents.sparkSession)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, counts = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS, np.int64)
        for rows in batches:
            for texts in _batches(rows["text"].tolist()):
                t, c = neighbour_sums(tokenize(texts))
                table += t
                counts += c
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": used.astype(np.int32), "n": counts[used], "sums": [r.tobytes() for r in table[used].astype("<i4")]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for rows in batches:
            for bucket, n, raw in zip(rows["bucket"], rows["n"], rows["sums"], strict=True):
                held = total.setdefault(bucket, [0, np.zeros(DIMS)])
                held[0] += n
                held[1] += np.frombuffer(raw, "<i4")
        yield pd.DataFrame({"bucket": np.array(list(total), np.int32), "n": [int(v[0]) for v in total.values()], "sums": [v[1].tobytes() for v in total.values()]})

    schema = "bucket int, n long, sums binary"
    rows = documents.select("text").mapInPandas(gather, schema).repartition("bucket").mapInPandas(add, schema).collect()
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for r in rows:  # one row per bucket, BUCKETS at most
        sums = np.frombuffer(r["sums"])
        out[r["bucket"]] = np.sign(sums) * np.log1p(np.abs(sums)) / (1e-9 + np.linalg.norm(np.log1p(np.abs(sums))))
    return out


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """The network's inputs for each text; a text without tokens is all zeros.

    Vectors are summed some tokens at a time, so memory doesn't grow with the
    length of a text.
    """
    t = tokenize(texts)
    counts = np.diff(t.ends, prepend=0)
    owner = np.repeat(np.arange(len(texts)), counts)
    total, square, apart, product = (np.zeros((len(texts), DIMS)) for _ in range(4))
    for a in range(0, len(owner), POOL_TOKENS):
        b = min(len(owner), a + POOL_TOKENS)
        v = vectors[t.bucket[a:b]]
        before = vectors[t.bucket[max(0, a - 1) : b - 1]] if a else np.concatenate([v[:1], v[:-1]])
        first = np.ones(b - a, bool)  # tokens without a neighbour before them in their text
        first[1:] = owner[a + 1 : b] != owner[a : b - 1]
        first[0] = not a or owner[a - 1] != owner[a]
        cuts = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
        whose = owner[a:b][cuts]
        gap, both = np.abs(v - before), v * before
        gap[first], both[first] = 0, 0
        for out, x in ((total, v), (square, v * v), (apart, gap), (product, both)):
            out[whose] += np.add.reduceat(x, cuts, axis=0, dtype=np.float64)
    n = np.maximum(1, counts)[:, None]
    pairs = np.maximum(1, counts - 1)[:, None]
    mean = total / n
    return np.hstack([mean, np.sqrt(np.maximum(0.0, square / n - mean**2)), apart / pairs, product / pairs])


@dataclass
class Network:
    """Two layers, input scaling and the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(0.0, (np.clip((x - self.centre) / self.scale, -8, 8)) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Fit the network on four fifths, its temperature on the rest.

    Without rows, or with one class only, every text scores the share of
    label 1 (one half without rows).
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    centre = x.mean(0) if len(x) else np.zeros(N_INPUTS)
    scale = x.std(0) + 1e-3 if len(x) else np.ones(N_INPUTS)
    net = Network(centre, scale, rng.normal(0, (2 / N_INPUTS) ** 0.5, (N_INPUTS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), 0.0)
    if not len(x) or y.min() == y.max():
        prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        net.w2, net.b2 = np.zeros(HIDDEN), float(np.log(prior / (1 - prior)))
        return net
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    check, fit = order[:cut], order[cut:]
    z = np.clip((x - centre) / scale, -8, 8)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        rng.shuffle(fit)
        rate = RATE * (1 - epoch / EPOCHS) + 1e-5
        for a in range(0, len(fit), BATCH):
            rows = fit[a : a + BATCH]
            h = z[rows] @ params[0] + params[1]
            act = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ params[2] + params[3][0], -30, 30)))
            g = (p - y[rows]) / len(rows)
            back = np.outer(g, params[2]) * (h > 0)
            grads = [z[rows].T @ back + DECAY * params[0], back.sum(0), act.T @ g + DECAY * params[2], np.array([g.sum()])]
            step += 1
            for p_, g_, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g_ - m)
                s += 0.001 * (g_ * g_ - s)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, truth = net.logits(x[check]), y[check]
    losses = {t: float(np.mean(np.logaddexp(0, np.clip(logits / t, -500, 500)) - truth * logits / t)) for t in np.geomspace(0.5, 8, 41)}
    net.temperature = float(min(losses, key=losses.get))
    return net


def fit(documents: DataFrame, labels: DataFrame, vectors: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Train on a bounded sample of labelled rows, pooled on the executors."""

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = [r for texts in _batches(rows["text"].tolist()) for r in pooled(texts, vectors)]
            yield pd.DataFrame({"id": rows["_id"], "y": rows["y"], "x": [r.astype(np.float32).tobytes() for r in x]})

    sample = training_texts(documents, labels, "quality", sample_rows, seed=7).mapInPandas(pool, "id long, y int, x binary")
    rows = sorted(sample.collect())  # sample_rows at most
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(-1, N_INPUTS)
    return train(x, np.array([r["y"] for r in rows], np.float64))


def score_documents(documents: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every document row.

    Null and empty texts score as texts without tokens; a null doc_id is
    carried through and counts as not held out.  Repeated rows score alike;
    other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = 0
            for texts in _batches(rows["text"].tolist()):
                yield pd.DataFrame({"doc_id": rows["doc_id"].iloc[at : at + len(texts)].array, "score": network.scores(pooled(texts, vectors))})
                at += len(texts)

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Word vectors from all documents, a network from the labels, all scores."""
    vectors = word_vectors(documents)
    return score_documents(documents, vectors, fit(documents, labels, vectors))

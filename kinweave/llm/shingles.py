"""Word shingles of whole texts as 64-bit hashes, vectorised over batches.

A word's hash adds one random 64-bit number per (place in the word, byte):
tabulation hashing, which maps different words to the same value with
probability 2**-64.  A shingle's hash mixes its five word hashes with odd
multipliers.  Every step runs over the bytes of many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Places in a word with numbers of their own; longer words reuse them, scaled.
_DEPTH = 64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(0, 1 << 64, (_DEPTH, 256), np.uint64, endpoint=False)
_STEP = _RNG.integers(0, 1 << 64, WIDTH, np.uint64) | np.uint64(1)
_SHORT = _RNG.integers(0, 1 << 64, WIDTH + 1, np.uint64)
_SCALE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a UTF-8 text, A-Z lowered, and where they begin."""
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = ~_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    begin = np.flatnonzero(edge == 1)
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    at = np.flatnonzero(inside)
    lengths = np.append(np.flatnonzero(edge == -1), len(data))[: len(begin)] - begin
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    part = _TABLE[place % _DEPTH, data[at]]
    if lengths.max() > _DEPTH:
        turns = np.full(int(lengths.max()) // _DEPTH + 1, _SCALE)
        turns[0] = 1
        part = part * np.multiply.accumulate(turns)[place // _DEPTH]
    return mix64(np.add.reduceat(part, first)), begin


def shingle_sets(texts: list[str | None], batch_bytes: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text, some texts at a time.

    Fewer words than a shingle has: the whole sequence is one shingle.  No
    words: the empty set.  Texts are taken whole; a batch closes once it holds
    ``batch_bytes`` bytes, so its size is bounded by that and its last text.
    """
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        held.append(raw)
        size += len(raw) + 1
        if size >= batch_bytes:
            yield _sets(held)
            held, size = [], 0
    if held:
        yield _sets(held)


def _sets(raws: list[bytes]) -> list[np.ndarray]:
    hashes, begin = word_hashes(b" ".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    stop = np.searchsorted(begin, ends)
    n = len(hashes)
    if n >= WIDTH:
        grams = sum((hashes[i : n - WIDTH + 1 + i] * _STEP[i] for i in range(1, WIDTH)), hashes[: n - WIDTH + 1] * _STEP[0])
        grams = mix64(grams)
    out, at = [], 0
    for end in stop.tolist():
        words = end - at
        if words >= WIDTH:
            found = np.sort(grams[at : end - WIDTH + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) > 1 else found)
        elif words:
            out.append(mix64((hashes[at:end] * _STEP[:words]).sum(keepdims=True) + _SHORT[words]))
        else:
            out.append(np.zeros(0, np.uint64))
        at = end
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))

"""A wavelet matrix over one shard of token ids, in one compressed file.

File layout (little endian)::

    b"WVM2" | u32 header length | JSON header | sections

The header names each section's offset and length.  Sections are zstd frames:
``doc_ids`` (int64), ``doc_null`` (bits), ``doc_len`` (uint32), ``alphabet``
(uint32: the ids that occur, most frequent first).  Each bit-plane has its
blocks of ``BLOCK_BITS`` bits, one small frame each, where each frame begins
(uint32), and a rank directory: the ones before each block (uint32).  Reading
one token thus decompresses one kilobyte of each plane, and a rank counts the
bits of one block.

Symbols are positions in the alphabet.  Plane 0 holds their highest bit in
document order; each further plane holds the next bit in the order that puts
all zeros of the plane above before its ones, order kept inside each half.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"WVM2"
BLOCK_BITS = 1 << 13
#: Blocks that a reader keeps unpacked.
HELD_BLOCKS = 4096


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def build(ids: np.ndarray, doc_ids: list[int | None], doc_len: np.ndarray) -> bytes:
    """The file of a shard that holds ``ids``, documents one after another."""
    n = len(ids)
    counts = np.bincount(ids, minlength=1)
    alphabet = np.argsort(-counts, kind="stable")[: int(np.count_nonzero(counts))]
    code = np.zeros(len(counts), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    now = code[ids]
    bits = max(1, int(len(alphabet) - 1).bit_length())
    sections: list[tuple[str, bytes]] = [
        ("doc_ids", _pack(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())),
        ("doc_null", _pack(np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes())),
        ("doc_len", _pack(doc_len.astype("<u4").tobytes())),
        ("alphabet", _pack(alphabet.astype("<u4").tobytes())),
    ]
    zeros = []
    pack = zstandard.ZstdCompressor(level=1).compress
    for plane in range(bits):
        ones = (now & now.dtype.type(1 << (bits - 1 - plane))) != 0
        low = now.take(np.flatnonzero(~ones))
        zeros.append(len(low))
        packed = np.packbits(ones).tobytes()
        frames = [pack(packed[b : b + BLOCK_BITS // 8]) for b in range(0, len(packed), BLOCK_BITS // 8)]
        inside = np.add.reduceat(ones, np.arange(0, n, BLOCK_BITS), dtype=np.int64) if n else np.zeros(0, np.int64)
        sections.append((f"p{plane}", b"".join(frames)))
        sections.append((f"o{plane}", np.cumsum([0, *map(len, frames)]).astype("<u4").tobytes()))
        sections.append((f"r{plane}", np.cumsum([0, *inside]).astype("<u4").tobytes()))
        now = np.concatenate([low, now.take(np.flatnonzero(ones))])
    at, where = 0, {}
    for name, raw in sections:
        where[name] = [at, len(raw)]
        at += len(raw)
    header = json.dumps({"tokens": n, "docs": len(doc_len), "bits": bits, "zeros": zeros, "at": where}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *(raw for _, raw in sections)])


class Shard:
    """Reads one file: access, count and occurrence lookup without decoding it all."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = struct.unpack("<I", raw[4:8])[0]
        self._head = json.loads(raw[8 : 8 + size])
        self._body = memoryview(raw)[8 + size :]
        self.n_tokens, self.n_docs, self.bits = self._head["tokens"], self._head["docs"], self._head["bits"]
        self._zeros = self._head["zeros"]
        self._blocks: dict[tuple[int, int], np.ndarray] = {}
        self._rank: dict[int, np.ndarray] = {}
        self._starts: dict[int, np.ndarray] = {}
        self._inflate = zstandard.ZstdDecompressor().decompress
        self._symbols: dict[int, int] | None = None

    def _section(self, name: str) -> bytes:
        at, size = self._head["at"][name]
        return bytes(self._body[at : at + size])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids (None where null) and their token counts, in file order."""
        ids = np.frombuffer(_unpack(self._section("doc_ids")), "<i8")
        null = np.unpackbits(np.frombuffer(_unpack(self._section("doc_null")), np.uint8), count=len(ids))
        return [None if m else int(i) for i, m in zip(ids, null, strict=True)], np.frombuffer(_unpack(self._section("doc_len")), "<u4")

    def alphabet(self) -> np.ndarray:
        return np.frombuffer(_unpack(self._section("alphabet")), "<u4")

    def _frame(self, plane: int, block: int) -> bytes:
        if plane not in self._starts:
            self._starts[plane] = np.frombuffer(self._section(f"o{plane}"), "<u4")
        begin = self._head["at"][f"p{plane}"][0]
        a, b = self._starts[plane][block : block + 2].tolist()
        return self._inflate(self._body[begin + a : begin + b])

    def _block(self, plane: int, block: int) -> np.ndarray:
        found = self._blocks.get((plane, block))
        if found is None:
            count = min(BLOCK_BITS, self.n_tokens - block * BLOCK_BITS)
            found = np.unpackbits(np.frombuffer(self._frame(plane, block), np.uint8), count=count)
            if len(self._blocks) >= HELD_BLOCKS:
                self._blocks.clear()
            self._blocks[plane, block] = found
        return found

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before position i."""
        if plane not in self._rank:
            self._rank[plane] = np.frombuffer(self._section(f"r{plane}"), "<u4")
        block, inside = divmod(i, BLOCK_BITS)
        n = int(self._rank[plane][block])
        return n + int(np.count_nonzero(self._block(plane, block)[:inside])) if inside else n

    def access(self, i: int) -> int:
        """The token id at position i of the shard."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        symbol = 0
        for plane in range(self.bits):
            block, inside = divmod(i, BLOCK_BITS)
            bit = int(self._block(plane, block)[inside])
            ones = self._ones(plane, i)
            i = self._zeros[plane] + ones if bit else i - ones
            symbol = symbol << 1 | bit
        return int(self.alphabet()[symbol])

    def _symbol(self, token: int) -> int | None:
        if self._symbols is None:
            self._symbols = {int(t): s for s, t in enumerate(self.alphabet())}
        return self._symbols.get(token)

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token id in positions lo (inclusive) to hi (exclusive)."""
        symbol, hi = self._symbol(token), self.n_tokens if hi is None else hi
        if symbol is None:
            return 0
        for plane in range(self.bits):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            if symbol >> (self.bits - 1 - plane) & 1:
                lo, hi = self._zeros[plane] + a, self._zeros[plane] + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) zero or one of a plane."""
        self._ones(plane, 0)
        ones = self._rank[plane].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n_tokens) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._block(plane, block) == bit)[k - before[block]])

    def find(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of a token id, or -1."""
        symbol = self._symbol(token)
        if symbol is None or not 0 <= k < self.count(token):
            return -1
        lo = 0
        for plane in range(self.bits):
            ones = self._ones(plane, lo)
            lo = self._zeros[plane] + ones if symbol >> (self.bits - 1 - plane) & 1 else lo - ones
        at = lo + k
        for plane in reversed(range(self.bits)):
            bit = symbol >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - self._zeros[plane] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All token ids of the shard, from the lowest plane up."""
        n = self.n_tokens
        now = np.zeros(n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in reversed(range(self.bits)):
            raw = b"".join(self._frame(plane, b) for b in range(-(-n // BLOCK_BITS)))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).view(bool)
            up = np.empty_like(now)
            up[np.flatnonzero(~ones)] = now[: self._zeros[plane]]
            up[np.flatnonzero(ones)] = now[self._zeros[plane] :] | now.dtype.type(1 << (self.bits - 1 - plane))
            now = up
        return self.alphabet()[now] if n else np.zeros(0, "<u4")

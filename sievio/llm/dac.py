"""Directly addressable codes: integers cut into chunk levels.

Level 0 holds the low bits of every value, level 1 the next bits of those values
that have more, and so on. A continuation bitmap per level says which values go
on; a directory of ranks gives the place of a value in the next level. Any value
is read with one look at each level and no block is ever decoded."""

from __future__ import annotations

import json
import struct

import numpy as np

MAGIC = b"SVDAC001"
CHUNK = 8
BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def dac_levels(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, bitmap, ranks) of each level; the last level's bitmap is all zero."""
    rest, levels = np.ascontiguousarray(values, np.uint32), []
    while True:
        more = rest >> CHUNK
        goes_on = more != 0
        bits = np.packbits(goes_on, bitorder="little")
        per_block = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), BLOCK // 8), dtype=np.uint64) if len(bits) else np.zeros(0, np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(per_block, dtype=np.uint64)])
        levels.append(((rest & 0xFF).astype(np.uint8), bits, ranks))
        rest = more[goes_on]
        if not len(rest):
            return levels


def dac_file(values: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> list[bytes]:
    """A shard file's parts: header, the levels, and a directory of documents (id, end of its values)."""
    levels = dac_levels(values)
    docs = np.array([0 if d is None else d for d in doc_ids], np.int64)
    there = np.array([d is not None for d in doc_ids], np.uint8)
    arrays = [a for level in levels for a in level] + [docs, there, np.asarray(ends, np.uint64)]
    head = json.dumps({"n": int(len(values)), "docs": len(doc_ids), "chunk": CHUNK, "block": BLOCK, "sizes": [int(a.nbytes) for a in arrays]}).encode()
    return [MAGIC, struct.pack("<I", len(head)), head, *(a.tobytes() for a in arrays)]


class DacShard:
    """A shard file: at(i) is value i; slice(a, b) the values from a to b; doc(k) those of the shard's k-th document."""

    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        (size,) = struct.unpack("<I", data[8:12])
        head = json.loads(bytes(data[12 : 12 + size]))
        at, parts = 12 + size, []
        for n in head["sizes"]:
            parts.append(data[at : at + n])
            at += n
        self.n, self.n_docs = head["n"], head["docs"]
        kinds = [np.uint8, np.uint8, np.uint64] * ((len(parts) - 3) // 3)
        arrays = [np.frombuffer(p, k) for p, k in zip(parts, kinds)]
        self.levels = [tuple(arrays[i : i + 3]) for i in range(0, len(arrays), 3)]
        self.doc_ids = np.frombuffer(parts[-3], np.int64)
        self.there = np.frombuffer(parts[-2], np.uint8)
        self.ends = np.frombuffer(parts[-1], np.uint64).astype(np.int64)

    @staticmethod
    def _rank(level, i: int) -> int:
        """Values before place i that go on to the next level."""
        _, bits, ranks = level
        block = i // BLOCK
        first, byte = block * (BLOCK // 8), i // 8
        n = int(ranks[block]) + int(_ONES[bits[first:byte]].sum())
        return n + (bin(int(bits[byte]) & ((1 << (i % 8)) - 1)).count("1") if i % 8 else 0)

    def at(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for level in self.levels:
            value |= int(level[0][i]) << shift
            if not level[1][i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(level, i), shift + CHUNK
        raise ValueError("the last level goes on")

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values a to b, level by level; only their own codes are read."""
        a, b = max(0, a), min(b, self.n)
        out = np.zeros(max(0, b - a), np.uint32)
        where, shift = None, 0
        for level in self.levels:
            if a >= b:
                break
            codes = level[0][a:b].astype(np.uint32) << np.uint32(shift)
            if where is None:
                out |= codes
            else:
                out[where] |= codes
            bits = np.unpackbits(level[1][a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
            on = np.flatnonzero(bits)
            where = on if where is None else where[on]
            a, shift = self._rank(level, a), shift + CHUNK
            b = a + len(on)
        return out

    def doc(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class DacFile:
    """A shard file where it lies: at(i) reads its header once, and for a value a few bytes of each level.

    `read(offset, n)` gives n bytes of the file."""

    def __init__(self, read):
        self.read = read
        if bytes(read(0, 8)) != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        (size,) = struct.unpack("<I", read(8, 4))
        head = json.loads(bytes(read(12, size)))
        self.n, starts = head["n"], np.cumsum([12 + size, *head["sizes"]]).tolist()
        self.levels = [starts[i : i + 3] for i in range(0, len(head["sizes"]) - 3, 3)]

    def at(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for codes, bits, ranks in self.levels:
            value |= self.read(codes + i, 1)[0] << shift
            block, first = i // BLOCK, i // BLOCK * (BLOCK // 8)
            part = self.read(bits + first, i // 8 - first + 1)  # the bitmap from the block's start to the value's byte
            if not part[-1] >> (i % 8) & 1:
                return value
            before = sum(b.bit_count() for b in part[:-1]) + (part[-1] & ((1 << (i % 8)) - 1)).bit_count()
            i, shift = struct.unpack("<Q", self.read(ranks + 8 * block, 8))[0] + before, shift + CHUNK
        raise ValueError("the last level goes on")

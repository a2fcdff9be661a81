"""Operator 6: best-fit decreasing packing of token sequences.

Best fit takes pieces of equal length for each other, so the whole packing follows
from the number of pieces of each length: at most `capacity` counts, however many
documents there are. The driver packs these counts, each step placing as many equal
pieces as fit the tightest open bins; the executors rank the pieces of each length and
look their places up."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import basic, prepare, staged, texts_of
from .encoding import END, encoder

CAPACITY = 4096
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """A segment tree over remaining capacities; the leaf of r says whether a bin with r left is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, left: int, first: int, count: int) -> None:
        """Opens bins first .. first + count - 1, each with `left` remaining."""
        if not left or not count:
            return
        self.ranges.setdefault(left, []).append((first, count))
        i = left + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity >= need that some bin has, in logarithmic time."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None

    def take(self, left: int) -> tuple[int, int]:
        first, count = self.ranges[left].pop()
        if not self.ranges[left]:
            del self.ranges[left]
            i = left + self.size
            self.tree[i] = 0
            while i > 1 and not self.tree[i ^ 1]:
                i //= 2
                self.tree[i] = 0
        return first, count


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first bin, pieces a bin, offset) and the number of bins.

    Pieces of a length, by rank from `first rank`, fill bins from `first bin` on, so many
    to a bin, from `offset`. Each length splits at most one range of equal bins, so there
    are at most a few rows for each length."""
    bins, rows, n_bins = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                per = capacity // length
                first, n = n_bins, -(-left // per)
                n_bins += n
                room = capacity
            else:
                first, n = bins.take(room)
                per = room // length
            rows.append((length, rank, first, per, capacity - room))
            whole = min(n, left // per)
            bins.add(room - per * length, first, whole)
            placed = whole * per
            if whole < n and placed < left:
                bins.add(room - (left - placed) * length, first + whole, 1)
                whole, placed = whole + 1, left
            bins.add(room, first + whole, n - whole)
            rank, left = rank + placed, left - placed
    return np.array(rows, np.int64).reshape(-1, 5), n_bins


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and its rank among the task's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                packed = enc.encode(text) + END
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    own = packed[at : at + 4 * capacity]
                    n = len(own) // 4
                    for c, v in zip(cols, (doc, k, at // 4, n, zlib.crc32(own), seen[n])):
                        c.append(v)
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            cols.insert(5, [part] * len(cols[0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    prepare(docs.sparkSession)
    return basic(docs, "doc_id", "text").mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents in sequences of at most `capacity` ids, as few as best-fit decreasing finds.

    A null text is empty: its piece is the end id alone. Only documents longer than a
    sequence are cut. Repeated rows and equal ids are pieces like any others, a null doc_id
    stays null, other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, vocabulary, capacity), "pieces")
    per = staged(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    # At most `capacity` rows, whatever the input.
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = best_fit_decreasing(counts, capacity)
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    # The counts grow with the number of tasks: they are merged, never broadcast on the word of their packed file size.
    ranked = cut.join(before.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    # The table of places: at most a few rows for each of `capacity` lengths, so its size is bounded.
    table = spark.sparkContext.broadcast(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        if not len(t):
            return
        t = t[np.lexsort((t[:, 1], t[:, 0]))]
        lengths, firsts = t[:, 0], t[:, 1]
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            lo, hi = np.searchsorted(lengths, n), np.searchsorted(lengths, n, "right")
            while True:  # a binary search in each piece's own rows
                open_ = hi - lo > 1
                if not open_.any():
                    break
                mid = (lo + hi) // 2
                right = firsts[np.minimum(mid, len(t) - 1)] <= rank
                lo, hi = np.where(open_ & right, mid, lo), np.where(open_ & ~right, mid, hi)
            _, first, bin_, per_bin, offset = t[lo].T
            k = rank - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bin_ + k // per_bin), pa.array(offset + k % per_bin * n)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PLACED)

"""Operator 8: SimHash near-duplicates, found at the anchors of a covering code.

A fingerprint's 64 bits are cut into blocks. Two fingerprints that differ in at most
`distance` bits differ in at most distance // blocks bits of some block. In each block the
anchors are a covering code: the perfect Hamming code on 15 of its bits, the others free,
so every fingerprint is within 1 of an anchor, its home. Replicated to every anchor within
1 + distance // blocks, it meets each of its partners at the partner's home. Nothing is
missed, and a link counts in the first block in which it can be found."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import basic, join_counted, prepare, staged, texts_of
from .graph import components

DISTANCE = 6
BLOCKS = 4
SEED = 42
#: Seconds for a replica and for a comparison, measured on one core; only their proportion matters.
REPLICA_S, COMPARISON_S = 2e-6, 1.5e-9
#: Fingerprints at home at an anchor, and replicas there, that one cell of the comparison takes; larger anchors are split into a grid of cells.
CELL = (1 << 14, 1 << 16)
_TILE = 1 << 21
_PART = 1 << 16
_xxh = functools.partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's 2-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(words, words[1:]))) if len(words) > 1 else words
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _PART):
        own = shingles[at : at + _PART]
        h = np.fromiter(map(_xxh, own), np.uint64, len(own))
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    prepare(docs.sparkSession)
    return basic(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_widths(blocks: int) -> list[int]:
    if not 1 <= blocks <= 4:
        raise ValueError("1 to 4 blocks: the code needs 15 bits of each")
    return [64 // blocks + (i < 64 % blocks) for i in range(blocks)]


def _syndromes(v: np.ndarray) -> np.ndarray:
    """Of the Hamming code on the low 15 bits: the xor of the places of the ones."""
    s = np.zeros(v.shape, np.uint64)
    for i in range(15):
        s ^= ((v >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s


@functools.lru_cache(maxsize=8)
def _masks(width: int, reach: int) -> list[np.ndarray]:
    """Per syndrome: the bit changes, at most `reach` of them, that lead to an anchor."""
    out: list[list[int]] = [[] for _ in range(16)]
    for w in range(reach + 1):
        for places in combinations(range(width), w):
            syndrome = 0
            for p in places:
                syndrome ^= p + 1 if p < 15 else 0
            out[syndrome].append(sum(1 << p for p in places))
    return [np.array(m, np.uint64) for m in out]


def work(n: int, blocks: int, distance: int = DISTANCE) -> float:
    """Seconds that a fingerprint among n takes, in expectation: replicas that are moved and sorted, and comparisons at its homes."""
    moved = compared = 0.0
    for width in block_widths(blocks):
        each = sum(math.comb(width, w) for w in range(2 + distance // blocks)) / 16  # one change in 16 leads to an anchor
        moved, compared = moved + 1 + each, compared + n * each / 2 ** (width - 4)
    return moved * REPLICA_S + compared * COMPARISON_S


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The number of blocks of least work for n different fingerprints: 4 for up to about 10^8, then 3, then 2. All find the same links."""
    return min((4, 3, 2), key=lambda b: work(n, b, distance))


def anchors(fps: np.ndarray, blocks: int = BLOCKS, distance: int = DISTANCE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: its number, the anchor at home of each fingerprint, and the replicas as (place in fps, anchor)."""
    shift = 0
    for b, width in enumerate(block_widths(blocks)):
        v = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        s = _syndromes(v)
        home = np.where(s > 0, v ^ (np.uint64(1) << (s - np.uint64(1)) % np.uint64(64)), v)
        who, where = [], []
        for k, masks in enumerate(_masks(width, 1 + distance // blocks)):
            own = np.flatnonzero(s == k)
            if len(own) and len(masks):
                who.append(np.repeat(own, len(masks)))
                where.append((v[own][:, None] ^ masks[None, :]).ravel())
        yield b, home, np.concatenate(who) if who else np.zeros(0, np.int64), np.concatenate(where) if where else np.zeros(0, np.uint64)
        shift += width


def _links(home: np.ndarray, others: np.ndarray, b: int, blocks: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the links between home and others whose first block is b."""
    widths, found = block_widths(blocks), []
    step = max(1, _TILE // max(1, len(others)))
    for at in range(0, len(home), step):
        i, j = np.nonzero(np.bitwise_count(home[at : at + step, None] ^ others[None, :]) <= distance)
        if len(i):
            i = i + at
            diff = home[i] ^ others[j]
            keep, shift = diff != 0, 0
            for earlier in range(b):
                mask = np.uint64(((1 << widths[earlier]) - 1) << shift)
                keep &= np.bitwise_count(diff & mask) > distance // blocks
                shift += widths[earlier]
            keep &= np.bitwise_count(diff & np.uint64(((1 << widths[b]) - 1) << shift)) <= distance // blocks
            found.append((i[keep], j[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that join what the links a-b join: one per node, not one per pair."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = where[: len(a)], where[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _compare(batches: Iterator[pa.RecordBatch], blocks: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, fp, n; n < 0 marks a replica) sorted by key and cell: one comparison for each run."""

    def out(fp, add, other):
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(add), pa.array(other.view(np.int64)) if other is not None else pa.nulls(len(fp), pa.int64())], ["fp", "more", "other"])

    def run(key: int, fp: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        b, at_home = key >> 58, n > 0
        home, others, weight = fp[at_home], fp[~at_home], -n[~at_home]
        if not len(home) or not len(others):
            return
        i, j = _links(home, others, b, blocks, distance)
        if len(i):
            more = np.bincount(i, weights=weight[j], minlength=len(home)).astype(np.int64)
            linked = np.flatnonzero(more)
            yield out(home[linked], more[linked], None)
            x, y = forest(home[i], others[j])
            yield out(x, np.zeros(len(x), np.int64), y)

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        key, cell, fp, n = (c.to_numpy() for c in batch.columns)
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(key)]):
            if held and (held[0][0][0], held[0][1][0]) != (key[a], cell[a]):
                yield from run(int(held[0][0][0]), *(np.concatenate([h[k] for h in held]) for k in (2, 3)))
                held = []
            held.append((key[a:b], cell[a:b], fp[a:b], n[a:b]))
    if held and len(held[0][0]):
        yield from run(int(held[0][0][0]), *(np.concatenate([h[k] for h in held]) for k in (2, 3)))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), n_near (other rows linked directly), component_id.

    Rows of equal fingerprint are one node with a count; links between different fingerprints are
    counted at the homes and never listed in pairs. A null or blank text has fingerprint zero and
    links like any other. component_id is the smallest doc_id that is not null (null if there is
    none). Repeated rows count as rows. A text of any length counts whole. An empty table gives no rows; other
    columns are ignored. `blocks` trades replicas for comparisons; by default it follows from the number of
    different fingerprints, as `blocks_for` says. All give the same links."""
    prints = staged(fingerprints(docs), "simhash")
    nodes = staged(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "simhash-nodes")

    blocks = blocks or blocks_for(nodes.count(), distance)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for b, home, _, where in anchors(fps, blocks, distance):
                for role, keys in ((0, home), (1, where)):
                    k, c = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((b << 58) + k.astype(np.int64)), pa.array(np.full(len(k), role, np.int32)), pa.array(c.astype(np.int64))], ["key", "role", "c"])

    # Anchors that fill more than a cell: at most 1 for every CELL rows, each a line of the broadcast plan.
    size = nodes.select("fp").mapInArrow(homes, "key long, role int, c long").groupBy("key").agg(F.sum(F.expr("if(role = 0, c, 0L)")).alias("h"), F.sum(F.expr("if(role = 1, c, 0L)")).alias("r"))
    heavy = {r["key"]: (-(-r["h"] // CELL[0]) or 1, -(-r["r"] // CELL[1]) or 1) for r in size.filter((F.col("h") > CELL[0]) | (F.col("r") > CELL[1])).toLocalIterator()}
    plan = docs.sparkSession.sparkContext.broadcast(heavy)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = plan.value
        split = np.array(sorted(grid), np.int64)
        names = ["key", "cell", "fp", "n"]
        for batch in batches:
            fps, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            mixed = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for b, home, who, where in anchors(fps, blocks, distance):
                for role, at, keys in ((0, np.arange(len(fps)), home), (1, who, where)):
                    key, sign = (b << 58) + keys.astype(np.int64), 1 - 2 * role
                    big = np.isin(key, split) if len(split) else np.zeros(len(key), bool)
                    own = at[~big]
                    yield pa.RecordBatch.from_arrays([pa.array(key[~big]), pa.array(np.zeros(len(own), np.int32)), pa.array(fps[own].view(np.int64)), pa.array(sign * n[own])], names)
                    for k in np.unique(key[big]):
                        gh, gr = grid[int(k)]
                        own = at[key == k]
                        mine = mixed[own] % np.uint64((gh, gr)[role])
                        for copy in range((gr, gh)[role]):
                            cell = mine * np.uint64(gr) + np.uint64(copy) if role == 0 else np.uint64(copy * gr) + mine
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k)), pa.array(cell.astype(np.int32)), pa.array(fps[own].view(np.int64)), pa.array(sign * n[own])], names)

    rows = nodes.select("fp", "n").mapInArrow(spread, "key long, cell int, fp long, n long").repartition("key", "cell").sortWithinPartitions("key", "cell")
    found = staged(rows.mapInArrow(lambda it: _compare(it, blocks, distance), "fp long, more long, other long"), "simhash-links")
    more = found.filter("other is null").groupBy("fp").agg(F.sum("more").alias("more"))
    parts = components(found.filter("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b")), "simhash-components").withColumnRenamed("node", "fp")
    grouped = nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("_rows"))
    table = join_counted(grouped, least, "component", "_rows").join(more, "fp", "left").select("fp", "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"), "component_id")
    return join_counted(prints, staged(table, "simhash-classes"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")

"""Operator 4: exact removal of repeated byte strings by longest previous factors.

Every string of LENGTH bytes belongs to the anchor that its own bytes choose: the GRAM-byte
substring with the least hash. Equal strings have equal anchors, so all copies of a string
meet in its anchor's group, and a group whose anchor occurs once needs no text at all. The
blocks of text of groups are put one after another in the order of the documents, and their
suffixes sorted. The nearest smaller positions before and after a suffix in that order are its
two best earlier matches; the longer of their common prefixes with it is its longest previous
factor. Where that reaches LENGTH, a string starts that was seen before."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import basic, get_file, prepare, put_file, shared_path, staged, texts_of

LENGTH = 100
GRAM = 24
#: Occurrences beyond which an anchor's group is split by the hashes of its whole strings.
HOT = 1 << 16
#: Distinct blocks of a part that are held to send equal ones once.
HELD = 1 << 18
_FRAME = 1 << 20
#: Bytes that are hashed at a time, so that what is held for each of them stays near the core.
_STRETCH = 1 << 16
#: Starts that are looked through together for repeated hashes, and those of them whose factors are.
_POOL, _FACTORS = 1 << 17, 16_000
_PLACE = np.uint64((1 << 26) - 1)
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_BLOCKS = "h long, doc_id long, tie long, part int, ord int, pos long, n int, block binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte substrings, in order."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):  # 8 bytes fit a word exactly
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    n = len(x) - 16
    return _mix(_mix(_mix(x[:n]) + x[8 : 8 + n]) + x[16 : 16 + n])


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are among the values of `ordered`."""
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x if len(ordered) else np.zeros(len(x), bool)


def string_hashes(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Hashes of all substrings of `length` bytes, in order, from those of the GRAM-byte substrings that cover them."""
    n = max(0, len(data) - length + 1)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _STRETCH):
        h = gram_hashes(data[at : at + _STRETCH + length - 1])
        m = min(_STRETCH, n - at)
        own = h[:m]
        for p in [*range(GRAM, length - GRAM, GRAM), length - GRAM]:
            own = _mix(own) + h[p : p + m]
        out[at : at + m] = own
    return out


def anchored(data: np.ndarray, lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts that share an anchor, over documents that lie one after another in data.

    Returns the runs' first starts, their numbers of starts, and the hashes of their anchors."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    runs = []
    for at in range(0, max(0, len(data) - length + 1), _STRETCH):  # long documents are worked on in stretches
        own = data[at : at + _STRETCH + length - 1]
        h = gram_hashes(own)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, span = length - GRAM + 1, 1
        least = key
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = (least & _PLACE).astype(np.int64)
        n = len(own) - length + 1
        anchor = anchor[:n]
        ok = np.ones(n, bool)
        for e in ends[(ends > at) & (ends < at + n + length - 1)] - at:  # strings across a document's end
            ok[max(0, e - length + 1) : e] = False
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new & ok)
        if not len(first):
            continue
        stop = np.flatnonzero(np.concatenate([new | ~ok, [True]]))
        last = stop[np.searchsorted(stop, first, "right")]
        runs.append((first + at, last - first, h[anchor[first]]))
    return tuple(np.concatenate(r) for r in zip(*runs)) if runs else none


def _ranked(key: np.ndarray, bits: int) -> np.ndarray:
    """Ranks from 1 on of keys of so many bits, equal for equal keys."""
    n = len(key)
    place = max(1, n).bit_length()
    if bits + place <= 63:  # keys and places in one word sort without an index
        both = np.sort((key << place) | np.arange(n))
        order, ranked = both & ((1 << place) - 1), both >> place
    else:
        order = np.argsort(key)
        ranked = key[order]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]])) if n else 0
    return out


def suffix_ranks(symbols: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(k, ranks of all suffixes by their first k symbols) for k = 1 and doubling up to `depth` at least, or until all differ."""
    n = len(symbols)
    if n and int(symbols.max()) >= 1 << 30:
        symbols = np.unique(symbols, return_inverse=True)[1]
    ranks, k = [(1, symbols.astype(np.int64) + 1)], 1  # 0 is beyond the end
    bits = int(ranks[0][1].max(initial=1)).bit_length()
    while k < depth and (k == 1 or int(ranks[-1][1].max(initial=0)) < n):
        last = ranks[-1][1]
        if k == 1:  # as many symbols as fit a word are one key
            k, key = 4 if bits <= 15 else 2, np.zeros(n, np.int64)
            for step in range(k):
                key <<= bits
                key[: max(0, n - step)] |= last[step:]
            bits *= k
        else:
            bits = int(last.max(initial=1)).bit_length()
            key = last << bits
            key[: max(0, n - k)] |= last[k:]
            k, bits = 2 * k, 2 * bits
        ranks.append((k, _ranked(key, bits)))
    return ranks


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 for none: minima of doubling ranges, then down from the widest."""
    n = len(values)
    least, span = [values], 1
    while 2 * span <= n:
        last = least[-1]
        least.append(np.minimum(last[:-span], last[span:]))  # least[j][i]: of values[i : i + 2^j]
        span *= 2
    end = np.arange(n)  # everything from end on, up to the place, is known not to be smaller
    for j in range(len(least) - 1, -1, -1):
        start = end - (1 << j)
        ok = start >= 0
        ok[ok] = least[j][start[ok]] >= values[ok]
        end = np.where(ok, start, end)
    return end - 1


def _common(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, as far as ranks go; 0 where b is negative."""
    n = len(ranks[0][1])
    at, to = a.copy(), np.where(b < 0, n, b)
    for k, rank in [*reversed(ranks), *ranks[:1] * (ranks[min(1, len(ranks) - 1)][0] - 2)]:
        here = np.append(rank, -1)[at] == np.append(rank, -2)[to]  # the ends differ from all, and from each other
        at += k * here
        to += k * here
    return at - a


def longest_previous_factors(symbols: np.ndarray, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """For each position the length, at most `depth`, of the longest prefix of its suffix that also starts earlier.

    In suffix order, ties of `depth` symbols by position, the nearest smaller positions on both sides
    share the longest prefixes with it that any earlier position does. With `starts`, in ascending order,
    only these positions count, both as starts and as earlier starts."""
    ranks = suffix_ranks(symbols, depth)
    starts = np.arange(len(symbols)) if starts is None else starts
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    place = np.argsort(ranks[-1][1][starts], kind="stable")
    before = _nearest_smaller(place)
    after = n - 1 - _nearest_smaller(place[::-1])[::-1]
    order = starts[place]
    known = np.append(order, -1)
    lpf = np.maximum(_common(ranks, order, known[before]), _common(ranks, order, known[np.where(after < n, after, n)]))
    out = np.empty(n, np.int64)
    out[place] = np.minimum(lpf, depth)
    return out


def _write_frame(doc_ids: list, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = b"".join(texts)
    packed = zstandard.ZstdCompressor(level=1).compress(joined)
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    there = np.array([d is not None for d in doc_ids], np.uint8)
    tie = np.array([zlib.crc32(t) for t in texts], np.uint32)
    return struct.pack("<QQQ", len(texts), len(packed), len(joined)) + ids.tobytes() + there.tobytes() + tie.tobytes() + lengths.tobytes() + packed, np.frombuffer(joined, np.uint8), lengths


def _frames(uri: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first document, ids, whether there is an id, hashes of the texts, lengths, bytes) of each frame of a part."""
    raw, at, first = memoryview(get_file(uri)), 0, 0
    while at < len(raw):
        n, size, whole = struct.unpack("<QQQ", raw[at : at + 24])
        at += 24
        ids = np.frombuffer(raw[at : at + 8 * n], np.int64)
        there = np.frombuffer(raw[at + 8 * n : at + 9 * n], np.uint8)
        tie = np.frombuffer(raw[at + 9 * n : at + 13 * n], np.uint32)
        lengths = np.frombuffer(raw[at + 13 * n : at + 21 * n], np.int64)
        at += 21 * n
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[at : at + size], max_output_size=whole) if whole else b"", np.uint8)
        yield first, ids, there, tie, lengths, data
        at, first = at + size, first + n


def _by_part(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each part; the batches are sorted by part."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        parts = batch.column(batch.schema.get_field_index(column)).to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and parts[a] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = int(parts[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, without the bytes of strings seen before.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller
    doc_id (null before all; rows of equal id by the crc32 of their texts), or earlier in the same
    row. Overlaps count, strings never cross rows and are judged on the input. A null text is
    empty; a text of any length is worked on in stretches; an empty table gives no rows; other
    columns are ignored.

    The texts lie, compressed, in one file for each part of the scan in the shared folder; all
    that is shuffled are the hashes of anchors, each at most once from a part, and the bytes of
    those strings whose anchor is repeated, equal blocks once from a part as far as HELD goes. No
    group is larger than HOT blocks: that of a commoner anchor is split by whole strings."""
    spark = prepare(docs.sparkSession)
    folder = shared_path(spark, "texts")
    place = f"{folder}/part-%07d"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        frames, hashes, ids, texts, size = [], [], [], [], 0

        def close() -> None:
            nonlocal ids, texts, size
            frame, data, lengths = _write_frame(ids, texts)
            frames.append(frame)
            hashes.append(anchored(data, lengths, length)[2])
            ids, texts, size = [], [], 0

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                raw = t.encode("utf-8", "surrogatepass")
                ids.append(d)
                texts.append(raw)
                size += len(raw)
                if size >= _FRAME:
                    close()
        if ids:
            close()
        if not frames:
            return
        put_file(place % part, frames)
        h, n = np.unique(np.concatenate(hashes), return_counts=True)
        names = ["h", "part", "times"]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([0])], names)
        for a in range(0, len(h), 50_000):
            own = h[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), part, np.int32)), pa.array(n[a : a + 50_000])], names)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors that occur again in their part, or in another, and whether they are hot; and a null for each part."""
        rows = list(batches)
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        null = t.column(0).combine_chunks().is_null().to_numpy(zero_copy_only=False)
        h = t.column(0).combine_chunks().fill_null(0).to_numpy()
        part, times = t.column(1).to_numpy(), t.column(2).to_numpy()
        where = np.unique(h, return_inverse=True)[1]
        n = np.bincount(where, weights=times)[where]
        keep = (n > 1) | null
        for a in range(0, int(keep.sum()), 50_000):
            i = np.flatnonzero(keep)[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[i]), pa.array(h[i], mask=null[i]), pa.array(n[i] > HOT)], ["part", "h", "hot"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings of repeated anchors, equal blocks once; rows without block are copies within the part."""
        for part, table in _by_part(batches, "part"):
            known = table.column("h").combine_chunks()
            real = known.is_valid().to_numpy(zero_copy_only=False)
            wanted = known.fill_null(0).to_numpy().view(np.uint64)[real]
            hot = np.unique(wanted[table.column("hot").combine_chunks().to_numpy(zero_copy_only=False)[real]])
            wanted = np.unique(wanted)
            first: dict[bytes, tuple] = {}
            out: list[tuple] = [(None, None, 0, part, 0, 0, 0, None)]
            for start, ids, there, tie, lengths, data in _frames(place % part) if len(wanted) else ():
                at, n, h = anchored(data, lengths, length)
                i = np.flatnonzero(_among(h, wanted))
                at, n, h = at[i], n[i], h[i]
                raw = data.tobytes()
                split = _among(h, hot)
                if split.any():  # each string of a hot anchor is a block of its own, in the group of its own hash
                    many = np.where(split, n, 1)
                    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    at, n, h, split = np.repeat(at, many) + within, np.repeat(np.where(split, 1, n), many), np.repeat(h, many), np.repeat(split, many)
                    h[split] = [xxhash.xxh64_intdigest(raw[p : p + length]) for p in at[split].tolist()]
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, at, "right")
                begin = ends[doc] - lengths[doc]
                for p, m, g, d, b in zip(at.tolist(), n.tolist(), h.view(np.int64).tolist(), doc.tolist(), begin.tolist()):
                    block = raw[p : p + m + length - 1]
                    row = (int(there[d]), int(ids[d]), int(tie[d]), part, start + d, p - b, m, g)
                    old = first.get(block)
                    if old is None:
                        first[block] = row
                    else:
                        if row < old:
                            first[block], row = row, old
                        out.append((None, None, 0, part, row[4], row[5], row[6], None))
                        if len(out) >= 20_000:
                            yield _rows(out)
                            out = []
                if len(first) > HELD:
                    yield from _firsts(first)
                    first = {}
            if out:
                yield _rows(out)
            yield from _firsts(first)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs (part, ord, pos, n) of starts of strings that start earlier, too; rows without block pass."""
        found: list[tuple] = []
        pool: list[tuple] = []
        group: list[tuple] = []
        pooled, now = 0, None

        def out() -> pa.RecordBatch:
            cols = list(zip(*found))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32()))], ["part", "ord", "pos", "n"])

        def close() -> None:
            """Of equal blocks the first stays, which holds the factors of all strings of the others; different blocks of the anchor go to the pool."""
            nonlocal pooled
            group.sort(key=lambda r: r[1:7])
            first: dict[bytes, tuple] = {}
            for r in group:
                if first.setdefault(r[8], r) is not r:
                    found.append(r[4:8])
            group.clear()
            if len(first) > 1:
                pool.extend(first.values())
                pooled += sum(r[7] for r in first.values())
            if pooled >= _POOL:
                flush()

        def flush() -> None:
            nonlocal pooled
            found.extend(_pool_copies(pool, length))
            pool.clear()
            pooled = 0

        # The rows come sorted by anchor: one anchor's blocks, and the pool, are all that is held.
        names = ["part", "ord", "pos", "n"]
        for batch in batches:
            there = batch.column(7).is_valid()
            known = batch.filter(pc.invert(there))
            if known.num_rows:
                yield known.select(names)
            for h, doc_id, tie, part, number, pos, n, block in zip(*(c.to_pylist() for c in batch.filter(there).columns)):
                if h != now:
                    close()
                    now = h
                group.append((h, doc_id is not None, doc_id or 0, tie, part, number, pos, n, block))
                if len(found) >= 50_000:
                    yield out()
        close()
        if pool:
            flush()
        if found:
            yield out()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in _by_part(batches, "part"):
            number, pos, n = (table.column(c).to_numpy() for c in ("ord", "pos", "n"))
            order = np.argsort(number, kind="stable")
            number, pos, n = number[order], pos[order], n[order]
            for start, ids, there, _, lengths, data in _frames(place % part):
                ends = np.cumsum(lengths)
                begins = ends - lengths
                a, b = np.searchsorted(number, [start, start + len(ids)])
                delta = np.zeros(len(data) + 1, np.int32)
                real = n[a:b] > 0
                p = begins[number[a:b][real] - start] + pos[a:b][real]
                np.add.at(delta, p, 1)
                np.add.at(delta, p + n[a:b][real] + length - 1, -1)
                gone = np.cumsum(delta[:-1]) > 0
                rises = gone.copy()
                rises[1:] &= ~gone[:-1]
                rises[begins[lengths > 0]] = gone[begins[lengths > 0]]
                total = np.concatenate([[0], np.cumsum(gone)])
                spans = np.concatenate([[0], np.cumsum(rises)])
                sha = [hashlib.sha256(data[x:y].tobytes() if total[x] == total[y] else data[x:y][~gone[x:y]].tobytes()).hexdigest() for x, y in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=there == 0), pa.array(lengths), pa.array(total[ends] - total[begins]), pa.array(spans[ends] - spans[begins]), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                )

    hashes = basic(docs, "doc_id", "text").mapInArrow(split, "h long, part int, times long")
    # Nulls mark the parts; they are spread like any hash.
    again = staged(hashes.repartition(F.coalesce("h", F.col("part").cast("long"))).mapInArrow(repeated, "part int, h long, hot boolean"), "repeated-anchors")
    # One task for each part: what it reads again is its text, however little it is told.
    parts = (again.filter("h is null").agg(F.max("part")).first()[0] or 0) + 1
    shared = again.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(blocks, _BLOCKS)
    runs = shared.repartition(F.coalesce("h", F.xxhash64("part", "ord", "pos"))).sortWithinPartitions("h").mapInArrow(copies, "part int, ord int, pos long, n int")
    return staged(runs, "copies").repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(cut, _OUT)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["h", "doc_id", "tie", "part", "ord", "pos", "n", "block"])


def _firsts(first: dict[bytes, tuple]) -> Iterator[pa.RecordBatch]:
    rows = [(g, doc_id if is_there else None, tie, part, number, pos, m, block) for block, (is_there, doc_id, tie, part, number, pos, m, g) in first.items()]
    for a in range(0, len(rows), 20_000):
        yield _rows(rows[a : a + 20_000])


def _pool_copies(pool: list[tuple], length: int) -> list[tuple]:
    """Runs of string starts in the blocks of the pool whose longest previous factor reaches `length`.

    Equal strings have equal hashes, so a string whose hash is the only one in the pool has no such factor: only the
    others' starts are looked at, in the order that they have."""
    pool.sort(key=lambda r: r[1:7])
    n = np.array([r[7] for r in pool])
    sizes = n + length - 1
    data = np.frombuffer(b"".join(r[8] for r in pool), np.uint8)
    ends = np.cumsum(n)
    starts = np.repeat(np.cumsum(sizes) - sizes - (ends - n), n) + np.arange(n.sum())
    h = string_hashes(data, length)[starts]
    ordered = np.sort(h)
    again = _among(h, np.unique(ordered[1:][ordered[1:] == ordered[:-1]]))
    out: list[tuple] = []
    for r, f, m in _runs(again, ends):
        g, is_there, doc_id, tie, part, number, pos, _, block = pool[r]
        out.append((g, is_there, doc_id, tie, part, number, pos + f, m, block[f : f + m + length - 1]))
    # Equal strings are in one group, so groups can be worked on a few at a time.
    out.sort(key=lambda r: r[:7])
    found: list[tuple] = []
    own: list[tuple] = []
    size = 0
    for r in out:
        if size >= _FACTORS and r[0] != own[-1][0]:
            found += _factors(own, length)
            own, size = [], 0
        own.append(r)
        size += r[7]
    return found + _factors(own, length) if own else found


def _runs(marked: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first place in it, length) of the runs of marked places, rows ending at `ends`."""
    begins = np.zeros(len(marked), bool)
    begins[0] = True
    begins[ends[:-1]] = True
    first = np.flatnonzero(marked & (begins | ~np.concatenate([[False], marked[:-1]])))
    stop = np.flatnonzero(np.concatenate([~marked | begins, [True]]))
    last = stop[np.searchsorted(stop, first, "right")]
    row = np.searchsorted(ends, first, "right")
    start = np.concatenate([[0], ends[:-1]])[row]
    return zip(row.tolist(), (first - start).tolist(), (last - first).tolist())


def _factors(pool: list[tuple], length: int) -> list[tuple]:
    """Of the blocks, in order, the runs of string starts whose longest previous factor among them reaches `length`.

    A string ends within its block, so none of its symbols, nor of those equal to them, is the one that ends blocks."""
    n = np.array([r[7] for r in pool])
    sizes = n + length  # with the end symbol
    data = np.frombuffer(b"".join(r[8] + b"\0" for r in pool), np.uint8)
    stops = np.cumsum(sizes) - 1
    used = np.bincount(data, minlength=256) > 0
    symbols = np.cumsum(used)[data]  # few bits each; from 1 on
    symbols[stops] = 0
    starts = np.repeat(stops + 1 - sizes - (np.cumsum(n) - n), n) + np.arange(n.sum())
    previous = longest_previous_factors(symbols, length, starts) >= length
    return [(pool[r][4], pool[r][5], pool[r][6] + f, m) for r, f, m in _runs(previous, np.cumsum(n))]

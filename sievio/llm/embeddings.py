"""Operator 3: near-duplicate vectors by a robust-pruned flat graph.

Vectors of a label go to overlapping cells, and cells that are too large to smaller ones
within them, level by level. In each, small overlapping clusters are linked by robust
pruning; the union of their adjacency lists is one flat graph. A greedy search from the
clusters' medoids leads to each vector's surroundings, and from there all that is within
range is visited. Every link is verified in double precision."""

from __future__ import annotations

import math
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_file, join_counted, prepare, put_file, shared_path, staged
from .graph import components
from .simhash import forest

COSINE = 0.98
#: Vectors that a cell aims at, and beyond which it is divided; a group of near copies, which can't be, is compared in blocks.
CELL, CELL_MOST = 16_384, 65_536
#: Medoids of cells: of the first level, for all labels together, a hashed sample that the driver gathers and broadcasts;
#: of a cell that is divided, in a file of its own.
PIVOTS, PIVOTS_WITHIN = 16_384, 4_096
#: Times that cells are divided: with the first level, room for some 10^15 vectors.
LEVELS = 2
#: A vector also goes to the cells whose medoid is less similar than the nearest by at most so much.
MARGIN, CELLS_LEAST, CELLS_MOST = 0.1, 2, 6
#: Of the graph: members of a cluster, clusters of a vector, candidates, neighbours kept, slack of the pruning, beam.
CLUSTER, OVERLAP, CANDIDATES, DEGREE, ALPHA, BEAM = 256, 3, 32, 12, 1.2, 16
_BLOCK = 512


def robust_prune(sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, candidates: int = CANDIDATES) -> np.ndarray:
    """Neighbours (places, -1 for none) of each vector of a cluster, given their cosines.

    All vectors choose at once: each round takes the closest candidate left and drops those
    that it is closer to, by alpha, than the vector is."""
    n = len(sims)
    if n < 2:
        return np.full((n, 1), -1)
    c = min(candidates, n - 1)
    own = sims.copy()
    np.fill_diagonal(own, -np.inf)
    near = np.argpartition(-own, c - 1, axis=1)[:, :c]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(own, near, 1), axis=1, kind="stable"), 1)
    dist = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(own, near, 1)))
    alive = np.ones((n, c), bool)
    out = np.full((n, degree), -1)
    every = np.arange(n)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[every, first]
        if not some.any():
            break
        chosen = near[every, first]
        out[some, k] = chosen[some]
        between = np.sqrt(np.maximum(0, 2 - 2 * sims[chosen[:, None], near]))
        alive &= alpha * between > dist
        alive[every, first] = False
    return out


def flat_graph(V: np.ndarray) -> tuple:
    """(adjacency, -1 for none; all of it as starts and neighbours; medoids; cosines of all vectors with the medoids)."""
    n = len(V)
    m = max(1, -(-n // CLUSTER))
    medoids = np.unique(np.linspace(0, n - 1, m).astype(np.int64))
    sims = V @ V[medoids].T
    k = min(OVERLAP, len(medoids))
    nearest = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(medoids) else np.tile(np.arange(len(medoids)), (n, 1))
    lists: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(len(medoids)):
        members = np.flatnonzero((nearest == c).any(axis=1))
        for at in range(0, len(members), 4 * CLUSTER):  # a cluster of near copies may be any size: it is linked in pieces that share their first members
            own = np.unique(np.concatenate([members[:DEGREE], members[at : at + 4 * CLUSTER]]))
            kept = robust_prune(V[own] @ V[own].T)
            i, j = np.nonzero(kept >= 0)
            lists.append((own[i], own[kept[i, j]]))
    a = np.concatenate([x for x, _ in lists])
    b = np.concatenate([y for _, y in lists])
    code = np.unique(np.concatenate([a * n + b, b * n + a]))  # both ways
    a, b = code // n, code % n
    degree = np.bincount(a, minlength=n)
    starts = np.concatenate([[0], np.cumsum(degree)])
    # The beam looks at the first neighbours of a hub only; the range search follows all.
    width = max(1, min(2 * DEGREE, int(degree.max()) if n else 1))
    adjacency = np.full((n, width), -1)
    place = np.arange(len(a)) - starts[a]
    fits = place < width
    adjacency[a[fits], place[fits]] = b[fits]
    return adjacency, (starts, b), medoids, sims


def searched(V: np.ndarray, queries: np.ndarray, graph, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of links (query, other) of at least that cosine, as far as the graph leads to them."""
    adjacency, (starts, ends), medoids, to_medoids = graph
    n = len(V)
    for at in range(0, len(queries), _BLOCK):
        q = queries[at : at + _BLOCK]
        Q, rows = V[q], np.arange(len(q))
        beam = min(BEAM, n)
        start = np.argsort(-to_medoids[q], axis=1)[:, :beam]
        ids = np.full((len(q), beam), -1)
        ids[:, : start.shape[1]] = medoids[start]
        sim = np.full((len(q), beam), -np.inf)
        sim[:, : start.shape[1]] = np.take_along_axis(to_medoids[q], start, 1)
        done = ids < 0
        for _ in range(4 * beam):
            todo = np.where(done, -np.inf, sim)
            best = todo.argmax(axis=1)
            if not np.isfinite(todo[rows, best]).any():
                break
            done[rows, best] = True
            near = adjacency[np.maximum(ids[rows, best], 0)]
            near = np.where((ids[rows, best] >= 0)[:, None], near, -1)
            new = np.einsum("qd,qrd->qr", Q, V[np.maximum(near, 0)])
            new[(near < 0) | (near[:, :, None] == ids[:, None, :]).any(axis=2)] = -np.inf
            all_ids, all_sim, all_done = np.hstack([ids, near]), np.hstack([sim, new]), np.hstack([done, np.zeros_like(near, bool)])
            top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            ids, sim, done = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sim, all_done))
            done |= ~np.isfinite(sim)
        seen = np.zeros((len(q), n), bool)
        seen[rows, q] = True
        i, j = np.nonzero((sim >= cosine) & (ids >= 0))
        code = np.unique(np.concatenate([rows * n + q, i * n + ids[i, j]]))
        i, j = code // n, code % n
        fresh = ~seen[i, j]
        seen[i, j] = True
        hits = [(i[fresh], j[fresh])]
        while len(i):  # from all in range to all in range beside them
            degree = starts[j + 1] - starts[j]
            last = np.cumsum(degree)
            near = ends[np.arange(last[-1]) - np.repeat(last - degree - starts[j], degree)]
            code = np.unique(np.repeat(i, degree) * n + near)
            i, j = code // n, code % n
            fresh = ~seen[i, j]
            i, j = i[fresh], j[fresh]
            seen[i, j] = True
            within = np.concatenate([np.einsum("kd,kd->k", Q[i[x : x + 65536]], V[j[x : x + 65536]]) for x in range(0, len(i), 65536)]) >= cosine if len(i) else np.zeros(0, bool)
            i, j = i[within], j[within]
            hits.append((i, j))
        i, j = (np.concatenate(x) for x in zip(*hits))
        yield q[i], j


def _blockwise(V: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(a), _BLOCK):
        i, j = np.nonzero(V[a[at : at + _BLOCK]] @ V[b].T >= cosine)
        i, j = a[at : at + _BLOCK][i], b[j]
        yield i[i != j], j[i != j]


def _unit(raw: list[bytes]) -> np.ndarray:
    V = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return V / np.sqrt((V * V).sum(axis=1))[:, None]


def _apart(raw: list[bytes], most: float = 0.9) -> np.ndarray:
    """Medoids of which no two are alike: a large group of near copies then has one cell, not a part of many."""
    V = _unit(raw)
    kept: list[int] = []
    for i in range(len(V)):
        if not kept or (V[kept] @ V[i]).max() < most:
            kept.append(i)
    return V[kept]


def _prepared(table: DataFrame) -> DataFrame:
    """vec_id, row, key (label and vector, hashed; null for a vector that links with nothing), label, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.array(v, np.float64) + 0.0 if v and label is not None and None not in v else None
                if x is None or not np.isfinite(x).all() or not x.any():
                    keys.append(None)
                    vecs.append(None)
                else:
                    x = x / np.abs(x).max()  # no overflow in the norm
                    keys.append(xxhash.xxh3_128_digest(f"{label}:".encode() + np.array(v, np.float64).tobytes()))
                    vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "label", "key", "vec"])

    prepare(table.sparkSession)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).mapInArrow(run, "vec_id long, label string, key binary, vec binary")
    return rows.withColumn("row", F.monotonically_increasing_id())


def _nearest(V: np.ndarray, medoids: np.ndarray) -> list[list[int]]:
    """Of each vector the medoids of its cells, the nearest first."""
    sims = V @ medoids.T
    c = min(CELLS_MOST, sims.shape[1])
    order = np.argpartition(-sims, c - 1, axis=1)[:, :c]
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(sims, order, 1), axis=1, kind="stable"), 1)
    top = np.take_along_axis(sims, order, 1)
    near = (top[:, :1] - top <= MARGIN) | (np.arange(c) < CELLS_LEAST)
    return [o[k].tolist() for o, k in zip(order, near)]


_ROW = "group string, node long, n long, vec binary, cell long, home boolean"
_ROW_NAMES = ["group", "node", "n", "vec", "cell", "home"]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The stretches of a sorted batch with equal group and cell."""
    keys = list(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], batch.slice(start, i - start)
            start = i


def _divided(rows: DataFrame, heavy: dict[tuple[str, int], int], level: int) -> DataFrame:
    """rows (a vector in a cell each), in which each heavy cell is replaced by cells around medoids of its own.

    A cell's medoids are a hashed sample of it, at most PIVOTS_WITHIN, of which no two are alike. They lie in a
    file for each cell; nothing is broadcast but the heavy cells' sizes, one for every CELL_MOST rows at most.
    A cell with a single medoid, of near copies, stays as it is."""
    spark = rows.sparkSession
    folder, sizes = shared_path(spark, "medoids"), spark.sparkContext.broadcast(heavy)

    def place(key: tuple[str, int]) -> str:
        return f"{folder}/{xxhash.xxh3_128_hexdigest(f'{key[0]}:{key[1]}')}"

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, cells = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            u = [xxhash.xxh64_intdigest(f"{level}:{x}") / 2.0**64 for x in batch.column(1).to_pylist()]
            yield batch.filter(pa.array([u[i] < min(4.0 / CELL, PIVOTS_WITHIN / sizes.value[k]) if (k := (g, c)) in sizes.value else False for i, (g, c) in enumerate(zip(groups, cells))]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> None:
            if now is not None:
                out = BytesIO()
                np.save(out, _apart([bytes(v) for v in sorted(held)]))
                put_file(place(now), [out.getvalue()])

        for batch in batches:
            for key, own in _runs(batch):
                if key != now:
                    close()
                    now, held = key, []
                held += own.column(3).to_pylist()
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    ordered = lambda df: df.repartition("group", "cell").sortWithinPartitions("group", "cell")
    ordered(rows.mapInArrow(choose, _ROW)).mapInArrow(write, "n long").agg(F.sum("n")).collect()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], np.ndarray | None] = {}
        for batch in batches:
            at, cells, homes = [], [], []
            start = 0
            for key, own in _runs(batch):
                if key in sizes.value and key not in known:
                    if len(known) > 64:
                        known.clear()
                    try:
                        medoids = np.load(BytesIO(bytes(get_file(place(key)))))
                    except FileNotFoundError:  # the sample of a cell may be empty
                        medoids = np.zeros((0, 0))
                    known[key] = medoids if len(medoids) > 1 else None
                home = own.column(5).to_pylist()
                near = [[None]] * own.num_rows if known.get(key) is None else _nearest(_unit(own.column(3).to_pylist()), known[key])
                for i, subs in enumerate(near):
                    for rank, sub in enumerate(subs):
                        at.append(start + i)
                        cells.append(key[1] if sub is None else xxhash.xxh64_intdigest(f"{key[1]}/{sub}") >> 1)
                        homes.append(home[i] and not rank)
                start += own.num_rows
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(cells, pa.int64()), pa.array(homes, pa.bool_())], _ROW_NAMES)

    # The rows of a heavy cell are spread over tasks; each task reads the medoids of the cells that it has.
    spread = rows.repartition("group", "cell", F.pmod(F.col("node"), F.lit(64))).sortWithinPartitions("group", "cell")
    return staged(spread.mapInArrow(assign, _ROW), "vector-cells")


def near_vectors(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Only vectors of equal label and length are compared. Vectors that are null, zero or empty, or hold
    null or non-finite components, and those without label, link with nothing and are their own
    component. Equal vectors of a label are one node with a count. A null vec_id counts as a vector and
    is the component of nothing but itself. Repeated rows count as vectors; vectors of any length, and any number of
    them with one label, are taken whole; an empty table gives no rows; other columns are ignored."""
    spark = table.sparkSession
    rows = staged(_prepared(table), "vectors")
    nodes = rows.filter("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    nodes = staged(nodes.withColumn("group", F.concat_ws(":", (F.length("vec") / 8).cast("int"), "label")), "vector-nodes")
    # Groups larger than a cell: at most one for every CELL vectors.
    large = nodes.groupBy("group").agg(F.count("*").alias("size")).filter(F.col("size") > CELL)
    total = large.agg(F.sum("size")).first()[0] or 0
    share = min(4.0 / CELL, PIVOTS / max(1, total))
    u = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    pivots = nodes.join(large, "group").filter(u < share).select("group", "vec").collect() if total else []
    by_group: dict[str, list[bytes]] = {}
    for r in sorted(pivots, key=lambda r: (r["group"], r["vec"])):
        by_group.setdefault(r["group"], []).append(bytes(r["vec"]))
    # Bounded by PIVOTS vectors, whatever the input.
    medoids = spark.sparkContext.broadcast({g: _apart(v) for g, v in by_group.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = medoids.value
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), object)
            vecs = batch.column(3).to_pylist()
            cells: list[list[int]] = [[0]] * len(vecs)
            for g in set(groups) & set(known):
                own = np.flatnonzero(groups == g)
                for i, near in zip(own, _nearest(_unit([vecs[i] for i in own]), known[g])):
                    cells[i] = near
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], ["group", "node", "n", "vec", "cells"])

    placed = nodes.select("group", "node", "n", "vec").mapInArrow(assign, "group string, node long, n long, vec binary, cells array<long>")
    placed = staged(placed, "vector-cells").withColumn("home", F.element_at("cells", 1)).withColumn("cell", F.explode("cells"))

    def too_large(rows: DataFrame) -> dict[tuple[str, int], int]:
        """One line for every CELL_MOST rows at most."""
        size = rows.groupBy("group", "cell").agg(F.count("*").alias("size")).filter(F.col("size") > CELL_MOST)
        return {(r["group"], r["cell"]): r["size"] for r in size.toLocalIterator()}

    large, level, rows_ = too_large(placed), 0, None
    while large:
        rows_ = placed.select("group", "node", "n", "vec", "cell", (F.col("home") == F.col("cell")).alias("home")) if rows_ is None else rows_
        level += 1
        rows_ = _divided(rows_, large, level)
        now = too_large(rows_)
        done = level == LEVELS or set(now) <= set(large)  # what is left are groups of near copies
        large = now
        if done:
            break
    if rows_ is not None:
        where = rows_.groupBy("node").agg(F.collect_set("cell").alias("cells"), F.max(F.when(F.col("home"), F.col("cell"))).alias("home"))
        placed = staged(rows_.drop("home").join(where, "node").select("group", "node", "n", "vec", "cells", "home", "cell"), "vector-cells")
    heavy = spark.sparkContext.broadcast({k: math.ceil(n / CELL_MOST) for k, n in large.items()})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, node, cell = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(6).to_pylist()
            take, a, b = [], [], []
            for i, key in enumerate(zip(group, cell)):
                parts = heavy.value.get(key, 1)
                mine = xxhash.xxh64_intdigest(str(node[i])) % parts
                for other in range(parts):  # each pair of pieces meets in one task
                    take.append(i)
                    a.append(min(mine, other))
                    b.append(max(mine, other))
            own = batch.take(pa.array(take))
            mine = [xxhash.xxh64_intdigest(str(node[i])) % heavy.value.get((group[i], cell[i]), 1) for i in take]
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x, pa.int32()) for x in (a, b, mine))], ["group", "node", "n", "vec", "cells", "home", "cell", "a", "b", "mine"])

    split = placed.mapInArrow(pieces, "group string, node long, n long, vec binary, cells array<long>, home long, cell long, a int, b int, mine int")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        V, node, n = _unit(t.column("vec").to_pylist()), t.column("node").to_numpy(), t.column("n").to_numpy()
        mine, cell = t.column("mine").to_numpy(), t.column("cell")[0].as_py()
        cells = t.column("cells").to_pylist()
        home = t.column("home").to_numpy()
        member = np.full((len(cells), max(map(len, cells))), -1)
        for i, c in enumerate(cells):
            member[i, : len(c)] = c
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        if heavy.value.get((t.column("group")[0].as_py(), cell), 1) == 1:
            blocks = searched(V, np.flatnonzero(home == cell), flat_graph(V), cosine)
        else:
            first, second = np.flatnonzero(mine == a), np.flatnonzero(mine == b)
            blocks = _blockwise(V, first, first, cosine) if a == b else (x for pair in ((first, second), (second, first)) for x in _blockwise(V, *pair, cosine))
        more, x, y = np.zeros(len(node), np.int64), [], []
        for i, j in blocks:
            i, j = i[home[i] == cell], j[home[i] == cell]
            np.add.at(more, i, n[j])
            # The other's own search sees this vector only in a cell that both are in; else it counts here.
            alone = (home[j] != cell) & ~(member[i] == home[j][:, None]).any(axis=1)
            np.add.at(more, j[alone], n[i[alone]])
            u, v = forest(node[i], node[j])
            x.append(u)
            y.append(v)
        linked = np.flatnonzero(more)
        u, v = forest(np.concatenate(x), np.concatenate(y)) if x else (np.zeros(0, np.int64),) * 2
        return pa.table({"node": np.concatenate([node[linked], u]), "more": np.concatenate([more[linked], np.zeros(len(u), np.int64)]), "other": pa.array(np.concatenate([np.zeros(len(linked), np.int64), v]), mask=np.arange(len(linked) + len(u)) < len(linked))})

    found = staged(split.groupBy("group", "cell", "a", "b").applyInArrow(compare, "node long, more long, other long"), "vector-links")
    more = found.filter("other is null").groupBy("node").agg(F.sum("more").alias("more"))
    parts = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "vector-components")
    grouped = nodes.select("key", "node", "n", "first").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("_rows"))
    known = join_counted(grouped, least, "component", "_rows").join(more, "node", "left").select("key", "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = join_counted(rows.select("vec_id", "key"), staged(known, "vector-classes"), "key", how="left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull()))


def audit_recall(table: DataFrame, found: DataFrame, every: int = 50, cosine: float = COSINE, most: int = 20_000) -> float:
    """The share of the links of the vectors with vec_id divisible by `every`, at most `most` of them, that n_links has.

    These are broadcast and compared with all rows where these lie; each task gives its counts."""
    spark = table.sparkSession
    asked = table.filter((F.col("vec_id") % every == 0) & F.col("label").isNotNull()).select("vec_id", "label", "embedding").orderBy("vec_id").limit(most).toPandas()
    sent = spark.sparkContext.broadcast({str(k): (g["vec_id"].to_numpy(), _rows_of_unit(g["embedding"].tolist())) for k, g in asked.groupby("label")})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(ids), np.int64) for k, (ids, _) in sent.value.items()}
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            for k in set(labels) & set(total):
                own = _rows_of_unit(batch.column(1).filter(pa.array(labels == k)).to_pylist())
                total[k] += (sent.value[k][1] @ own.T >= cosine).sum(axis=1)
        for k, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[k][0]), pa.array(n)], ["vec_id", "n"])

    real = table.filter("label is not null").select(F.col("label").cast("string").alias("label"), "embedding").mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    both = found.select("vec_id", "n_links").join(F.broadcast(real), "vec_id")
    right, total = both.agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return right / total if total else 1.0


def _rows_of_unit(vectors: list) -> np.ndarray:
    X = np.array(vectors, np.float64)
    return X / np.linalg.norm(X, axis=1)[:, None]


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""

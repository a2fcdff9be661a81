"""Near duplicates against all pairs, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from sievio.llm import common
from sievio.llm import embeddings as emb
from sievio.llm import secrets as sec
from sievio.llm import simhash
from sievio.llm import toxicity as tox
from sievio.llm.encoding import TextEncoder, vocabulary
from sievio.llm.graph import components
from sievio.llm.mixing import CURRICULUM, mix


def classes(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("hot", [common.HOT_KEY, 3])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEY", hot)
    rnd = random.Random(3)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = classes(600, pairs)
    assert got == {n: want[n] for a, b in pairs if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def direct_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(p) for p in zip(words, words[1:])] if len(words) > 1 else words
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


@pytest.mark.parametrize("blocks", [2, 3, 4])
def test_anchors_find_every_link_once(blocks):
    rng, fps = np.random.default_rng(1), []
    for x in rng.integers(0, 2**63, 25, dtype=np.uint64):
        for _ in range(15):
            y = int(x)
            for p in rng.choice(64, rng.integers(0, 9), replace=False):
                y ^= 1 << int(p)
            fps.append(y)
    fps = np.unique(np.array(fps, np.uint64))
    want = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 6) & ~np.eye(len(fps), dtype=bool)
    got = np.zeros(want.shape, int)
    for b, home, who, where in simhash.anchors(fps, blocks, 6):
        for a in np.unique(home):
            h, o = np.flatnonzero(home == a), who[where == a]
            i, j = simhash._links(fps[h], fps[o], b, blocks, 6)
            np.add.at(got, (h[i], o[j]), 1)
    assert (got == want).all()


def test_blocks_follow_from_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**5, 10**7, 10**9, 10**11)] == [4, 4, 4, 3, 2]
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for b in (3, 4):  # the expected number of replicas is the real one
        real = sum(len(home) + len(who) for _, home, who, _ in simhash.anchors(fps, b, 6)) / len(fps)
        assert abs(real * simhash.REPLICA_S / (simhash.work(0, b)) - 1) < 0.02


@pytest.mark.parametrize("blocks", [2, 3])
def test_simhash_in_wider_blocks(spark, blocks):
    table = spark.createDataFrame([(i, f"alpha beta gamma delta{i // 3} epsilon zeta eta theta iota kappa lambda{i % 2}") for i in range(30)], "doc_id long, text string")
    assert Counter(map(tuple, simhash.near_duplicates(table, blocks=blocks).collect())) == Counter(map(tuple, simhash.near_duplicates(table).collect()))


@pytest.mark.parametrize("cell", [simhash.CELL, (2, 3)])
def test_simhash(docs, rows, empty, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(common, "HOT_KEY", 2 if cell == (2, 3) else common.HOT_KEY)
    fps = [direct_fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 6]
    near, label = Counter(x for p in links for x in p), classes(len(rows), links)
    first = {c: min((r[0] for r, k in zip(rows, label) if k == c and r[0] is not None), default=None) for c in set(label)}
    want = Counter((r[0], f"{f:016x}", near[i], first[label[i]]) for i, (r, f) in enumerate(zip(rows, fps)))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


def vectors():
    rng, out = np.random.default_rng(2), []
    for label in (0, 1, None):
        base = rng.normal(size=(60, 16))
        near = np.repeat(base[:6], 12, axis=0) + rng.normal(size=(72, 16)) * 0.03
        hot = base[7] + rng.normal(size=(150, 16)) * 0.04
        out += [(v.tolist(), label) for v in (*base, *near, *hot)]
    odd = [(None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] + [1.0] * 15, 0), ([float("inf")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1), ([1.0] * 8, 0), ([2.0] * 8, 0), ([1e300] * 16, 1), ([1e-300] * 16, 1)]
    out += odd + out[5:8]
    return [(i, v, label, "x", i) for i, (v, label) in enumerate(out)] + [(None, out[9][0], out[9][1], "x", 0)]


@pytest.mark.parametrize("cell,most", [(emb.CELL, emb.CELL_MOST), (60, 10_000), (60, 50), (40, 100)])
def test_embeddings(spark, monkeypatch, cell, most):
    monkeypatch.setattr(emb, "CELL", cell)
    monkeypatch.setattr(emb, "CELL_MOST", most)
    data = vectors()
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, key string, node int")
    ok = [i for i, r in enumerate(data) if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    unit = {i: np.array(data[i][1]) / max(map(abs, data[i][1])) for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(i, j) for i in ok for j in ok if j < i and data[i][2] == data[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    n, label = Counter(x for p in links for x in p), classes(len(data), links)
    first = {c: min((data[i][0] for i in range(len(data)) if label[i] == c and data[i][0] is not None), default=None) for c in set(label)}
    got = sorted(map(tuple, emb.near_vectors(table).collect()), key=str)
    want = sorted(((r[0], n[i], first[label[i]], r[0] == first[label[i]] if r[0] is not None else True) for i, r in enumerate(data)), key=str)
    assert len(got) == len(want)
    found, every = sum(min(g[1], w[1]) for g, w in zip(got, want)), sum(w[1] for w in want)
    assert found >= 0.97 * every and all(g[1] <= w[1] for g, w in zip(got, want) if g[0] is not None)
    if most == 50 or cell == emb.CELL:
        assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]
    assert emb.near_vectors(table.limit(0)).count() == 0


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert emb.audit_recall(table, emb.near_vectors(table)) >= 0.9


@pytest.mark.parametrize("most,pivots", [(emb.CELL_MOST, emb.PIVOTS), (2500, 12)])
def test_recall_over_several_cells(spark, monkeypatch, most, pivots):
    """36,000 vectors of one label: several cells of the real size; few first medoids, whose cells are divided again."""
    monkeypatch.setattr(emb, "CELL_MOST", most)
    monkeypatch.setattr(emb, "PIVOTS", pivots)
    if most < emb.CELL_MOST:
        monkeypatch.setattr(emb, "CELL", 1000)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(9000, 24))
    V = np.repeat(base, 4, axis=0) + rng.normal(size=(36_000, 24)) * 0.06
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(36_000), "label": 1, "embedding": V.tolist()}), "vec_id long, label int, embedding array<double>").repartition(8)
    found = emb.near_vectors(table)
    assert emb.audit_recall(table, found) >= 0.98
    assert found.count() == 36_000


def test_pipeline(spark, sf, docs, rows, tmp_path):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert step.columns == docs.columns, name
        step.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
    assert step.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "secret scans", "mixing", "best-fit packing"]


def test_near_duplicate_stage(spark, docs, rows, sf):
    kept = Counter(r["doc_id"] for r in corpus_pipeline.near_duplicate(spark, docs, sf).collect())
    assert kept[None] == 1 and kept[6] == 1 and kept[7] == 0 and kept[20] == 1 and kept[8] == 0
    assert [kept[i] for i in (0, 1, 2)] == [1, 0, 0]  # rows without words are one group; the row without words and id is of it
    assert all(n == 1 for n in kept.values())


def test_stages_against_direct_versions(spark, docs, rows, sf, tmp_path):
    """Each stage's rows, on what the one before wrote, from plain Python."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    insults = [f"a{i} scum b{i} moron c{i}" for i in range(40)]
    extra = spark.createDataFrame([(5000 + i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate([*insults, *(f"plain words {i} of no harm {i * 7} at all {i * 3}" for i in range(120))])], "doc_id long, text string, lang string, source string, n_chars long")
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra)
    labels.select("doc_id", "toxic").filter("doc_id < 0").union(extra.selectExpr("doc_id", "int(doc_id < 5040)")).write.parquet(f"{tmp_path}/labels.parquet")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    step, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in step.collect()]
        stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        got.append((before, [tuple(r) for r in step.collect()]))
    (b0, a0), (b1, a1), (b2, a2), (b3, a3), (b4, a4) = got

    model = tox.train(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    total = lambda t: sum(w for e, w in model["weights"].items() for i in range(len(t)) if t.startswith(e, i))

    def toxic(text):
        words, n = tox._folded(text or "")
        x = total(f" {' '.join(words)} ")
        c = model["curve"]
        return 1 / (1 + math.exp(-(c[0] + c[1] * math.log1p(x) + c[2] * math.log1p(100 * x / max(20, n))))) >= 0.3

    assert not model["places"] and Counter(a0) == Counter(r for r in b0 if not toxic(r[1])) and len(a0) == len(b0) - 40

    fps = [direct_fingerprint(r[1]) for r in b1]
    label = classes(len(b1), [(i, j) for i in range(len(b1)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 6])
    groups = {c: [r for r, k in zip(b1, label) if k == c] for c in set(label)}
    want = Counter(min(r[0] for r in g if r[0] is not None) if any(r[0] is not None for r in g) else None for g in groups.values())
    assert Counter(r[0] for r in a1) == want and set(a1) <= set(b1)

    def cut(text):
        own, done, out = sorted((s for s in sec.found_in(text or "") if s[4] and s[3] not in examples), key=lambda s: s[:2]), 0, []
        for a, _, b, _, _ in own:
            if a >= done:
                out += [text[done:a], "[SECRET]"]
            done = max(done, b)
        return "".join(out) + text[done:] if own else text

    owners = {}
    for r in b2:
        for s in sec.found_in(r[1] or ""):
            owners.setdefault(s[3], set()).add(r[3])
    examples = {v for v, s in owners.items() if len(s) >= min(5, len({r[3] for r in b2}))}
    want = [(r[0], cut(r[1]), *r[2:4], len(cut(r[1])) if cut(r[1]) != r[1] else r[4]) for r in b2]
    assert Counter(a2) == Counter(want) and any("[SECRET]" in (r[1] or "") for r in a2)

    assert set(a3) <= set(b3) and max(Counter(a3).values()) <= 3
    read = Counter()
    size = lambda t: len((t or "").replace("\x1c", "x").split())
    for r in a3:
        read[r[3]] += size(r[1])
    for r in mix(spark.read.parquet(f"{tmp_path}/{corpus_pipeline.STAGES[2][0]}"), CURRICULUM).select("source", "target").distinct().collect():
        assert abs(read[r["source"]] - r["target"]) <= max(size(x[1]) for x in b3 if x[3] == r["source"])

    enc, pieces = TextEncoder(vocabulary()).tokenizer, Counter()
    for r in b4:
        ids = enc.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            pieces[r[0], k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())] += 1
    assert Counter(r[:5] for r in a4) == pieces
    per = {}
    for r in a4:
        per.setdefault(r[5], []).append((r[6], r[3]))
    assert all(o == sum(n for _, n in sorted(s)[:i]) for s in per.values() for i, (o, _) in enumerate(sorted(s))) and all(sum(n for _, n in s) <= 4096 for s in per.values())


def test_stage_on_empty(spark, empty, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_forest():
    x, y = simhash.forest(np.array([5, 7, 9, 2]), np.array([7, 9, 5, 1]))
    assert set(zip(x.tolist(), y.tolist())) == {(7, 5), (9, 5), (2, 1)} and math.isfinite(len(x))

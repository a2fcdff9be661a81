"""Token files and packing against the library, entry by entry."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievio.llm.dac import DacFile, DacShard, dac_file
from sievio.llm.encoding import TextEncoder, vocabulary
from sievio.llm.packing import best_fit_decreasing, pack
from sievio.llm.token_output import token_at, token_output, write_token_files


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(vocabulary())


def direct(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@given(st.lists(st.text(alphabet=st.sampled_from("aéß ZΣ'’s.,-<|>0\x1ć  x日"), max_size=40), max_size=5))
@settings(max_examples=300, deadline=None)
def test_encoding_is_the_librarys(encoder, texts):
    for t in [*texts, "don't <|endoftext|> a<|startoftext|>b I'LL we're"]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == direct(encoder, t)[:-1]


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=2000), st.data())
@settings(max_examples=60, deadline=None)
def test_codes_are_addressable(values, data):
    ends = np.array([len(values) // 2, len(values)], np.uint64)
    raw = b"".join(dac_file(np.array(values, np.uint32), [None, 7], ends))
    shard = DacShard(raw)
    assert shard.slice(0, len(values)).tolist() == values
    assert shard.doc(0).tolist() + shard.doc(1).tolist() == values
    for _ in range(min(20, len(values))):
        i = data.draw(st.integers(0, len(values) - 1))
        assert shard.at(i) == values[i]
        assert DacFile(lambda offset, n: raw[offset : offset + n]).at(i) == values[i]
    if values:
        a = data.draw(st.integers(0, len(values) - 1))
        b = data.draw(st.integers(a, len(values)))
        assert shard.slice(a, b).tolist() == values[a:b]


def test_a_value_costs_few_bytes():
    values = np.random.default_rng(1).integers(0, 2**20, 100_000).astype(np.uint32)
    raw, read = b"".join(dac_file(values, [1], np.array([100_000], np.uint64))), []

    def part(offset, n):
        read.append(n)
        return raw[offset : offset + n]

    file = DacFile(part)
    read.clear()
    assert [file.at(i) for i in range(0, 100_000, 1009)] == values[::1009].tolist()
    assert sum(read) < 100 * 300


def test_token_output(docs, rows, empty, encoder):
    got = Counter(tuple(r) for r in token_output(docs, vocabulary()).select("doc_id", "n_tokens", "ids_crc32").collect())
    want = Counter((r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows for i in [direct(encoder, r[1])])
    assert got == want
    out = token_output(docs, vocabulary()).orderBy("start").collect()
    assert [r["start"] for r in out] == np.cumsum([0] + [r["n_tokens"] for r in out])[:-1].tolist()
    assert [r["doc_id"] or -1 for r in out] == sorted(r["doc_id"] or -1 for r in out)
    assert token_output(empty, vocabulary()).count() == 0


def test_token_at(spark, docs, rows, encoder, tmp_path):
    manifest = write_token_files(docs, f"file://{tmp_path}/t", vocabulary())
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    last = direct(encoder, ordered[-1][1])
    n = sum(m["n_tokens"] for m in manifest)
    assert [token_at(manifest, n - len(last) + i) for i in range(min(5, len(last)))] == last[:5]
    with pytest.raises(IndexError):
        token_at(manifest, n)


def brute_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins[bins.index(min(fits))] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 50))
@settings(max_examples=200, deadline=None)
def test_best_fit_is_best_fit(lengths, capacity):
    rows, n = best_fit_decreasing(dict(Counter(lengths)), capacity)
    assert n == brute_best_fit(lengths, capacity)
    assert len(rows) <= 4 * capacity


def test_pack(docs, rows, empty, encoder):
    out = pack(docs, vocabulary(), 256).toPandas()
    for _, g in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"]).tolist()[:-1]] and g["length"].sum() <= 256
    want = Counter()
    for r in rows:
        ids = direct(encoder, r[1])
        for k, a in enumerate(range(0, len(ids), 256)):
            own = ids[a : a + 256]
            want[r[0], k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    got = Counter((None if x[0] != x[0] else int(x[0]), *map(int, x[1:])) for x in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert got == want
    assert out["sequence_id"].nunique() == brute_best_fit(out["length"].tolist(), 256)
    assert pack(empty, vocabulary()).count() == 0

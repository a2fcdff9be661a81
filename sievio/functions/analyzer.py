"""Text analysis: normalising and splitting into words with positions."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_MOST = 127
#: Bytes of texts whose words make a block, those that are split at once, occurrences of a word in a line; chunks or words, and
#: words of chunks, that are kept from one block to the next.
BLOCK_BYTES, PART_BYTES, MOST = 4_000_000, 2_000_000, 1024
KNOWN, BLOCK = 150_000, 600_000
_WORD_KINDS = frozenset(("Ll", "Lo", "Pc", "Mc", "Mn", "Nd", "Nl", "No"))
_DROPPED = frozenset(("Mn", "Mc", "Me", "Cc", "Cn", "Cf", "Cs", "Co"))
#: Look-alike punctuation, as public Unicode tables lump it.
_LUMP = (
    {c: "'" for c in "‘’ʼˈ`´ʹʻ′"}
    | {c: "-" for c in "‐‑‒–—―−­﹘﹣－"}
    | {c: '"' for c in "“”„‟″ʺ"}
    | {c: "/" for c in "⁄∕"}
    | {c: ":" for c in "∶"}
    | {c: "<" for c in "‹〈〈"}
    | {c: ">" for c in "›〉〉"}
    | {c: "*" for c in "∗"}
    | {c: "|" for c in "∣"}
    | {c: "~" for c in "˜∼"}
    | {c: "_" for c in "ˍ"}
    | {c: "^" for c in "˄ˆ‸⌃"}
)


class _Plain(dict):
    """Per character, its normal form: case folded, without marks, controls and look-alikes."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85":
            out = " "
        elif c in _LUMP:
            out = _LUMP[c]
        else:
            text = unicodedata.normalize("NFKD", c).casefold()
            out = "".join(_LUMP.get(x, x) for x in unicodedata.normalize("NFKD", text) if unicodedata.category(x) not in _DROPPED)
        if len(self) < 200_000:
            self[code] = out
        return out


_PLAIN = _Plain()


def normalise(text: str) -> str:
    return unicodedata.normalize("NFKC", text.translate(_PLAIN))


@functools.lru_cache(maxsize=100_000)
def _in_word(c: str) -> bool:
    return unicodedata.category(c) in _WORD_KINDS


def _tokens(text: str, joined: bool) -> list[tuple[str, int]]:
    """(word, position) of a normalised text. A hyphenated word gives its parts and, if `joined`, also the whole."""
    out: list[tuple[str, int]] = []
    word: list[str] = []
    whole: list[str] = []
    position, abbreviation = 0, False
    for c in text + " ":
        if _in_word(c):
            word.append(c)
            if len(word) + len(whole) >= TOKEN_MOST:
                word, whole = [], []
            continue
        if c == "." and (len(word) == 1 and not whole or abbreviation):
            abbreviation = True
            continue
        if c == "'":
            abbreviation = True
            continue
        if c == "-" and word:
            position += 1
            out.append(("".join(word), position))
            whole += word
            word = []
            continue
        if whole:
            if word:
                out.append(("".join(word), position))
                position -= 1
                if joined:
                    position += 1
                    out.append(("".join(whole + word), position))
        elif word:
            position += 1
            out.append(("".join(word), position))
        word, whole, abbreviation = [], [], False
    return out


class _Chunks(dict):
    """Words of what stands between white space, where all of a word's state ends; and how far the position goes on."""

    def __init__(self, joined: bool):
        self.joined = joined

    def __missing__(self, chunk: str) -> tuple[list[tuple[str, int]], int]:
        parts = normalise(chunk).split(" ")
        if len(parts) == 1:
            tokens = _tokens(parts[0], self.joined)
        else:
            tokens = _tokens(" ".join(parts), self.joined)
        out = tokens, max((p for _, p in tokens), default=0)
        if tokens and tokens[-1][1] < out[1]:
            out = tokens, tokens[-1][1]
        if len(chunk) <= 64:
            if len(self) >= 300_000:
                self.clear()
            self[chunk] = out
        return out


_CHUNKS = {True: _Chunks(True), False: _Chunks(False)}
#: A chunk that may be one word with signs after it; a point after one letter may be an abbreviation's.
_ONE = re.compile(r"(\w{2,126})[!\"#$%&()*+,./:;<=>?@\[\\\]^{|}~]*").fullmatch
_LATIN = re.compile("[a-z0-9_]{2,126}").fullmatch
_SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split takes them for white space; here they are dropped


def _cached(text: str, joined: bool) -> list[tuple[str, int]]:
    if _SEPARATORS.search(text):
        return _tokens(normalise(text), joined)
    out: list[tuple[str, int]] = []
    chunks, at = _CHUNKS[joined], 0
    for chunk in text.split():
        tokens, n = chunks[chunk]
        if len(tokens) == 1:
            at += 1
            out.append((tokens[0][0], at))
        else:
            out += [(w, p + at) for w, p in tokens]
            at += n
    return out


def index_tokens(text: str) -> list[tuple[str, int]]:
    return _cached(text, True)


def search_tokens(text: str) -> list[tuple[str, int]]:
    return _cached(text, False)


def whitespace_tokens(text: str) -> list[tuple[str, int]]:
    return [(w, i + 1) for i, w in enumerate(w for w in text.split(" ") if w and len(w) <= 255)]


ANALYZERS: dict[str, Callable[[str], list[tuple[str, int]]]] = {"default": index_tokens, "search": search_tokens, "whitespace": whitespace_tokens}
TOKENS = "array<struct<word:string,position:int>>"


def analyse(text: Column, analyzer: str = "default") -> Column:
    """The words of a string column with positions; null gives none. Distinct short texts of a batch are split once."""
    split = ANALYZERS[analyzer]

    def run(texts: pd.Series) -> pd.Series:
        seen: dict[str, list] = {}

        def one(t):
            if t is None:
                return []
            if len(t) > 200:
                return [{"word": sys.intern(w), "position": p} for w, p in split(t)]
            if t not in seen:
                seen[t] = [{"word": w, "position": p} for w, p in split(t)]
            return seen[t]

        return texts.map(one)

    if analyzer == "whitespace":  # no need of Python
        words = F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: (w != "") & (F.length(w) <= 255))
        return F.transform(words, lambda w, i: F.struct(w.alias("word"), (i + 1).cast("int").alias("position")))
    return F.pandas_udf(run, TOKENS)(text)


def _simple(chunk: str) -> str | None:
    """The word of a chunk that is plainly a Latin one with at most signs after it; the common case, and soon found."""
    found = _ONE(chunk)
    if found is None:
        return None
    word = found[1].lower() if found[1].isascii() else normalise(found[1])
    return word if _LATIN(word) else None


class _Numbers(dict):
    """Numbers of chunks, and the words of each: which, at which place from the chunk's start, and how far the place goes on."""

    def __init__(self, joined: bool):
        self.chunks = _CHUNKS[joined]
        self.words: dict[str, int] = {}
        self.start, self.step = array("q", [0]), array("q")
        self.word, self.place = array("q"), array("q")

    def __missing__(self, chunk: str) -> int:
        word = _simple(chunk)
        if word:
            n = 1
            self.word.append(self.number(word))
            self.place.append(1)
        else:
            tokens, n = self.chunks[chunk]
            for w, p in tokens:
                self.word.append(self.number(w))
                self.place.append(p)
        self.start.append(len(self.word))
        self.step.append(n)
        self[chunk] = number = len(self.step) - 1
        return number

    def number(self, word: str) -> int:
        return self.words.setdefault(word, len(self.words))


class _Block:
    """Words of texts, gathered until they are many, then sorted: each word with its documents and positions."""

    def __init__(self, analyzer: str):
        self.split, self.joined = ANALYZERS[analyzer], {"default": True, "search": False}.get(analyzer)
        self.numbers = _Numbers(bool(self.joined))
        self.clear()

    def clear(self) -> None:
        if len(self.numbers) >= KNOWN or len(self.numbers.words) >= KNOWN or len(self.numbers.word) >= BLOCK:
            self.numbers = _Numbers(bool(self.joined))
        self.docs: list[pa.Array] = []
        self.rows, self.size = 0, 0
        self.chunks: list[np.ndarray] = []  # numbers of the texts' chunks, one text after another
        self.counts: list[np.ndarray] = []  # how many each text has, by text
        self.single: tuple[array, array, array] = (array("q"), array("q"), array("q"))  # (text, word, position) of texts that aren't split into chunks

    def add(self, docs: pa.Array, texts: pa.Array, size: int) -> None:
        """Takes texts of so many bytes, those of a batch or some of them. Each distinct chunk is looked up once."""
        slow = pa.array(np.ones(len(texts), bool)) if self.joined is None else pc.match_substring_regex(texts, "[\x1c-\x1f]")
        for i in np.flatnonzero(slow.to_numpy(zero_copy_only=False)).tolist():
            for w, p in self.split(texts[i].as_py()):
                for out, x in zip(self.single, (self.rows + i, self.numbers.number(w), p)):
                    out.append(x)
        lists = pc.utf8_split_whitespace(pc.if_else(slow, "", texts))
        coded = lists.flatten().dictionary_encode()
        numbers = np.fromiter(map(self.numbers.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        self.chunks.append(numbers[coded.indices.to_numpy()])
        self.counts.append(lists.value_lengths().to_numpy().astype(np.int64))
        self.docs.append(docs)
        self.rows += len(texts)
        self.size += size

    def close(self, priority: int) -> pa.RecordBatch:
        known, chunks, counts = self.numbers, np.concatenate(self.chunks), np.concatenate(self.counts)
        start, step = np.array(known.start, np.int64), np.array(known.step, np.int64)
        ends = np.cumsum(step[chunks])
        first = np.concatenate([[0], ends])[np.cumsum(counts) - counts]  # how far the place went before each text
        n = start[chunks + 1] - start[chunks]
        last = np.cumsum(n)
        at = np.arange(last[-1] if len(last) else 0) + np.repeat(start[chunks] + n - last, n)
        word, place = np.array(known.word, np.int64)[at], np.array(known.place, np.int64)[at] + np.repeat(ends - step[chunks] - np.repeat(first, counts), n)
        text = np.repeat(np.repeat(np.arange(len(counts)), counts), n)
        text, word, place = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip((text, word, place), self.single))
        # By word, then in the order in which they came: numbers of words in their order, and places, as one number.
        there = np.flatnonzero(np.bincount(word, minlength=len(known.words)))
        words = pa.array(list(known.words), pa.string()).take(pa.array(there))
        order = pc.sort_indices(words).to_numpy()
        rank = np.zeros(len(known.words), np.int64)
        rank[there[order]] = np.arange(len(there))
        bits = max(1, len(word).bit_length())
        key = np.sort((rank[word] << bits) | np.arange(len(word)))
        by, own = key & ((1 << bits) - 1), key >> bits
        # A list of more than MOST is cut.
        begin = np.searchsorted(own, np.arange(len(there) + 1))
        size = np.diff(begin)
        pieces = -(-size // MOST)
        of = np.repeat(np.arange(len(there)), pieces)
        cut = begin[:-1][of] + MOST * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        offsets = pa.array(np.append(cut, len(word)), pa.int32())
        docs = pa.concat_arrays(self.docs).take(pa.array(text[by]))
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(of), priority, np.int32)), words.take(pa.array(order[of])), pa.ListArray.from_arrays(offsets, docs), pa.ListArray.from_arrays(offsets, pa.array(place[by].astype(np.int32)))],
            ["priority", "word", "docs", "positions"],
        )
        self.clear()
        return out


def word_blocks(texts: DataFrame, analyzer: str = "default") -> DataFrame:
    """(priority, word, docs, positions) of every word of (_docid, priority, text): of each of some BLOCK_BYTES bytes of
    texts a line for a word, or for each MOST occurrences of it, by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = _Block(analyzer), None
        for batch in batches:
            docs, kinds, column = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            ends = np.cumsum(pc.binary_length(column).to_numpy())
            at = 0
            while at < batch.num_rows:
                if block.rows and (kinds[at] != now or block.size >= BLOCK_BYTES):
                    yield block.close(now)
                now, before = int(kinds[at]), int(ends[at - 1]) if at else 0
                other = np.flatnonzero(kinds[at:] != now)
                stop = min(int(np.searchsorted(ends, before + PART_BYTES)) + 1, at + int(other[0]) if len(other) else batch.num_rows)
                block.add(docs.slice(at, stop - at), column.slice(at, stop - at), int(ends[stop - 1]) - before)
                at = stop
        if block.rows:
            yield block.close(now)

    return texts.select("_docid", "priority", "text").filter("text is not null").mapInArrow(run, "priority int, word string, docs array<long>, positions array<int>")

"""Highlighting of matched words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import accumulate
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analyzer import _in_word, index_tokens, normalise
from ..functions.distance import distances, osa_rows
from ..functions.terms import Term, TextPlan

START, END = "<mark>", "</mark>"
#: Characters of texts that are worked on together, chunks kept after them, words whose distances are computed together, rows of JSON.
PART, KNOWN, WORDS, ROWS = 1 << 20, 200_000, 1 << 15, 1000
_CHUNK = re.compile(r"\S+")


def _spans(text: str) -> list[tuple[int, int, str, list[int]]]:
    """(start, end, word, end of each character of the word) of the words of a text, by start; a hyphenated word also whole."""
    out: list[tuple[int, int, str, list[int]]] = []
    at = 0
    while at < len(text):
        plain = normalise(text[at])
        if not plain or not all(_in_word(c) for c in plain):
            at += 1
            continue
        end = at
        while end < len(text) and (not text[end].isspace()):
            end += 1
        parts: list[list[tuple[str, int, int]]] = [[]]
        i = at
        while i < end:
            p = normalise(text[i])
            if p == "-" and parts[-1]:
                parts.append([])
            elif p in (".", "'"):
                if p == "." and not (len(parts[-1]) == 1 or len(parts[-1]) > 1 and _abbreviated(text[at:i])):
                    break
            elif p and all(_in_word(c) for c in p):
                parts[-1] += [(c, i, i + 1) for c in p]
            elif p:
                break
            i += 1
        solid = [p for p in parts if p]
        if len(solid) > 1:
            whole = [c for p in solid for c in p]
            out.append((whole[0][1], whole[-1][2], "".join(c for c, _, _ in whole), [e for _, _, e in whole]))
        for p in solid:
            out.append((p[0][1], p[-1][2], "".join(c for c, _, _ in p), [e for _, _, e in p]))
        at = max(i, at + 1)
    return sorted(out, key=lambda s: (s[0], s[1]))


def _abbreviated(text: str) -> bool:
    return "." in text or "'" in normalise(text)


def _matched(term: Term, words: list[str]) -> np.ndarray:
    """How many characters of each word the term marks; 0 where it doesn't match."""
    if not term.fuzzy:
        return np.array([len(term.word) if (w.startswith(term.word) if term.prefix else w == term.word) else 0 for w in words], np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    if not term.prefix:
        return np.where(distances(term, words) >= 0, lengths, 0)
    rows = osa_rows(term.word, words, term.typos)
    return np.where(rows.min(axis=1) <= term.typos, np.minimum(rows.argmin(axis=1), lengths), 0)


class Marker(dict):
    """What stands between white space, where all of a word's state ends, with its matched words marked.

    New ones of a batch of texts are learnt together: each distinct word meets the terms once."""

    def __init__(self, terms: list[Term]):
        self.terms = terms

    def __missing__(self, chunk: str) -> str:
        self._learn([chunk])
        return self[chunk]

    def learn(self, texts: Iterable[str | None]) -> Iterator[list[str | None]]:
        """The texts in parts, of each of which all chunks are known while it is worked on."""
        part: list[str | None] = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= PART:
                self.ready(part)
                yield part
                part, size = [], 0
        self.ready(part)
        yield part

    def ready(self, part: list[str | None]) -> None:
        if len(self) >= KNOWN:
            self.clear()
        self._learn([c for c in {c for t in part if t for c in t.split()} if c not in self])

    def _learn(self, chunks: list[str]) -> None:
        spans = [_spans(c) for c in chunks]
        words = list({s[2] for own in spans for s in own})
        sizes: dict[str, int] = {}
        for a in range(0, len(words), WORDS):
            own = words[a : a + WORDS]
            n = np.zeros(len(own), np.int64)
            for term in self.terms:
                n = np.where(n > 0, n, _matched(term, own))
            sizes.update(zip(own, n.tolist()))
        for c, own in zip(chunks, spans):
            self[c] = self._marked(c, own, sizes)

    @staticmethod
    def _marked(text: str, spans: list[tuple[int, int, str, list[int]]], sizes: dict[str, int]) -> str:
        out, done = [], 0
        for start, end, word, ends in spans:
            n = sizes[word]
            if n and start >= done:
                stop = end if n >= len(word) else ends[n - 1]
                out += (text[done:start], START, text[start:stop], END)
                done = stop
        return "".join(out) + text[done:] if out else text

    def highlight(self, text: str | None) -> str | None:
        """The text with its matched words, or their best matching beginnings, marked; unchanged without match."""
        return _CHUNK.sub(lambda m: self[m.group()], text) if text and self.terms else text

    def snippet(self, text: str | None, size: int) -> str | None:
        """The stretch of `size` words with the most marks, marked; the first of several."""
        if not text:
            return text
        words = text.split()
        shown = [self[w] for w in words] if self.terms else words
        sums = list(accumulate((m != w for m, w in zip(shown, words)), initial=0))
        best = max(range(max(1, len(words) - size + 1)), key=lambda i: sums[min(i + size, len(words))] - sums[i])
        return " ".join(shown[best : best + size])


def highlight(text: str | None, terms: list[Term]) -> str | None:
    return Marker(terms).highlight(text)


def snippet(text: str | None, terms: list[Term], size: int) -> str | None:
    return Marker(terms).snippet(text, size)


def marked(col: Column, plan: TextPlan, size: int = 0) -> Column:
    """The strings with their matches marked; if `size` is given, their snippets of so many words."""
    terms = plan.terms

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marker = Marker(terms)
        for texts in batches:
            yield pd.Series([marker.snippet(t, size) if size else marker.highlight(t) for part in marker.learn(texts) for t in part], dtype=object)

    return F.pandas_udf(run, "string")(col) if terms else col


def _sizes(fields: list[str]) -> dict[str, int]:
    """Fields with their snippets' numbers of words, 0 for whole texts, from `field` and `field:N`."""
    out = {}
    for f in fields:
        name, colon, n = f.rpartition(":")
        out |= {name: int(n)} if colon and n.isdigit() else {f: 0}
    return out


def _apply(col: Column, t: T.DataType, path: str, wanted, plan: TextPlan) -> Column:
    if isinstance(t, T.StringType):
        size = wanted(path)
        return col if size is None else marked(col, plan, size)
    if isinstance(t, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_apply(col[f.name], f.dataType, f"{path}.{f.name}", wanted, plan).alias(f.name) for f in t.fields]))
    return col


def _lists(schema: T.StructType, wanted) -> bool:
    """Whether strings to mark lie in lists, which a Column of plain UDFs can't reach."""

    def deep(t: T.DataType, path: str, inside: bool) -> bool:
        if isinstance(t, T.StringType):
            return inside and wanted(path) is not None
        if isinstance(t, T.StructType):
            return any(deep(f.dataType, f"{path}.{f.name}", inside) for f in t.fields)
        return isinstance(t, T.ArrayType) and deep(t.elementType, path, True)

    return any(deep(f.dataType, f.name, False) for f in schema.fields)


def _walk_value(value, path: str, wanted, change: Callable[[str, int], str]):
    """The value with change(text, size) in place of each wanted text."""
    if isinstance(value, str):
        size = wanted(path)
        return value if size is None else change(value, size)
    if isinstance(value, dict):
        return {k: _walk_value(v, f"{path}.{k}" if path else k, wanted, change) for k, v in value.items()}
    if isinstance(value, list):
        return [_walk_value(v, path, wanted, change) for v in value]
    return value


def highlighted(docs: DataFrame, plan: TextPlan, fields: list[str] | None, source: bool = False, skip: tuple[str, ...] = ("_id",)) -> DataFrame:
    """docs with `_highlight`, a copy with marked strings, or, if `source`, with the strings themselves marked.

    Fields are dotted names, or ["*"] for all strings; None for none. `name:N` gives the N words of the text with the
    most matches. Meant for a page of hits."""
    if fields is None:
        return docs
    sizes = _sizes(fields)
    wanted = lambda path: None if path.split(".")[0] in skip or path.startswith("_") else sizes.get(path, sizes.get("*"))
    schema = T.StructType([f for f in docs.schema.fields if not f.name.startswith("_")])
    whole = F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])
    if not schema.fields:
        return docs
    if _lists(schema, wanted):
        import json

        terms = plan.terms

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            marker = Marker(terms)
            change = lambda t, size: marker.snippet(t, size) if size else marker.highlight(t)
            for rows in batches:
                out = []
                for a in range(0, len(rows), ROWS):
                    values, texts = [json.loads(r) for r in rows[a : a + ROWS]], []
                    for v in values:
                        _walk_value(v, "", wanted, lambda t, _: texts.append(t))
                    marker.ready(texts)
                    out += [json.dumps(_walk_value(v, "", wanted, change)) for v in values]
                yield pd.Series(out, dtype=object)

        copy = F.from_json(F.pandas_udf(run, "string")(F.to_json(whole)), schema)
    else:
        copy = F.struct(*[_apply(F.col(f"`{f.name}`"), f.dataType, f.name, wanted, plan).alias(f.name) for f in schema.fields])
    if not source:
        return docs.withColumn("_highlight", copy)
    out = docs.withColumn("_h", copy)
    return out.select(*[F.col(f"_h.`{f.name}`").alias(f.name) if f.name in schema.names else F.col(f"`{f.name}`") for f in docs.schema.fields])


__all__ = ["highlight", "highlighted", "index_tokens", "marked", "snippet"]

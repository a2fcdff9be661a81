"""Edit distance with adjacent transpositions (optimal string alignment), for whole columns of words."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import Term

FAR = 99


def osa_rows(term: str, words: list[str], most: int) -> np.ndarray:
    """For each word, the distance of the term to each of its prefixes of up to len(term) + most characters; FAR beyond the word's end."""
    width = len(term) + most
    codes = np.zeros((len(words), width), np.uint32)
    lengths = np.array([min(len(w), width + 1) for w in words], np.int64)
    for i, w in enumerate(words):
        own = np.frombuffer(w[:width].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[i, : len(own)] = own
    t = [ord(c) for c in term]
    two = None
    before = np.tile(np.arange(width + 1), (len(words), 1))
    for i in range(1, len(t) + 1):
        row = np.empty_like(before)
        row[:, 0] = i
        for j in range(1, width + 1):
            same = codes[:, j - 1] == t[i - 1]
            best = np.minimum(np.minimum(before[:, j] + 1, row[:, j - 1] + 1), before[:, j - 1] + ~same)
            if i > 1 and j > 1:
                swap = (codes[:, j - 1] == t[i - 2]) & (codes[:, j - 2] == t[i - 1])
                best = np.where(swap, np.minimum(best, two[:, j - 2] + 1), best)
            row[:, j] = best
        two, before = before, row
    before[np.arange(width + 1)[None, :] > lengths[:, None]] = FAR
    return before


def distances(term: Term, words: list[str]) -> np.ndarray:
    """The distance of the term to each word, -1 where it doesn't match.

    For a prefix, the prefixes of the word are walked by length; the first one at least as long as the
    term that is near enough ends the walk, and the least distance up to there counts."""
    if not words:
        return np.zeros(0, np.int64)
    if not term.fuzzy:
        return np.array([0 if (w.startswith(term.word) if term.prefix else w == term.word) else -1 for w in words])
    rows, k, L = osa_rows(term.word, words, term.typos), term.typos, len(term.word)
    if not term.prefix:
        lengths = np.array([len(w) for w in words])
        out = rows[np.arange(len(words)), np.minimum(lengths, rows.shape[1] - 1)]
        return np.where((lengths <= L + k) & (out <= k), out, -1)
    best = np.where(rows[:, :L] <= k, rows[:, :L], FAR).min(axis=1)
    late = rows[:, L:] <= k
    first = late.argmax(axis=1)
    best = np.minimum(best, np.where(late.any(axis=1), rows[np.arange(len(words)), L + first], FAR))
    return np.where(best <= k, best, -1)


def near(term: Term, word: Column) -> Column:
    """Whether a word may match the term: exactly so without typos; with typos, by plain edit distance, in which a swap is two edits."""
    if not term.fuzzy:
        return F.startswith(word, F.lit(term.word)) if term.prefix else word == term.word
    L, k = len(term.word), term.typos
    if not term.prefix:
        return (F.abs(F.length(word) - L) <= k) & (F.levenshtein(F.lit(term.word), word, 2 * k) >= 0)
    return reduce(or_, [F.levenshtein(F.lit(term.word), F.substring(word, 1, m), 2 * k) >= 0 for m in range(L - k, L + k + 1)])

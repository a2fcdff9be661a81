"""Operator 2: toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, strips marks, maps look-alike letters of other scripts, digits, and signs
between letters to plain letters, and leaves single spaces between words. The lexicon holds
words and word beginnings with log-odds weights; an exception phrase, which holds an entry
without being toxic, takes that occurrence of the entry out, once, however many phrases
hold it. The sum, alone and by the number of words, goes through a logistic curve."""

from __future__ import annotations

import functools
import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import basic, prepare, texts_of

THRESHOLD = 0.3
#: Labelled rows, the first by hash of doc_id, that the lexicon is fitted on.
TRAIN_ROWS = 8192
#: Different left neighbours that an entry has in toxic texts; copies of one text bring only one.
SUPPORT = 8
#: Of the texts with an entry, the share that may be clean; also for a phrase, the share that may be toxic.
IMPURE = 0.1
PREFIXES = range(4, 9)

_LOOKALIKES = dict(zip("аеіорсухѕјһԁӏкмтнвгαεικνορτυχωβγδ", "aeiopcyxsjhdikmthbraeikvoptuxwbyd")) | dict(zip("01l2345789", "oiizeastbg"))
_SIGNS = dict(zip("@$+!|", "astii"))
#: Signs that letters enclose, and a word that starts with signs.
_ENCLOSED = re.compile(r"(?<=[^\W_])[@$+!|]+(?=[^\W_])")
_LEADING = re.compile(r"(?<!\S)[@$+!|]+(?=[^\W_])")
_PLAIN = str.maketrans(_SIGNS)


class _Fold(dict):
    """Per character: its plain letter, or a space."""

    def __missing__(self, code: int):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
        out = "".join(_LOOKALIKES.get(x, x) for x in plain)
        if unicodedata.combining(c) or unicodedata.category(c) == "Cf":
            out = ""
        elif not out.isalpha():
            out = " "
        self[code] = out
        return out


_TABLE = _Fold()


def _folded(text: str) -> tuple[list[str], int]:
    """The folded words, and how many of them are the text's own; behind them, other readings of some."""
    low, other = text.lower(), []
    if not _SIGNS.keys().isdisjoint(low):
        low = _ENCLOSED.sub(lambda m: m[0].translate(_PLAIN), low)
        for m in _LEADING.finditer(low):  # $tupid is stupid, @idiot is idiot: both readings count
            rest = low[m.end() : m.end() + 64].split(None, 1)[0]
            other += (m[0].translate(_PLAIN) + rest).translate(_TABLE).split()[:1]
    words = low.translate(_TABLE).split()
    n, single = len(words), [i for i, w in enumerate(words) if len(w) == 1]
    if len(single) > 3:
        first = at = single[0]
        for i in [*single[1:], n + 1]:
            if i != at + 1:
                if at - first >= 3:
                    words.append("".join(words[first : at + 1]))
                first = i
            at = i
    return words + other, n


def fold(text: str) -> list[str]:
    """The folded words of a text; l and i, which 1 stands for, are one letter. Four or more single letters in a row are
    also a word, and a word that starts with signs is also read with these as letters."""
    return _folded(text)[0]


def _entries(word: str) -> list[str]:
    return [word[:k] for k in PREFIXES if len(word) >= k] + ([word + " "] if len(word) > 2 else [])


class _ByWord(dict):
    """The entries of `known` that a word starts with."""

    def __init__(self, known):
        self.known, self.sizes = known, sorted({len(e) for e in known})

    def __missing__(self, word: str) -> list[str]:
        whole = word + " "
        self[word] = [whole[:k] for k in self.sizes if k <= len(whole) and whole[:k] in self.known]
        return self[word]


def fit(texts: list[tuple[str, int]], support: int = SUPPORT, impure: float = IMPURE) -> dict:
    """Lexicon, exception phrases and curve from (text, toxic) pairs.

    An entry has `support` different left neighbours in toxic texts and few clean texts with it;
    an entry that starts with another is dropped, and one that
    nearly always goes on in the same way is lengthened. A phrase (an entry after or before a certain
    word) that is in `support` texts, nearly all of them clean, is an exception."""
    once: dict[str, str] = {}  # a word is held once, however many texts have it
    folded = [([once.setdefault(w, w) for w in words], n, x) for t, x in texts for words, n in [_folded(t)]]
    lefts: dict[str, set] = defaultdict(set)
    toxic, clean = Counter(), Counter()
    for words, _, x in folded:
        if x:
            for left, w in {(a, b) for a, b in zip(["", *words], words)}:
                for e in _entries(w):
                    lefts[e].add(left)
            toxic.update({e for w in set(words) for e in _entries(w)})
    often = {e for e, s in lefts.items() if len(s) >= support}
    with_entry = _ByWord(often)
    for words, _, x in folded:
        if not x:
            clean.update({e for w in set(words) for e in with_entry[w]})
    P, N = sum(x for *_, x in folded), sum(1 - x for *_, x in folded)
    weight = {e: math.log((toxic[e] + 0.5) / (P + 1)) - math.log((clean[e] + 0.5) / (N + 1)) for e in often}
    chosen: list[str] = []
    for e in sorted(often, key=lambda e: (len(e), e)):
        if clean[e] <= impure * toxic[e] and weight[e] > 1 and not any(e.startswith(c) for c in chosen):
            while longer := [x for x in often if len(x) == len(e) + 1 and x.startswith(e) and x[-1] != " " and toxic[x] >= 0.98 * toxic[e]]:
                e = longer[0]  # as long a beginning as nearly all texts with it share
            if not any(c.startswith(e) for c in chosen):
                chosen.append(e)
    lexicon = {" " + e: round(weight[e], 4) for e in chosen}
    phrases, seen, by_word = Counter(), Counter(), _ByWord(set(chosen))
    for words, _, x in folded:
        own = set()
        for i, w in enumerate(words):
            for e in by_word[w]:
                own |= {(f" {words[i - 1]} {e}", e, len(words[i - 1]) + 1)} if i else set()
                own |= {(f" {w} {words[i + 1]} ", e, 0)} if i + 1 < len(words) else set()
        seen.update(own)
        phrases.update(own if not x else ())
    exceptions = {p: (-lexicon[" " + e], at) for (p, e, at), n in seen.items() if phrases[p, e, at] >= max(support, (1 - impure) * n)}
    model = {"weights": lexicon | {p: w for p, (w, _) in exceptions.items()}, "places": {p: at for p, (_, at) in exceptions.items()}, "curve": [0.0, 0.0, 0.0]}
    score = _automaton(json.dumps(model))
    X = np.array([[1.0, *_features(_sum(score, words), n)] for words, n, _ in folded]).reshape(-1, 3)
    y = np.array([x for *_, x in folded], float)
    b = np.zeros(3)
    for _ in range(25):  # Newton steps; the penalty keeps separable labels finite
        p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + 0.1 * np.eye(3), X.T @ (y - p) - 0.1 * b)
        b += step
    model["curve"] = [round(float(v), 6) for v in b]
    return model


@functools.lru_cache(maxsize=2)
def _automaton(model: str):
    """Matches end with (length, weight, place of the entry that an exception phrase holds, -1 for an entry)."""
    import ahocorasick

    a, known = ahocorasick.Automaton(), json.loads(model)
    for entry, w in known["weights"].items():
        a.add_word(entry, (len(entry), w, known.get("places", {}).get(entry, -1)))
    if len(a):
        a.make_automaton()
    return a


def _sum(automaton, words: list[str]) -> float:
    """The weights of the entries in the words, without those that an exception phrase holds."""
    if not words or not len(automaton):
        return 0.0
    hits, taken = [], set()
    for end, (size, w, at) in automaton.iter(f" {' '.join(words)} "):
        if at < 0:
            hits.append((end - size + 1, w))
        else:
            taken.add(end - size + 1 + at)
    return sum(w for start, w in hits if start not in taken)


def _features(total: float, n: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * total / max(20, n))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Fits on at most `rows` labelled rows that aren't held out, the first by hash of doc_id, whole texts.

    Rows without id, text or label are left out. With one class only, the lexicon is empty."""
    spark = prepare(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` pairs of numbers, and then their texts.
    sample = basic(docs, "doc_id", "text").filter("text is not null").join(F.broadcast(known), "doc_id").select("text", "toxic").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(t, x) for b in batches for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_pydict({"model": [json.dumps(fit(sorted(pairs)))]})

    found = spark.createDataFrame(sample.coalesce(1).mapInArrow(run, "model string").collect(), "model string").collect()
    return json.loads(found[0][0]) if found else {"weights": {}, "curve": [0.0, 0.0, 0.0]}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with `score`: 0 to 1, higher where toxic is likelier; null and empty texts are scored as no words.

    A text of any length is folded and matched whole, in time linear in it. Equal texts get equal scores, so
    ties stay ties; all rows and columns stay."""
    packed, (b0, b1, b2) = json.dumps(model), model["curve"]
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(packed)
        for batch in batches:
            out = []
            for text in texts_of(batch.column(at)):
                words, n = _folded(text)
                x, y = _features(_sum(automaton, words), n)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b0 + b1 * x + b2 * y)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*names, "score"])

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    A null doc_id is not held out; a null text is scored as an empty one, a text of any length whole. Repeated
    rows and equal texts get equal scores. An empty table gives no rows, one without usable labels scores of 0.5.
    Other columns are ignored."""
    scored = score(basic(docs, "doc_id", "text"), train(docs, labels, rows))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

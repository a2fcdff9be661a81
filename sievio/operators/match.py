"""Matching: postings, vocabulary, and the documents that a text plan holds for."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analyzer import word_blocks
from ..functions.distance import distances, near
from ..functions.terms import TextPlan, holds
from ..plans.mapping import Mapping
from .fields import values

BLOCKS = "priority int, word string, docs array<long>, positions array<int>"


def blocks(docs: DataFrame, mapping: Mapping, analyzer: str = "default") -> DataFrame:
    """(priority, word, docs, positions) of all indexed strings: postings of a word in a block of texts as lists.

    Each element of a list starts at position 1 again."""
    parts = []
    for name in mapping.strings:
        f = mapping.fields[name]
        parts.append(docs.select("_docid", F.lit(f.priority).alias("priority"), (F.explode(values(f)) if f.many else values(f)).alias("text")))
    if not parts:
        return docs.sparkSession.createDataFrame([], BLOCKS)
    return word_blocks(reduce(DataFrame.unionByName, parts), analyzer)


def spread(rows: DataFrame) -> DataFrame:
    """Lines of blocks as postings (_docid, priority, word, position), with what other columns they have."""
    more = [c for c in rows.columns if c not in ("priority", "word", "docs", "positions")]
    each = rows.select("priority", "word", *more, F.explode(F.arrays_zip("docs", "positions")).alias("_each"))
    return each.select(F.col("_each.docs").alias("_docid"), "priority", "word", F.col("_each.positions").alias("position"), *more)


def postings(docs: DataFrame, mapping: Mapping, analyzer: str = "default") -> DataFrame:
    """(_docid, priority, word, position) of all indexed strings."""
    return spread(blocks(docs, mapping, analyzer))


def vocabulary(posts: DataFrame) -> DataFrame:
    """(word, df): the distinct words and the number of documents with each."""
    return posts.select("word", "_docid").distinct().groupBy("word").agg(F.count("*").alias("df"))


def word_hits(words: DataFrame, plan: TextPlan) -> DataFrame:
    """The lines of words that terms match, with `terms` (which), `first` (the first of them), `dist` (by the last).

    Distances are computed for a line, never for its occurrences; words that plain edit distance
    rules out for all terms don't leave the JVM."""
    terms, at = plan.terms, words.columns.index("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(at).to_pylist()
            distinct = list(dict.fromkeys(own))
            found = np.array([distances(t, distinct) for t in terms]).reshape(len(terms), len(distinct))
            hits = {w: found[:, i] for i, w in enumerate(distinct) if (found[:, i] >= 0).any()}
            keep = [i for i, w in enumerate(own) if w in hits]
            which = [np.flatnonzero(hits[own[i]] >= 0).tolist() for i in keep]
            added = [pa.array(which, pa.list_(pa.int32())), pa.array([w[0] for w in which], pa.int32()), pa.array([int(hits[own[i]][w[-1]]) for w, i in zip(which, keep)], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns, *added], [*batch.schema.names, "terms", "first", "dist"])

    schema = T.StructType([*words.schema.fields, *T.StructType.fromDDL("terms array<int>, first int, dist int").fields])
    return words.filter(_near(plan)).mapInArrow(run, schema)


def _near(plan: TextPlan) -> Column:
    return reduce(or_, [near(t, F.col("word")) for t in plan.terms])


def occurrences(posts: DataFrame, plan: TextPlan, words: DataFrame | None = None) -> DataFrame:
    """The postings of matched words, with the words' terms, first and dist; from postings, or from blocks.

    Without typos the terms are plain predicates and reach the scan. With typos the lines' own words are matched, or, where
    a vocabulary is given, its words, and whether its hits are broadcast is left to their size at run time; what
    plain edit distance rules out is dropped before the join."""
    if not any(t.fuzzy for t in plan.terms):
        found = _located(posts, plan)
    elif words is not None:
        found = posts.filter(_near(plan)).join(word_hits(words.select("word"), plan), "word")
    else:
        found = word_hits(posts, plan)
    return spread(found) if "docs" in found.columns else found


def _located(posts: DataFrame, plan: TextPlan) -> DataFrame:
    any_ = reduce(or_, [F.startswith("word", F.lit(t.word)) if t.prefix else F.col("word") == t.word for t in plan.terms])
    each = [F.startswith("word", F.lit(t.word)) if t.prefix else F.col("word") == t.word for t in plan.terms]
    terms = F.filter(F.array(*[F.when(e, F.lit(i)) for i, e in enumerate(each)]), lambda x: x.isNotNull())
    return posts.filter(any_).withColumn("terms", terms).withColumn("first", F.element_at("terms", 1)).withColumn("dist", F.lit(0))


def _has(i: int) -> Column:
    return F.max(F.array_contains("terms", i))


def matching(found: DataFrame, plan: TextPlan) -> DataFrame:
    """_docid of the documents for which the plan holds, from occurrences; one aggregation, flags merged before the shuffle."""
    flags = found.groupBy("_docid").agg(*[_has(i).alias(f"t{i}") for i in range(len(plan.terms))])
    return flags.filter(holds(plan, lambda i: F.col(f"t{i}"))).select("_docid")

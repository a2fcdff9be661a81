"""Rank columns of matching documents, sort keys and pages."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryError
from ..functions.terms import TextPlan, holds
from ..plans.mapping import Mapping
from ..plans.settings import Settings
from .fields import doc_value

FAR = 8
#: A place is one number: 40 bits for the word's position, above them the field's priority; a distance is above both.
_BITS, _FIELD_BITS = 40, 12
_FIELD = 1 << _BITS
RANK = ("typos", "proximity", "field", "position", "exact")


def ranked(found: DataFrame, plan: TextPlan) -> DataFrame:
    """_docid and the five rank columns of the documents that the plan holds for; no Python runs.

    One word: exact occurrences, if any, compete alone; the least distance, then the first place, win. Several
    words: one sort of a document's occurrences by place, and one aggregation of it."""
    key = F.col("priority").cast("long") * _FIELD + F.col("position")
    low = lambda col, shift, bits: F.shiftright(col, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    if plan.slots == 1:
        word = F.col("word") == plan.words[0]
        # Distance, field and position as one number: its minimum is a hash aggregation, which that of a struct isn't.
        best = found.groupBy("_docid").agg(F.max(word.cast("int")).alias("exact"), F.min(F.shiftleft(F.col("dist").cast("long"), _BITS + _FIELD_BITS) + key).alias("b"))
        return best.select("_docid", low("b", _BITS + _FIELD_BITS, 8).alias("typos"), F.lit(0).alias("proximity"), low("b", _BITS, _FIELD_BITS).alias("field"), low("b", 0, _BITS).alias("position"), "exact")
    n, first = plan.slots, F.col("first")
    # Which slots an occurrence stands for; a joined pair of words stands for both, all words joined for everything.
    joined = (lambda i: F.lit(False)) if n == 2 else (lambda i: first == 2 * i + 1)
    whole = first == (2 if n == 2 else 2 * n - 1)
    own = (lambda s: first == s) if n == 2 else (lambda s: F.shiftright(first, 1) == s)
    rows = found.withColumn("key", key).select("_docid", "word", "first", "dist", "terms", "key", *[(own(s) | joined(s - 1) if s else own(s)).alias(f"s{s}") for s in range(n)])
    w = Window.partitionBy("_docid").orderBy("key")
    before, here = w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(0, 0)
    # Places of neighbouring slots, walked through in order: each is as far as the other's last place before it. A place of both is no distance.
    rows = rows.withColumns({f"both{i}": F.max(f"s{i + 1}").over(here) for i in range(n - 1)})
    rows = rows.withColumns({f"to{i}": F.least(F.when(F.col(f"s{i}"), F.col("key") - F.max(F.when(F.col(f"s{i + 1}"), F.col("key"))).over(before)), F.when(F.col(f"s{i + 1}"), F.col("key") - F.max(F.when(F.col(f"s{i}") & ~F.col(f"both{i}"), F.col("key"))).over(before))) for i in range(n - 1)})
    per = rows.groupBy("_docid").agg(
        F.min("key").alias("key"), F.max(whole).alias("whole"), *[F.max((F.col("word") == x).cast("int")).alias(f"x{i}") for i, x in enumerate(plan.words)],
        *[F.min(F.when(own(s), F.col("dist"))).alias(f"d{s}") for s in range(n)], *[F.max(joined(i)).alias(f"j{i}") for i in range(n - 1)],
        *[F.least(F.lit(FAR), F.coalesce(F.min(f"to{i}"), F.lit(FAR))).alias(f"p{i}") for i in range(n - 1)], *[F.max(F.array_contains("terms", i)).alias(f"t{i}") for i in range(len(plan.terms))],
    )
    per = per.filter(holds(plan, lambda i: F.col(f"t{i}")))
    typos = [F.when(F.col(f"j{s - 1}"), 0).otherwise(F.col(f"d{s}")) if s else F.col("d0") for s in range(n)]
    spare = F.coalesce(F.least(*typos), F.lit(0))  # a slot whose word an earlier one took counts as that one
    total = reduce(add, [F.coalesce(t, spare) for t in typos])
    proximity = reduce(add, [F.when(F.col(f"j{i}"), 1).otherwise(F.col(f"p{i}")) for i in range(n - 1)])
    exact = reduce(add, [F.col(f"x{i}") for i in range(n)])
    return per.select(
        "_docid", F.when(F.col("whole"), 0).otherwise(total).cast("int").alias("typos"), F.when(F.col("whole"), n - 1).otherwise(proximity).cast("int").alias("proximity"),
        low("key", _BITS, _FIELD_BITS).alias("field"), low("key", 0, _BITS).alias("position"), exact.cast("int").alias("exact"),
    )


def unranked(docs: DataFrame) -> DataFrame:
    """Documents of a query without words: all ranks are zero."""
    return docs.select("*", *[F.lit(0).alias(c) for c in RANK])


def sort_keys(settings: Settings, mapping: Mapping) -> list[tuple[Column, bool]]:
    """(value, whether descending): sortBy, then the rank rules, then rankBy, then _docid."""

    def by(spec: dict | None) -> list[tuple[Column, bool]]:
        out = []
        for name, how in (spec or {}).items():
            f = mapping.get(name, "sort field")
            if f.base != "number" or not f.indexed:
                raise QueryError(f"'{name}' is no indexed number")
            out.append((doc_value(f), how == "desc"))
        return out

    rules = [(F.col(r), r == "exact") for r in settings.rankAlgorithm]
    return [*by(settings.sortBy), *rules, *by(settings.rankBy), (F.col("_docid"), False)]


def page(rows: DataFrame, keys: list[tuple[Column, bool]], number: int, size: int) -> DataFrame:
    """One page in order, of ids, ranks and sort values only: the sort and the limit stay together, so a task keeps
    no more than the best number * size of its rows."""
    narrow = rows.select("_docid", *RANK, *[k.alias(f"_k{i}") for i, (k, _) in enumerate(keys)])
    return narrow.orderBy(*order(keys)).limit(number * size).offset((number - 1) * size)


def order(keys: list[tuple[Column, bool]]) -> list[Column]:
    return [F.desc(f"_k{i}") if down else F.asc(f"_k{i}") for i, (_, down) in enumerate(keys)]

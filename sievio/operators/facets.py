"""Value counts of all facet fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.mapping import Field, Mapping
from .fields import values


def _keys(f: Field):
    """A facet's keys as text; numbers are told apart to six digits."""
    text = (lambda x: F.format_string("%f", x.cast("double"))) if f.base == "number" else (lambda x: x)
    v = values(f)
    return F.transform(v, text) if f.many else F.array(text(v))


def _named(field: str):
    return lambda key: F.struct(F.lit(field).alias("field"), key.alias("key"))


def facet_counts(docs: DataFrame, mapping: Mapping, fields: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """(field, key, count) of every value, in one pass over docs and one aggregation.

    An element that a document repeats counts each time, unless `distinct`. Missing values count nowhere."""
    wanted = [mapping.fields[n] for n in (fields if fields is not None else mapping.facets)]
    if not wanted:
        return docs.sparkSession.createDataFrame([], "field string, key string, count long")
    lists = []
    for f in wanted:
        keys = F.array_distinct(_keys(f)) if distinct else _keys(f)
        lists.append(F.transform(F.coalesce(keys, F.array().cast("array<string>")), _named(f.name)))
    every = lists[0] if len(lists) == 1 else F.concat(*lists)
    rows = docs.select(F.explode(every).alias("x")).select("x.field", "x.key").filter("key is not null")
    return rows.groupBy("field", "key").agg(F.count("*").alias("count"))


def top_facets(counts: DataFrame, k: int) -> DataFrame:
    """The k commonest keys of each field, ties by key: exact, with `rank`."""
    w = Window.partitionBy("field").orderBy(F.desc("count"), F.asc("key"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def facets_as_dict(rows: list, mapping: Mapping) -> dict:
    out: dict = {name: [] for name in mapping.facets}
    for r in sorted(rows, key=lambda r: (r["field"], r["rank"])):
        number = mapping.fields[r["field"]].base == "number"
        out[r["field"]].append({"count": r["count"], "key": float(r["key"]) if number else r["key"]})
    return out


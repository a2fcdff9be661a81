"""Metric aggregations: all of a request in one pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.mapping import Field, Mapping
from .fields import doc_value, values

METRICS = ("max", "min", "avg", "stats", "cardinality")
_STATS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def parse_aggs(spec, mapping: Mapping) -> list[tuple[str, str, Field]]:
    """(name, metric, field) of each aggregation of a request."""
    if spec is None:
        return []
    if not isinstance(spec, dict):
        raise QueryError("aggs must be an object")
    out = []
    for name, body in spec.items():
        kinds = [k for k in body if k != "aggs"] if isinstance(body, dict) else []
        if len(kinds) != 1 or kinds[0] not in METRICS:
            raise QueryError(f"Unknown aggregation for '{name}'")
        kind = kinds[0]
        field = body[kind].get("field") if isinstance(body[kind], dict) else None
        if not isinstance(field, str):
            raise QueryError(f"Aggregation '{name}' needs a field")
        f = mapping.get(field, "aggregation field")
        if kind == "cardinality":
            if not f.facet:
                raise QueryError(f"Cardinality of '{field}', which is no facet")
        elif f.base != "number" or not f.indexed:
            raise QueryError(f"'{field}' is no indexed number")
        out.append((name, kind, f))
    return out


def agg_columns(aggs: Iterable[tuple[str, str, Field]], missing: str = "zero") -> list[Column]:
    """One column for each value; names are aggregation, then '.', then value."""
    out: list[Column] = []
    for name, kind, f in aggs:
        if kind == "stats":
            v = doc_value(f, missing)
            out += [fn(v).alias(f"{name}.{k}") for k, fn in _STATS.items()] + [F.count(v).alias(f"{name}.count")]
        elif kind != "cardinality":
            out.append(_STATS[kind](doc_value(f, missing)).alias(f"{name}.value"))
        elif not f.many:
            out.append(F.count_distinct(values(f)).alias(f"{name}.value"))
    return out


def aggregate(docs: DataFrame, aggs: list[tuple[str, str, Field]], missing: str = "zero") -> DataFrame:
    """One row with a column per value. Metrics share one pass; the distinct elements of each list field take one of their own."""
    out: DataFrame | None = None
    columns = agg_columns(aggs, missing)
    if columns:
        out = docs.agg(*columns)
    for name, kind, f in aggs:
        if kind == "cardinality" and f.many:
            one = docs.select(F.explode(values(f)).alias("v")).agg(F.count_distinct("v").alias(f"{name}.value"))
            out = one if out is None else out.join(F.broadcast(one))  # two single rows
    return out if out is not None else docs.agg(F.count("*").alias("count"))


def as_dict(row: Row) -> dict:
    out: dict = {}
    for key, value in row.asDict().items():
        name, _, part = key.rpartition(".")
        out.setdefault(name, {})[part] = value
    return out

"""Predicate trees as one boolean Column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.mapping import Field, Mapping
from .fields import values

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
_LISTS = {"$and": "and", "$or": "or", "$in": "or", "$nin": "nor"}


def compile_filter(spec, mapping: Mapping) -> Column | None:
    """The filter of a query; None if there is nothing to filter by. Errors are QueryError, found before anything runs."""
    if not isinstance(spec, dict) or not spec:
        return None
    return _object(spec, mapping)


def _combine(how: str, parts: list[Column]) -> Column:
    """and, or, nor of predicates that are never null; of none, nothing holds, but for nor, all."""
    if not parts:
        return F.lit(how == "nor")
    if how == "and":
        return reduce(and_, parts)
    any_ = reduce(or_, parts)
    return ~any_ if how == "nor" else any_


def _object(spec: dict, mapping: Mapping) -> Column:
    parts = []
    for key, value in spec.items():
        if key in _LISTS:
            if not isinstance(value, list):
                raise QueryError(f"{key} needs a list of filters")
            subs = []
            for v in value:
                if not isinstance(v, dict):
                    raise QueryError(f"{key} needs a list of filters")
                subs.append(_object(v, mapping) if v else F.lit(False))
            parts.append(_combine(_LISTS[key], subs))
        elif key.startswith("$"):
            raise QueryError(f"Operator {key} needs a field")
        else:
            parts.append(_field(mapping.get(key, "filter field"), value))
    return _combine("and", parts)


def _field(f: Field, spec) -> Column:
    if isinstance(spec, list):
        return _combine("and", [_field_item(f, v) for v in spec])
    if isinstance(spec, dict):
        if not spec:
            raise QueryError(f"Empty filter for '{f.name}'")
        return _combine("and", [_operator(f, op, v) for op, v in spec.items()])
    return _equal(f, spec)


def _field_item(f: Field, spec) -> Column:
    if isinstance(spec, list):
        raise QueryError(f"A list within a list for '{f.name}'")
    return _field(f, spec)


def _operator(f: Field, op: str, value) -> Column:
    if op == "$eq":
        return _equal(f, value)
    if op == "$ne":
        return ~_equal(f, value)
    if op in _COMPARE:
        if f.base != "number":
            raise QueryError(f"{op} on '{f.name}', which isn't a number")
        return _holds(f, lambda x: _COMPARE[op](x.cast("double"), F.lit(_number(f, value))), plain=lambda x: _COMPARE[op](x, F.lit(_number(f, value))))
    if op in _LISTS:
        if not isinstance(value, list):
            raise QueryError(f"{op} needs a list")
        if op in ("$in", "$or", "$nin") and value and all(isinstance(v, (str, int, float)) for v in value):
            hit = _among(f, value)
            return ~hit if op == "$nin" else hit
        return _combine(_LISTS[op], [_field_item(f, v) for v in value])
    raise QueryError(f"Unknown operator {op}")


def _number(f: Field, value) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise QueryError(f"'{f.name}' needs a number")
    return float(value)


def _literal(f: Field, value):
    if isinstance(value, (list, dict)) or value is None:
        raise QueryError(f"'{f.name}' needs a single value")
    if f.base == "string":
        if not isinstance(value, str):
            raise QueryError(f"'{f.name}' needs a string")
        if not f.facet:
            raise QueryError("String filter for non-faceted string field")
        return value
    if f.base == "boolean":
        if not isinstance(value, bool):
            raise QueryError(f"'{f.name}' needs true or false")
        return value
    if f.base == "number":
        if not f.indexed:
            raise QueryError(f"Number filter for '{f.name}', which isn't indexed")
        return _number(f, value)
    raise QueryError(f"'{f.name}' can't be filtered")


def _holds(f: Field, test: Callable[[Column], Column], plain: Callable[[Column], Column] | None = None) -> Column:
    """Whether any value of the field passes; false where it is missing.

    A plain column is compared as it is, without a cast, so that the comparison reaches the scan."""
    if f.base == "number" and not f.indexed:
        raise QueryError(f"Number filter for '{f.name}', which isn't indexed")
    v = values(f)
    if f.many:
        return F.coalesce(F.exists(v, test), F.lit(False))
    return v.isNotNull() & (plain or test)(v)


def _equal(f: Field, value) -> Column:
    x = _literal(f, value)
    return _holds(f, lambda v: v == F.lit(x))


def _among(f: Field, given: list) -> Column:
    xs = [_literal(f, v) for v in given]
    if f.many:
        return _holds(f, lambda v: v.isin(xs))
    v = values(f)
    return v.isNotNull() & v.isin(xs)

"""Columns of fields by dotted name, through objects and lists of objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.mapping import Field


def _member(name: str):
    return lambda x: x[name]


def values(f: Field) -> Column:
    """A field's value; one flat list of values where the field, or an object around it, is a list."""
    col = F.col(f"`{f.path[0]}`")
    depth = int(f.arrays[0])
    for step, many in zip(f.path[1:], f.arrays[1:]):
        col = F.transform(col, _member(step)) if depth else col[step]
        if many and depth:
            col = F.flatten(F.filter(col, lambda x: x.isNotNull()))
        depth = depth or int(many)
    return col


def numbers(f: Field) -> Column:
    return values(f).cast("array<double>" if f.many else "double")


def doc_value(f: Field, missing: str = "zero") -> Column:
    """The one number of a document that sorting and metrics see: the last of a list; a missing one is 0, or null for missing='skip'."""
    v = F.try_element_at(numbers(f), F.lit(-1)) if f.many else numbers(f)
    return F.coalesce(v, F.lit(0.0)) if missing == "zero" else v

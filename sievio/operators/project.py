"""Projection of documents to chosen fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tree(names: list[str]) -> dict:
    """Dotted names as a tree; a name that is listed whole ends in None."""
    out: dict = {}
    for name in names:
        at, steps = out, name.split(".")
        for i, s in enumerate(steps):
            if at.get(s, 0) is None:
                break
            if i == len(steps) - 1:
                at[s] = None
            else:
                at = at.setdefault(s, {})
    return out


def _narrow(col: Column, t: T.DataType, want: dict | None) -> Column | None:
    if want is None:
        return col
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        probe = _parts(t.elementType, want)
        return F.transform(col, lambda x: F.when(x.isNotNull(), F.struct(*[_narrow(x[f.name], f.dataType, w).alias(f.name) for f, w in probe]))) if probe else None
    if isinstance(t, T.StructType):
        parts = _parts(t, want)
        return F.when(col.isNotNull(), F.struct(*[_narrow(col[f.name], f.dataType, w).alias(f.name) for f, w in parts])) if parts else None
    return None


def _known(t: T.DataType, want: dict | None) -> bool:
    if want is None:
        return True
    inner = t.elementType if isinstance(t, T.ArrayType) else t
    return isinstance(inner, T.StructType) and bool(_parts(inner, want))


def _parts(t: T.StructType, want: dict) -> list:
    return [(f, want[f.name]) for f in t.fields if f.name in want and _known(f.dataType, want[f.name])]


def get_fields(docs: DataFrame, names: list[str] | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs with the fields of those dotted names only, and the columns of `keep`. Unknown names are ignored;
    lists of objects are narrowed element by element; a parent's name keeps all of it."""
    if names is None:
        return docs
    want = _tree(names)
    columns = []
    for f in docs.schema.fields:
        if f.name in keep and f.name not in want:
            columns.append(F.col(f"`{f.name}`"))
        elif f.name in want:
            col = _narrow(F.col(f"`{f.name}`"), f.dataType, want[f.name])
            if col is not None:
                columns.append(col.alias(f.name))
    return docs.select(*columns)

"""The schema of an index: types inferred from the data, roles and priorities from the settings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import QueryError

MAX_FIELDS = 255
MAX_NAME = 255
INTERNAL = ("_id", "_docid", "_shard")
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass
class Field:
    """A field by its dotted name; `arrays` says which steps of the path are arrays."""

    name: str
    kind: str  # null, string, number, boolean, object, array; with " array" for lists
    path: tuple[str, ...]
    arrays: tuple[bool, ...]
    indexed: bool = False
    facet: bool = False
    priority: int = -1
    facet_priority: int = -1

    @property
    def base(self) -> str:
        return self.kind.removesuffix(" array")

    @property
    def many(self) -> bool:
        """Whether a document may have several values: the field, or an object around it, is a list."""
        return any(self.arrays)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        inner = kind_of(t.elementType)
        return "array" if inner.endswith("array") else "null" if inner == "null" else f"{inner} array"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, _NUMBERS):
        return "number"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.StructType):
        return "object"
    return "null"


def fields_of(schema: T.StructType) -> dict[str, Field]:
    """All fields of a schema by dotted name, in order; the content of lists of lists is left out."""
    out: dict[str, Field] = {}

    def walk(struct: T.StructType, path: tuple[str, ...], arrays: tuple[bool, ...]) -> None:
        for f in struct.fields:
            if not path and f.name in INTERNAL:
                continue
            kind = kind_of(f.dataType)
            own, lists = (*path, f.name), (*arrays, kind.endswith(" array"))
            if len(out) >= MAX_FIELDS or len(f.name) > MAX_NAME:
                raise QueryError("Too many fields, or too long a field name")
            out[".".join(own)] = Field(".".join(own), kind, own, lists)
            if kind in ("object", "object array"):
                walk(f.dataType if kind == "object" else f.dataType.elementType, own, lists)

    walk(schema, (), ())
    return out


def _json_type(value) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, (int, float)):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, _json_type(v)) for k, v in value.items()])
    if isinstance(value, list):
        return T.ArrayType(_json_type(value[0])) if value else T.NullType()  # the first element decides
    return T.NullType()


def _merge(old: T.DataType, new: T.DataType) -> T.DataType:
    """The first type that isn't null stays; objects gain fields; lists of objects don't."""
    if isinstance(old, T.NullType):
        return new
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        names = [f.name for f in old.fields]
        return T.StructType([T.StructField(f.name, _merge(f.dataType, new[f.name].dataType) if f.name in new.names else f.dataType) for f in old.fields] + [f for f in new.fields if f.name not in names])
    if isinstance(old, T.ArrayType) and isinstance(old.elementType, T.NullType) and isinstance(new, T.ArrayType):
        return new
    return old


def infer_schema(rows: Iterable[dict]) -> T.StructType:
    """A schema from JSON objects in order: the first type met for a field that isn't null is its type."""
    out: T.DataType = T.StructType([])
    for row in rows:
        out = _merge(out, _json_type(row))
    return out


def merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """What documents of schema `new` after those of `old` make of it."""
    return _merge(old, new)


def without_void(t: T.DataType) -> T.DataType:
    """t with strings where nothing but nulls was seen."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(without_void(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, without_void(f.dataType)) for f in t.fields])
    return t


@dataclass
class Mapping:
    """Fields with their roles. Priorities count within strings, numbers, booleans and facets, in the order of the settings."""

    fields: dict[str, Field]
    ready: bool = False
    strings: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    booleans: list[str] = field(default_factory=list)
    facets: list[str] = field(default_factory=list)

    @classmethod
    def infer(cls, schema: T.StructType, indexed: list[str] | None = None, facets: list[str] | None = None) -> Mapping:
        m = cls(fields_of(schema))
        known = [n for n in [*(indexed or []), *(facets or [])] if n in m.fields and m.fields[n].base != "null"]
        m.ready = indexed is not None and len(known) == len([*(indexed or []), *(facets or [])])
        for name in indexed or []:
            f = m.fields.get(name)
            group = {"string": m.strings, "number": m.numbers, "boolean": m.booleans}.get(f.base) if f else None
            if group is not None and name not in group:
                f.indexed, f.priority = True, len(group)
                group.append(name)
        for name in facets or []:
            f = m.fields.get(name)
            if f and f.base in ("string", "number") and name not in m.facets:
                f.facet, f.facet_priority = True, len(m.facets)
                m.facets.append(name)
        return m

    def get(self, name: str, role: str = "field") -> Field:
        f = self.fields.get(name)
        if f is None or not (f.indexed or f.facet):
            raise QueryError(f"Unknown {role} '{name}'")
        return f

    def as_dict(self) -> dict:
        def tree(only: bool) -> dict:
            out: dict = {}
            for f in self.fields.values():
                if only and not (f.indexed or f.facet):
                    continue
                at = out
                for step in f.path[:-1]:
                    at = at.setdefault(step, {"type": "object"}).setdefault("fields", {})
                own = at.setdefault(f.path[-1], {})
                own["type"] = f.kind
                if only:
                    own |= {"isIndexed": f.indexed, "isFacet": f.facet, "indexPriority": f.priority, "facetPriority": f.facet_priority}
            return out

        return {
            "fullSchema": tree(False), "indexSchema": tree(True) if self.ready else None, "numFields": len(self.fields), "readyToIndex": self.ready,
            "strings": self.strings, "numbers": self.numbers, "booleans": self.booleans, "facets": self.facets,
        }

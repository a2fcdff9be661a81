"""Documents in and results out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..plans.mapping import infer_schema, merged_schema, without_void
from .staging import ship


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    """A table of any format that the session can read: parquet, orc, csv, json, text, jdbc, ..."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def _schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch of a file: what its lines, in order, make of the schema, and its lines that aren't objects."""
    found: dict[tuple[str, int], tuple[T.StructType, int]] = {}
    for batch in batches:
        for line, file, start in zip(*(c.to_pylist() for c in batch.columns)):
            schema, bad = found.get((file, start), (T.StructType([]), 0))
            try:
                doc = json.loads(line)
                bad += not isinstance(doc, dict)
                schema = merged_schema(schema, infer_schema([doc])) if isinstance(doc, dict) else schema
            except ValueError:
                bad += 1
            found[file, start] = schema, bad
    rows = [(file, start, schema.json(), bad) for (file, start), (schema, bad) in found.items()]
    kinds = {"file": pa.string(), "start": pa.int64(), "schema": pa.string(), "bad": pa.int64()}
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds.values())], list(kinds))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one to a line; a field's type is the first that it has by file and offset, whichever line that is in.

    One distributed pass over all lines finds the types; the driver merges a line for each stretch of a file that
    a task reads. Blank lines are no documents; a line that is no object is an error."""
    lines = ship(spark).read.text(path).filter(F.trim("value") != "")
    where = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    parts = where.mapInArrow(_schemas, "file string, start long, schema string, bad long").collect()
    bad = sum(r["bad"] for r in parts)
    if bad:
        raise QueryError(f"{bad} lines of {path} are no JSON objects")
    schema = T.StructType([])
    for r in sorted(parts, key=lambda r: (r["file"], r["start"])):
        schema = merged_schema(schema, T.StructType.fromJson(json.loads(r["schema"])))
    return lines.select(F.from_json("value", without_void(schema)).alias("d")).select("d.*")


def decode(body: str | bytes) -> list[dict]:
    """The documents of a request's body."""
    docs = json.loads(body)
    return docs if isinstance(docs, list) else [docs]


def write_results(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None) -> None:
    writer = df.write.format(kind).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object for each row, in `value`, columns in order."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))

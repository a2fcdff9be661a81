"""Operator 1: token ids of documents in files of directly addressable codes."""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import basic, get_file, prepare, put_file, reader_of, shared_path, texts_of
from .dac import DacFile, DacShard, dac_file
from .encoding import END, encoder

_DONE = "shard int, uri string, n_docs long, n_tokens long, n_bytes long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str) -> list[dict]:
    """Writes the ids of all documents, each ended by id 1, in ascending doc_id order (null first).

    One file per range of doc_id, written whole by one task under a name that depends
    on the range alone, so a repeated task replaces its file by an equal one. A text that
    is null counts as empty; documents with equal doc_id follow each other in the order of
    their texts; other columns are ignored. Returns the manifest (a line per file, with
    the number of ids before it), also written beside the files."""
    spark = prepare(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, parts, ids, ends, total = encoder(vocabulary), [], [], [], 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            for text in texts_of(batch.column(1)):
                packed = enc.encode(text)
                total += len(packed) // 4 + 1
                parts += (packed, END)
                ends.append(total)
        if not ids:
            return
        values = np.frombuffer(b"".join(parts), "<u4")
        parts.clear()
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:07d}.dac"
        chunks = dac_file(values, ids, np.array(ends, np.uint64))
        put_file(uri, chunks)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [uri], "n_docs": [len(ids)], "n_tokens": [total], "n_bytes": [sum(map(len, chunks))]})

    keyed = basic(docs, "doc_id", "text").withColumn("_h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    # One line per file: bounded by the number of tasks, whatever the number of documents.
    manifest = sorted((r.asDict() for r in ordered.mapInArrow(write, _DONE).collect()), key=lambda m: m["shard"])
    before = 0
    for line in manifest:
        line["before"] = before
        before += line["n_tokens"]
    put_file(f"{folder}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def read_token_files(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Per document, from the files: doc_id, ids before it, its number of ids, their crc32."""
    prepare(spark)
    if not manifest:
        return spark.createDataFrame([], _READ)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = DacShard(get_file(uri))
                ends = shard.ends
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                crc = [zlib.crc32(shard.slice(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                ids = pa.array(shard.doc_ids, mask=shard.there == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts + before), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(m["uri"], m["before"]) for m in manifest], "uri string, before long")
    return files.coalesce(1).repartition(len(manifest)).mapInArrow(read, _READ)


def token_at(manifest: list[dict], position: int) -> int:
    """The id at a place in the whole sequence: its file by bisection of the manifest, then a few bytes of that file's levels."""
    k = bisect.bisect_right([m["before"] for m in manifest], position) - 1
    if k < 0 or position >= manifest[k]["before"] + manifest[k]["n_tokens"]:
        raise IndexError(position)
    return DacFile(reader_of(manifest[k]["uri"])).at(position - manifest[k]["before"])


def token_output(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Encodes, writes and reads back. Empty tables give no rows and no files."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, folder or shared_path(spark, "tokens"), vocabulary))

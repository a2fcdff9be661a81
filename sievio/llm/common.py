"""What the operators share: the cluster's shared folder, staged tables and worker set-up."""

from __future__ import annotations

import atexit
import os
import posixpath
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import ship

def prepare(spark: SparkSession) -> SparkSession:
    """Gives this package to the session's Python workers, wherever these run."""
    return ship(spark)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that setting is absent, as in local tests, a folder of this
    machine is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="sievio-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = "file://" + own
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:
        root = ("file://" if root.startswith("/") else "file:") + root
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a shuffle may bring together; commoner keys are joined by broadcast.
HOT_KEY = 1 << 16


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with a table that has one line for each key and the number `n` of rows that have it.

    Lines of keys with more than HOT_KEY rows, of which there is one for every HOT_KEY rows at most, are broadcast,
    and their rows stay where they are; so no task gets more of a key. `n` is left out."""
    table = table.withColumn("_there", F.lit(True))
    common = rows.join(F.broadcast(table.filter(F.col(n) > HOT_KEY)), key, "left")
    rest = common.filter("_there is null").select(*rows.columns).join(table.filter(F.col(n) <= HOT_KEY), key, how)
    return common.filter("_there").unionByName(rest).drop("_there", n)


def basic(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns of docs in the types that the operators work with; any others, whatever their names, are left out."""
    kinds = {"doc_id": "long", "vec_id": "long", "page_id": "long"}
    return docs.select(*[F.col(n).cast(kinds.get(n, "string")).alias(n) for n in names])


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others as one, `_rest`, so that their names clash with none of an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*rest, F.lit(0).alias("_")).alias("_rest") if "_" not in docs.columns else F.struct(*rest).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], names: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c) if c in names else F.col(f"_rest.`{c}`").alias(c) for c in columns])


def opened(uri: str):
    """(file system, path) of a shared folder's file."""
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks) -> None:
    """Writes a file whole or not at all: under a name of its own, then renamed."""
    fs, path = opened(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as out:
        for c in chunks:
            out.write(c)
    fs.move(own, path)


def get_file(uri: str) -> pa.Buffer:
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def has_file(uri: str) -> bool:
    fs, path = opened(uri)
    return fs.get_file_info(path).type == pafs.FileType.File


def reader_of(uri: str):
    """read(offset, n) of a file where it lies."""
    fs, path = opened(uri)
    f = fs.open_input_file(path)
    return lambda offset, n: f.read_at(n, offset)


def texts_of(column: pa.Array) -> list[str]:
    """A text column as a list; null is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def worker_threads_off() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

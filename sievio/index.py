"""An index: documents as an immutable DataFrame, with derived postings and vocabulary."""

from __future__ import annotations

import base64
import json
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .errors import NotFound, QueryError, SearchError
from .operators import match
from .plans.mapping import INTERNAL, Mapping, infer_schema, merged_schema, without_void
from .plans.search import Search, multi_search
from .plans.settings import Settings
from .sources.readers import as_json
from .sources.staging import ship, staged

MAX_INDEX_NAME = 128
#: Changes that may wait for their turn; changes by table after which the documents are written as one.
MAX_JOBS, MAX_CHANGES = 4096, 8


class _Jobs:
    """Changes of an index, one at a time in the order in which they came; one too many is refused."""

    def __init__(self, most: int):
        self.most, self.waiting, self.next, self.now = most, 0, 0, 0
        self.turn = threading.Condition()

    def __enter__(self) -> None:
        with self.turn:
            if self.waiting >= self.most:
                raise SearchError("Too many jobs", 429)
            self.waiting += 1
            own, self.next = self.next, self.next + 1
            self.turn.wait_for(lambda: self.now == own)

    def __exit__(self, *_) -> None:
        with self.turn:
            self.waiting, self.now = self.waiting - 1, self.now + 1
            self.turn.notify_all()


class SearchIndex:
    """Documents that can be searched: a table, and single documents on top that the driver keeps.

    Each change makes a new version of the documents; changes go one by one in the order in which they come.
    A single document hides the table's row of its id; a change by table takes the single ones into the table first."""

    def __init__(self, spark: SparkSession, name: str, settings: dict | None = None, shards: int = 1, analyzer: str = "default", allow_duplicates: bool = False):
        if not name or len(name) > MAX_INDEX_NAME:
            raise QueryError("Invalid index name")
        self.spark, self.name, self.shards, self.analyzer, self.allow_duplicates = ship(spark), name, shards, analyzer, allow_duplicates
        self.settings = Settings().changed(settings or {})
        self._base: DataFrame | None = None
        self._start: int | None = 0  # the largest ordinal of the table, None if it isn't known yet
        self._changes = 0  # by table, since it was last written whole
        self._gone: set[str] = set()  # ids of the table's rows that are deleted or replaced
        self._docs: DataFrame | None = None
        self._ids: dict[str, int] = {}
        self._rows: dict[int, dict] = {}
        self._free: list[int] = []
        self._jobs = _Jobs(MAX_JOBS)
        self._posts: DataFrame | None = None  # saved ones
        self._blocks: DataFrame | None = None
        self._words: DataFrame | None = None
        self._frozen: T.StructType | None = None

    # -- made from a table -------------------------------------------------

    @classmethod
    def over(cls, table: DataFrame, name: str, key: str, settings: dict | None = None, shards: int = 1, analyzer: str = "default") -> SearchIndex:
        """An index over a table of any size; `key` is its unique integer column and serves as id and ordinal."""
        index = cls(table.sparkSession, name, settings, shards, analyzer)
        index._start = None
        index._base = table.select(F.col(key).cast("string").alias("_id"), F.col(key).cast("long").alias("_docid"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)).cast("int").alias("_shard"), *[F.col(f"`{c}`") for c in table.columns if c not in INTERNAL])
        return index

    def saved(self, path: str) -> SearchIndex:
        """This index over tables written to `path`: documents by ordinal, postings by word, so that a word's
        predicate reads its own row groups only, and the vocabulary."""
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        self.postings().repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/postings")
        out = self._over_saved(path)
        match.vocabulary(out.postings()).write.mode("overwrite").parquet(f"{path}/vocabulary")
        out._words = self.spark.read.parquet(f"{path}/vocabulary")
        (self.spark.createDataFrame([(json.dumps(self.settings.as_dict()),)], "settings string").write.mode("overwrite").json(f"{path}/settings"))
        return out

    def loaded(self, path: str) -> SearchIndex:
        """An index like this one over the tables that `saved` wrote."""
        out = self._over_saved(path)
        out._words = self.spark.read.parquet(f"{path}/vocabulary")
        return out

    def _over_saved(self, path: str) -> SearchIndex:
        out = SearchIndex(self.spark, self.name, None, self.shards, self.analyzer)
        out.settings = self.settings
        out._base, out._start = self.spark.read.parquet(f"{path}/documents"), None
        out._posts = self.spark.read.parquet(f"{path}/postings")
        return out

    # -- derived tables ----------------------------------------------------

    @property
    def documents(self) -> DataFrame:
        """_id, _docid, _shard and the source columns."""
        if self._docs is None:
            if self._base is None:
                self._docs = self._built()
            else:
                kept = self._left(self._base, self._gone)
                self._docs = united(kept, self._built()) if self._rows else kept
        return self._docs

    def _left(self, table: DataFrame, ids: set[str]) -> DataFrame:
        if not ids:
            return table
        if len(ids) <= 100:
            return table.filter(~F.col("_id").isin(sorted(ids)))
        gone = self.spark.createDataFrame([(i,) for i in sorted(ids)], "_id string")
        return table.join(gone, "_id", "left_anti")

    @property
    def mapping(self) -> Mapping:
        source = T.StructType([f for f in self.documents.schema.fields if f.name not in INTERNAL])
        return Mapping.infer(source, self.settings.indexedFields, self.settings.facetFields)

    def postings(self) -> DataFrame:
        """(_docid, priority, word, position)"""
        return self._posts if self._posts is not None else match.spread(self._kept())

    def _kept(self) -> DataFrame:
        """The postings as blocks, kept between queries."""
        if self._blocks is None:
            self._blocks = match.blocks(self.documents, self.mapping, self.analyzer).persist()
        return self._blocks

    def lookup(self) -> tuple[DataFrame, DataFrame | None]:
        """What queries find words in: saved postings and their vocabulary, or blocks, which need none."""
        return (self._posts, self.vocabulary()) if self._posts is not None else (self._kept(), None)

    def vocabulary(self) -> DataFrame:
        """(word, df)"""
        if self._words is None:
            self._words = match.vocabulary(self.postings()).persist()
        return self._words

    def _changed(self) -> None:
        for df in (self._blocks, self._words):
            if df is not None:
                df.unpersist()
        self._docs = self._posts = self._blocks = self._words = None

    # -- documents, one by one: kept by the driver until a change by table ------

    def _schema(self) -> T.StructType:
        """Of the single documents; frozen once every configured field has a type. The table's types come first."""
        if self._frozen is None:
            known = T.StructType([f for f in self._base.schema.fields if f.name not in INTERNAL]) if self._base is not None else T.StructType([])
            found = merged_schema(known, infer_schema(self._rows[i] for i in sorted(self._rows)))
            if Mapping.infer(found, self.settings.indexedFields, self.settings.facetFields).ready:
                self._frozen = found
            return found
        return self._frozen

    def _built(self) -> DataFrame:
        types = self._schema()
        source = T.StructType([f for f in types.fields if f.name not in INTERNAL])
        rows = [(r["_id"], i, json.dumps({k: v for k, v in r.items() if k != "_id"})) for i, r in sorted(self._rows.items())]
        raw = self.spark.createDataFrame(rows, "_id string, _docid long, _json string")
        shard = F.pmod(F.xxhash64("_id"), F.lit(self.shards)).cast("int").alias("_shard")
        fields = [F.col(f"_s.`{f.name}`").alias(f.name) for f in source.fields]
        parsed = raw.withColumn("_s", F.from_json("_json", without_void(source))) if source.fields else raw
        return parsed.select("_id", "_docid", shard, *fields)

    def add(self, docs: dict | list[dict] | DataFrame) -> list[str]:
        """Adds documents; the ids. Single ones and tables of any size may follow each other in any order."""
        if isinstance(docs, DataFrame):
            self.merge_table(docs, keep_old=self.allow_duplicates)
            return []
        if isinstance(docs, dict):
            docs = [docs]
        if not isinstance(docs, list) or not all(isinstance(d, dict) for d in docs):
            raise QueryError("Documents must be an object, or a list of objects")
        with self._jobs:
            return [self._put(str(d.get("_id") or _new_id()), d, self.allow_duplicates) for d in docs]

    def _put(self, id_: str, doc: dict, twice: bool = False) -> str:
        if not twice:
            if id_ in self._ids:
                self._drop(id_)
            if self._base is not None:
                self._gone.add(id_)
        ordinal = self._free.pop(0) if self._free else self._largest() + len(self._rows) + 1
        self._ids[id_], self._rows[ordinal] = ordinal, {**doc, "_id": id_}
        self._changed()
        return id_

    def _drop(self, id_: str) -> None:
        ordinal = self._ids.pop(id_)
        del self._rows[ordinal]
        self._free = sorted([*self._free, ordinal])
        self._changed()

    def _to_table(self) -> DataFrame:
        """The documents as one table, without single ones."""
        docs = self.documents
        self._base, self._ids, self._rows, self._free, self._gone, self._frozen = docs, {}, {}, [], set(), None
        return docs

    def _set_base(self, docs: DataFrame) -> None:
        """A new version of the table. Every few changes it is written, so that plans don't grow with their number."""
        self._changed()
        self._changes += 1
        if self._changes >= MAX_CHANGES:
            docs, self._changes = staged(docs, "documents"), 0
        self._base, self._start = docs, None

    def _largest(self) -> int:
        if self._start is None:
            self._start = self._base.agg(F.max("_docid")).first()[0] or 0
        return self._start

    def use_table(self, documents: DataFrame) -> None:
        """Takes a table with _id, _docid and _shard as the documents, in place of all there are."""
        with self._jobs:
            self._ids, self._rows, self._free, self._gone, self._frozen = {}, {}, [], set(), None
            self._changed()
            self._base, self._start, self._changes = documents, None, 0

    def merge_table(self, table: DataFrame, keep_old: bool = False, order: str | None = None) -> None:
        """Upserts a table: rows of equal `_id` are replaced (or stay beside, if keep_old); rows without get one.

        Of several rows of an id the last by the column `order` counts, or else the one with the greatest hash. New columns
        are added; a column that is there keeps its type, and values that don't fit it are null. Ordinals go on after the
        largest; they and made-up ids are written before anything reads them."""
        with self._jobs:
            old = self._to_table()
            made = F.expr("uuid()")
            new = table.withColumn("_id", F.coalesce(F.col("_id").cast("string"), made) if "_id" in table.columns else made)
            if "_id" in table.columns and not keep_old:
                new = latest(new, "_id", order)
            start = max(old.agg(F.max("_docid")).first()[0] or 0, 0)
            new = new.drop("_docid", "_shard").withColumn("_docid", F.monotonically_increasing_id() + start + 1).withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(self.shards)).cast("int"))
            new = staged(new, "added")
            rest = old if keep_old else old.join(new.select("_id"), "_id", "left_anti")
            self._set_base(united(rest, new))

    def patch_table(self, changes: DataFrame, order: str | None = None) -> None:
        """Changes the columns that a table with `_id` has, in the documents of these ids; a null leaves a value as it is.

        A column that the documents lack is added. Of several rows of an id one counts, as in merge_table."""
        with self._jobs:
            old = self._to_table()
            names = [c for c in changes.columns if c not in INTERNAL and c != order]
            new = latest(changes.withColumn("_id", F.col("_id").cast("string")), "_id", order).select("_id", *[F.col(f"`{c}`").alias(f"_new_{c}") for c in names])
            joined = old.join(new, "_id", "left")
            known = {f.name: f.dataType for f in old.schema.fields}
            was = [F.coalesce(_as_type(F.col(f"`_new_{c}`"), dict(zip(names, (changes.schema[n].dataType for n in names)))[c], known[c]), F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in old.columns]
            self._set_base(joined.select(*was, *[F.col(f"`_new_{c}`").alias(c) for c in names if c not in known]))

    def delete_table(self, ids: DataFrame) -> None:
        """Removes the documents of a table's `_id` column; ids that no document has, and nulls, change nothing."""
        with self._jobs:
            self._set_base(self._to_table().join(ids.select(F.col("_id").cast("string").alias("_id")), "_id", "left_anti"))

    def _in_table(self, id_: str) -> DataFrame | None:
        return None if self._base is None or id_ in self._gone else self._base.filter(F.col("_id") == id_)

    def get(self, id_: str) -> dict:
        if id_ in self._ids:
            return dict(self._rows[self._ids[id_]])
        found = self._in_table(id_)
        row = None if found is None else as_json(found.drop("_docid", "_shard")).first()
        if row is None:
            raise NotFound("Document not found")
        return json.loads(row[0])

    def replace(self, id_: str, doc: dict) -> str:
        """Puts a document in the place of the one with that id, if any; the id of the path wins."""
        with self._jobs:
            return self._put(id_, doc)

    def patch(self, id_: str, changes: dict) -> str:
        """Changes top-level fields of a document."""
        with self._jobs:
            return self._put(id_, {**self.get(id_), **changes})

    def delete(self, id_: str) -> None:
        with self._jobs:
            if id_ in self._ids:
                self._drop(id_)
                return
            found = self._in_table(id_)
            if found is None or found.isEmpty():
                raise NotFound("Document not found")
            self._gone.add(id_)
            self._changed()

    def clear(self) -> None:
        """Removes all documents; settings and types stay."""
        with self._jobs:
            if self._base is not None:
                docs = self._to_table().limit(0)
                self._changed()
                self._base, self._start = docs, 0
                return
            self._schema()
            self._ids, self._rows, self._free = {}, {}, []
            self._changed()

    # -- queries and introspection -----------------------------------------

    def configure(self, settings: dict) -> None:
        self.settings = self.settings.changed(settings)
        self._frozen = None
        self._changed()

    def query(self, query: dict) -> Search:
        return Search(self, query)

    def search(self, query: dict):
        """The response to a query, or to each of {"requests": [...]}."""
        if isinstance(query, dict) and isinstance(query.get("requests"), list):
            return multi_search(self, query["requests"])
        return Search(self, query).response()

    def shard_counts(self) -> DataFrame:
        return self.documents.groupBy("_shard").agg(F.count("*").alias("numDocuments"))

    def size_stats(self) -> DataFrame:
        """min, max, sum, avg length of the documents as JSON, per shard."""
        source = [c for c in self.documents.columns if c not in ("_docid", "_shard")]
        size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in source])))
        return self.documents.select("_shard", size.alias("size")).groupBy("_shard").agg(F.min("size").alias("min"), F.max("size").alias("max"), F.sum("size").alias("sum"), F.avg("size").alias("avg"))

    def info(self) -> dict:
        counts = {r["_shard"]: r["numDocuments"] for r in self.shard_counts().collect()}
        return {"name": self.name, "numJobs": self._jobs.waiting, "numDocuments": sum(counts.values()), "numShards": self.shards, "shards": [{"numDocuments": counts.get(i, 0)} for i in range(self.shards)]}

    def stats(self) -> dict:
        stats = {r["_shard"]: r.asDict() for r in self.size_stats().collect()}
        out = self.info()
        for i, shard in enumerate(out["shards"]):
            shard |= {k: v for k, v in stats.get(i, {}).items() if k != "_shard"}
        return out

    def save_metadata(self, folder: str) -> None:
        """settings and mapping, one line of JSON each, beside each other in a folder of any file system."""
        for name, value in (("settings", self.settings.as_dict()), ("mapping", self.mapping.as_dict())):
            self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")

    def read_metadata(self, folder: str) -> tuple[dict, dict]:
        """The settings and the mapping that save_metadata wrote."""
        return tuple(json.loads(self.spark.read.text(f"{folder}/{name}").first()[0]) for name in ("settings", "mapping"))


def _as_type(col: Column, own: T.DataType, wanted: T.DataType) -> Column:
    """A column in the type that a field has; what doesn't fit is null."""
    if own == wanted or own.simpleString() == wanted.simpleString():
        return col
    if isinstance(own, (T.StructType, T.ArrayType, T.MapType)) or isinstance(wanted, (T.StructType, T.ArrayType, T.MapType)):
        if isinstance(own, (T.StructType, T.ArrayType, T.MapType)) and isinstance(wanted, (T.StructType, T.ArrayType, T.MapType)):
            return F.from_json(F.to_json(col), wanted)
        return F.lit(None).cast(wanted)
    return col.try_cast(wanted)


def united(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows; a column of both has the type that it has in the first, unless that is void."""
    known = {f.name: f.dataType for f in old.schema.fields if not isinstance(f.dataType, T.NullType)}
    same = [_as_type(F.col(f"`{f.name}`"), f.dataType, known[f.name]).alias(f.name) if f.name in known else F.col(f"`{f.name}`") for f in new.schema.fields]
    return old.unionByName(new.select(*same), allowMissingColumns=True)


def _new_id() -> str:
    return base64.urlsafe_b64encode(time.time_ns().to_bytes(8, "big") + uuid.uuid4().bytes[:7]).decode()


def latest(table: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The row of each key that comes last by `order`, ties, and all without it, by a hash of the row."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns if c != key])))
    w = Window.partitionBy(key).orderBy(*([F.desc(order)] if order else []), row.desc())
    return table.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

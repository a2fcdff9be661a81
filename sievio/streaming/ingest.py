"""Documents from a stream into an index's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..index import SearchIndex, latest, united

#: Ordinals of a batch: as many as a task's rows in monotonically_increasing_id have, times its tasks.
_BATCH = 1 << 46


def ingest(stream: DataFrame, index: SearchIndex, checkpoint: str, available_now: bool = True, order: str | None = None) -> StreamingQuery:
    """Upserts each micro-batch, which has an `_id` column, into the index.

    A batch is written under its number beside the checkpoint before its offsets are committed, and the index
    reads all batches written there: a batch that is repeated after a failure replaces itself, and an index that is
    made anew with the same checkpoint has the documents of all earlier batches. Of several rows of an id those of the
    latest batch count, within a batch as in merge_table. The plan is the same for any number of batches."""
    spark, folder = stream.sparkSession, f"{checkpoint}/documents"
    base = index.documents
    shard = F.pmod(F.xxhash64("_id"), F.lit(index.shards)).cast("int")

    def attach() -> None:
        rows = spark.read.option("mergeSchema", "true").parquet(folder)
        new = latest(rows, "_id", "_batch").drop("_batch").withColumn("_shard", shard)
        index.use_table(united(base.join(new.select("_id"), "_id", "left_anti"), new))

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_id", F.coalesce(F.col("_id").cast("string"), F.expr("uuid()")))
        rows = latest(rows, "_id", order).withColumn("_docid", F.monotonically_increasing_id() + F.lit((number + 1) * _BATCH))
        rows.write.mode("overwrite").parquet(f"{folder}/_batch={number}")
        attach()

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        attach()
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

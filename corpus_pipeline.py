"""A corpus pipeline over `documents`: toxicity, near duplicates, secrets, mixing, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; it works on all rows that its
predecessor kept, and its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievio.llm.common import packed, staged, unpacked
from sievio.llm.encoding import vocabulary
from sievio.llm.mixing import CURRICULUM, training_order
from sievio.llm.packing import pack
from sievio.llm.secrets import redacted
from sievio.llm.simhash import near_duplicates
from sievio.llm.toxicity import THRESHOLD, score, train

#: No SQL expresses the learned lexicon, the fingerprints or the packing.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Scores are learned from labels on the rows that aren't held out.

    A null or empty text is scored as one without words and stays; texts of any length are scored whole. Repeated
    rows and ties share a score and a fate. An empty table stays empty; without usable labels no row is scored
    as toxic by anything, so all stay. Columns as in docs, whatever others there are."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model["weights"]:
        return docs
    return unpacked(score(packed(docs, "text"), model).filter(F.col("score") < THRESHOLD), docs.columns, ("text",))


#: Ids of rows without doc_id are above all others.
_NO_ID = 1 << 62


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Rows without words (null, empty or blank texts) are one group, as in operator 8. A row without doc_id goes by
    the hash of its text, behind all that have an id. Of repeated rows of one id one stays. Texts of any length
    count whole; an empty table stays empty. Columns as in docs, whatever others there are."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(_NO_ID - 1)))
    rows = near_duplicates(docs.select(own.alias("doc_id"), "text"))
    firsts = staged(rows.filter("doc_id = component_id").select(F.col("doc_id").alias("_own")).distinct(), "first-of-group")
    w = Window.partitionBy("_own").orderBy(F.xxhash64("text"))
    kept, columns = ("doc_id", "text"), docs.columns
    joined = packed(docs, *kept).withColumn("_own", own).join(firsts, "_own").withColumn("_n", F.row_number().over(w))
    return unpacked(joined.filter("_n = 1"), columns, kept)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that are live are replaced, examples that many sources or very many texts hold stay.

    A null or empty text stays as it is, a text of any length is scanned whole. A null source is an owner of its own.
    Repeated rows stay as often as they come. An empty table stays empty. Columns as in docs."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix along the curriculum reads them, in training order.

    A null or empty text has no words and goes with its place in its source; null sources are one source. Repeated
    rows are documents of their own, equal positions go by doc_id. An empty table stays empty. Columns as in docs."""
    return training_order(docs, CURRICULUM)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per piece its place in a sequence of at most 4096 ids.

    A null or empty text is its end id alone; longer texts than a sequence are cut, none is dropped. Repeated rows
    are pieces of their own. An empty table gives no rows; other columns are ignored."""
    return pack(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("simhash near-dedup", near_duplicate), ("secret scans", secret_scan), ("mixing", mixing), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the folder's documents; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

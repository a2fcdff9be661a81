"""The operators' queries over the tables of a folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, mixing
from .embeddings import near_vectors
from .encoding import vocabulary
from .mixing import mix
from .packing import pack
from .pages import learned, main_texts
from .search import ORACLE as search_sql
from .search import search
from .secrets import secrets
from .simhash import near_duplicates
from .substrings import remove_repeats
from .token_output import token_output
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_table(spark, sf_dir, "documents"), vocabulary())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts whose doc_id is divisible by 50 are the queries; all documents are searched."""
    return search(_table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0).withColumn("score", F.round("score", 6))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix along a curriculum whose totals are 5, 2, 1."""
    return mix(_table(spark, sf_dir, "documents"), mixing.CURRICULUM).withColumns({c: F.round(c, 9) for c in ("position", "last_position")})


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights are learned from the pages whose addresses name documents; every page is read with them."""
    pages = _table(spark, sf_dir, "pages")
    return main_texts(pages, learned(pages, _table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_toxicity, op3_embedding_dedup, op4_suffix_dedup, op5_exact_topk, op6_best_fit_packing, op7_secret_scan, op8_simhash, op9_source_mixing, op10_html_extraction)}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": embeddings.ORACLE, "op5_exact_topk": search_sql, "op9_source_mixing": mixing.ORACLE}

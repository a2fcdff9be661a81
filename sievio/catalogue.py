"""A query for every operator over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .index import SearchIndex
from .operators import facets as facet_ops
from .operators import match
from .operators.rank import RANK
from .sources.readers import read_documents, read_table, write_results
from .sources.staging import shared_root
from .streaming.ingest import ingest

_PART = {"indexedFields": ["p_name", "p_size", "p_retailprice"], "facetFields": ["p_brand", "p_type"]}
_indexes: dict[tuple, SearchIndex] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _made(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], SearchIndex]) -> SearchIndex:
    """An index is made once for a session and folder; its postings are kept between queries, as an index's are."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _indexes:
        _indexes[key] = make()
    return _indexes[key]


def part(spark, sf_dir) -> SearchIndex:
    return _made(spark, sf_dir, "part", lambda: SearchIndex.over(table(spark, sf_dir, "part"), "part", "p_partkey", _PART))


def part_words(spark, sf_dir) -> SearchIndex:
    """part with the words of p_name as a list."""
    t = table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))
    settings = {"indexedFields": ["words", "p_size"], "facetFields": ["words", "p_brand"]}
    return _made(spark, sf_dir, "part_words", lambda: SearchIndex.over(t, "part_words", "p_partkey", settings))


def documents(spark, sf_dir) -> SearchIndex:
    settings = {"indexedFields": ["text", "n_chars"], "facetFields": ["lang", "source"]}
    return _made(spark, sf_dir, "documents", lambda: SearchIndex.over(table(spark, sf_dir, "documents"), "documents", "doc_id", settings))


def events(spark, sf_dir) -> SearchIndex:
    t = table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k double"))
    settings = {"indexedFields": ["value", "user_id", "props.k"], "facetFields": ["event_type"]}
    return _made(spark, sf_dir, "events", lambda: SearchIndex.over(t, "events", "event_id", settings))


def labels(spark, sf_dir) -> SearchIndex:
    """labels with booleans; quality is missing where a document is toxic."""
    t = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"), F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("good"), F.when(F.col("quality") == 1, F.col("doc_id").cast("double")).alias("n"))
    return _made(spark, sf_dir, "labels", lambda: SearchIndex.over(t, "labels", "doc_id", {"indexedFields": ["toxic", "good", "n"]}))


def vectors(spark, sf_dir) -> SearchIndex:
    """embeddings: all components, times 100 and rounded down, as a list of numbers."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("double")).alias("v"))
    return _made(spark, sf_dir, "vectors", lambda: SearchIndex.over(t, "vectors", "vec_id", {"indexedFields": ["v"], "facetFields": ["v"]}))


def nested(spark, sf_dir) -> SearchIndex:
    """part with objects and lists of objects."""
    t = table(spark, sf_dir, "part").select(
        "p_partkey", F.struct("p_name", "p_size", F.struct("p_brand").alias("maker")).alias("item"),
        F.array(F.struct(F.col("p_type").alias("kind"), F.col("p_size").alias("n")), F.struct(F.lit("BASE").alias("kind"), (F.col("p_size") + 1).alias("n"))).alias("parts"),
    )
    settings = {"indexedFields": ["item.p_name", "item.p_size", "parts.n"], "facetFields": ["item.maker.p_brand", "parts.kind"]}
    return _made(spark, sf_dir, "nested", lambda: SearchIndex.over(t, "nested", "p_partkey", settings))


def abbreviations(spark, sf_dir) -> SearchIndex:
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 2 == 0, "U.S.A. don't ").otherwise("USB dont. "), "p_name").alias("text"))
    return _made(spark, sf_dir, "abbreviations", lambda: SearchIndex.over(t, "abbreviations", "p_partkey", {"indexedFields": ["text"]}))


def two_fields(spark, sf_dir) -> SearchIndex:
    return _made(spark, sf_dir, "two_fields", lambda: SearchIndex.over(table(spark, sf_dir, "part"), "two_fields", "p_partkey", {"indexedFields": ["p_type", "p_name"]}))


def spaced(spark, sf_dir) -> SearchIndex:
    return _made(spark, sf_dir, "spaced", lambda: SearchIndex.over(table(spark, sf_dir, "part"), "spaced", "p_partkey", {"indexedFields": ["p_name"]}, analyzer="whitespace"))


_KEYS = {"part": "p_partkey", "part_words": "p_partkey", "documents": "doc_id", "events": "event_id", "labels": "doc_id", "vectors": "vec_id", "nested": "p_partkey", "abbreviations": "p_partkey", "two_fields": "p_partkey", "spaced": "p_partkey"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def _matches(name: str, index: Callable, query: dict, sql: str) -> None:
    """A query of which the keys of all matches are compared."""
    key = _KEYS[index.__name__]
    _add(name, lambda s, d: index(s, d).query(query).matches().select(key), sql)


def _flt(name: str, index: Callable, spec, sql: str) -> None:
    _matches(name, index, {"filter": spec}, sql)


_P = "SELECT p_partkey FROM part WHERE "
_flt("flt_num_eq", part, {"p_size": 5}, _P + "p_size = 5")
_flt("flt_num_ne", part, {"p_size": {"$ne": 5}}, _P + "p_size <> 5")
_flt("flt_num_gt", part, {"p_size": {"$gt": 40}}, _P + "p_size > 40")
_flt("flt_num_gte", part, {"p_retailprice": {"$gte": 915}}, _P + "p_retailprice >= 915")
_flt("flt_num_lt", part, {"p_size": {"$lt": 7}}, _P + "p_size < 7")
_flt("flt_num_lte", part, {"p_size": {"$lte": 7}}, _P + "p_size <= 7")
_flt("flt_num_range", part, {"p_size": {"$gt": 10, "$lt": 20}}, _P + "p_size > 10 AND p_size < 20")
_flt("flt_str_eq", part, {"p_brand": "Brand#12"}, _P + "p_brand = 'Brand#12'")
_flt("flt_str_ne", part, {"p_brand": {"$ne": "Brand#12"}}, _P + "p_brand <> 'Brand#12'")
_flt("flt_bool_eq", labels, {"toxic": True}, "SELECT doc_id FROM labels WHERE toxic = 1")
_flt("flt_bool_ne", labels, {"good": {"$ne": True}}, "SELECT doc_id FROM labels WHERE NOT (toxic = 0 AND quality = 1)")
_flt("flt_in", part, {"p_brand": {"$in": ["Brand#1", "Brand#2"]}}, _P + "p_brand IN ('Brand#1', 'Brand#2')")
_flt("flt_nin", part, {"p_size": {"$nin": [1, 2, 3]}}, _P + "p_size NOT IN (1, 2, 3)")
_flt("flt_value_and", part_words, {"words": {"$and": ["red", "rod"]}}, _P + "list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'rod')")
_flt("flt_value_or_ops", part, {"p_size": {"$or": [{"$gt": 45}, {"$lt": 3}, 10]}}, _P + "p_size > 45 OR p_size < 3 OR p_size = 10")
_flt("flt_top_or", part, {"$or": [{"p_size": 2}, {"p_type": "PROMO"}]}, _P + "p_size = 2 OR p_type = 'PROMO'")
_flt("flt_top_nor", part, {"$nin": [{"p_size": {"$gt": 5}}, {"p_type": "PROMO"}]}, _P + "NOT (p_size > 5 OR p_type = 'PROMO')")
_flt("flt_nested_bool", part, {"$and": [{"$or": [{"p_size": {"$lte": 10}}, {"p_brand": "Brand#3"}]}, {"$nin": [{"p_type": "SMALL"}]}]}, _P + "(p_size <= 10 OR p_brand = 'Brand#3') AND NOT p_type = 'SMALL'")
_flt("flt_multi_field_and", part, {"p_type": "LARGE", "p_size": {"$gte": 25}}, _P + "p_type = 'LARGE' AND p_size >= 25")
_flt("flt_dotted", events, {"props.k": {"$lt": 20}, "event_type": "click"}, "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) < 20 AND event_type = 'click'")
_flt("flt_obj_array", nested, {"parts.n": 8, "parts.kind": "PROMO"}, _P + "(p_size = 8 OR p_size = 7) AND p_type = 'PROMO'")
_LIST = "list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 100))"
_V = f"SELECT vec_id FROM (SELECT vec_id, {_LIST} AS v FROM embeddings) WHERE "
_flt("flt_numlist_eq", vectors, {"v": 5}, _V + "list_contains(v, 5.0)")
_flt("flt_numlist_gt", vectors, {"v": {"$gt": 12}}, _V + "len(list_filter(v, lambda x: x > 12)) > 0")
_flt("flt_numlist_and_array", vectors, {"v": [{"$gt": 25}, {"$lt": -25}]}, _V + "len(list_filter(v, lambda x: x > 25)) > 0 AND len(list_filter(v, lambda x: x < -25)) > 0")
_flt("flt_numlist_range", vectors, {"v": {"$gt": 30, "$lt": -20}}, _V + "len(list_filter(v, lambda x: x > 30)) > 0 AND len(list_filter(v, lambda x: x < -20)) > 0")
_flt("flt_two_unlike_keys", part, {"p_size": {"$gt": 10, "$ne": 20}}, _P + "p_size > 10 AND p_size <> 20")
_flt("flt_three_keys", part, {"p_size": {"$gt": 10, "$lt": 40, "$ne": 20}}, _P + "p_size > 10 AND p_size < 40 AND p_size <> 20")
_flt("flt_empty", part, {}, "SELECT p_partkey FROM part")
_flt("flt_no_object", part, "none", "SELECT p_partkey FROM part")
_flt("flt_missing_ne", labels, {"n": {"$ne": 4}}, "SELECT doc_id FROM labels WHERE NOT coalesce(quality = 1 AND doc_id = 4, false)")
_flt("flt_empty_lists", part, {"$or": [{"p_size": {"$or": []}}, {"p_size": {"$nin": []}, "p_type": "PROMO"}]}, _P + "p_type = 'PROMO'")

_HAS = "len(list_filter(string_split(p_name, ' '), lambda w: {})) > 0"
_NEAR = "least(damerau_levenshtein('{t}', left(w, {a})), damerau_levenshtein('{t}', left(w, {b})), damerau_levenshtein('{t}', left(w, {c}))) <= 1"


def _prefix1(t: str) -> str:
    return _NEAR.format(t=t, a=len(t) - 1, b=len(t), c=len(t) + 1)


_matches("txt_match_all", part, {"q": ""}, "SELECT p_partkey FROM part")
_matches("txt_prefix_short", part, {"q": "wid"}, _P + _HAS.format("starts_with(w, 'wid')"))
_matches("txt_prefix_long", part, {"q": "widge"}, _P + _HAS.format(_prefix1("widge")))
_matches("txt_exact_trailing_space", part, {"q": "red "}, _P + _HAS.format("w = 'red'"))
_matches("txt_fuzzy_1", part, {"q": "bolr "}, _P + _HAS.format("damerau_levenshtein('bolr', w) <= 1"))
_matches("txt_fuzzy_transposition", part, {"q": "clod "}, _P + _HAS.format("damerau_levenshtein('clod', w) <= 1"))
_TOKENS = "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(replace(text, 'ß', 'ss'))), '[a-z0-9_]+')) AS w FROM documents), "
_matches("txt_fuzzy_2", documents, {"q": "worhtles "}, _TOKENS + "v AS (SELECT w FROM (SELECT DISTINCT w FROM t) WHERE abs(length(w) - 8) <= 2 AND damerau_levenshtein('worhtles', w) <= 2) SELECT DISTINCT doc_id FROM t WHERE w IN (SELECT w FROM v)")
_matches("txt_two_words", part, {"q": "red wid"}, _P + _HAS.format("w = 'red'") + " AND " + _HAS.format("starts_with(w, 'wid')"))
_matches("txt_two_words_joined", part, {"q": "wid get"}, _P + _HAS.format("starts_with(w, 'widget')"))
_matches("txt_three_words", part, {"q": "re d plate"}, _P + _HAS.format("w = 'red'") + " AND " + _HAS.format(_prefix1("plate")))
_matches("txt_no_match", part, {"q": "zzzz"}, _P + "false")
_matches("txt_accent_fold", documents, {"q": "lé "}, _TOKENS + "x AS (SELECT 1) SELECT DISTINCT doc_id FROM t WHERE w = 'le'")
_matches("txt_hyphen", documents, {"q": "BY-NC "}, _TOKENS + "x AS (SELECT 1) SELECT doc_id FROM t WHERE w IN ('by', 'nc') GROUP BY doc_id HAVING count(DISTINCT w) = 2")
_matches("txt_abbrev", abbreviations, {"q": "usa "}, _P + "p_size % 2 = 0")
_matches("txt_apostrophe", abbreviations, {"q": "don't "}, "SELECT p_partkey FROM part")
_matches("txt_string_array", part_words, {"q": "gizmo"}, _P + _HAS.format(_prefix1("gizmo")))
_matches("txt_whitespace_analyzer", spaced, {"q": "hot "}, _P + _HAS.format("w = 'hot'"))
_matches("txt_with_filter", part, {"q": "wid", "filter": {"p_size": {"$gt": 10}}}, _P + _HAS.format("starts_with(w, 'wid')") + " AND p_size > 10")


def _explained(name: str, index: Callable, q: str, sql: str) -> None:
    key = _KEYS[index.__name__]
    _add(name, lambda s, d: index(s, d).query({"q": q}).matches(ranks=True).select(key, *RANK), sql)


def _ranks(typos, proximity, field, position, exact) -> str:
    return f"CAST({typos} AS INTEGER) AS typos, CAST({proximity} AS INTEGER) AS proximity, CAST({field} AS INTEGER) AS field, CAST({position} AS INTEGER) AS position, CAST({exact} AS INTEGER) AS exact"


_PW = "WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest([1, 2]) AS p FROM part) "
_explained("rank_explain_one", part, "gold ", _PW + f"SELECT p_partkey, {_ranks('min(damerau_levenshtein(%s, w))' % repr('gold'), 0, 0, 'arg_min(p, damerau_levenshtein(%s, w) * 10 + p)' % repr('gold'), 0)} FROM t WHERE damerau_levenshtein('gold', w) <= 1 GROUP BY p_partkey")
_explained("rank_explain_two", part, "red gizm", "SELECT p_partkey, " + _ranks(0, 1, 0, 1, 1) + " FROM part WHERE p_name = 'red gizmo'")
_explained("rank_explain_three", part, "re d plate", "SELECT p_partkey, " + _ranks(0, 2, 0, 1, 1) + " FROM part WHERE p_name = 'red plate'")
_explained("rank_field_priority", two_fields, "small", "SELECT p_partkey, " + _ranks(0, 0, "CASE WHEN p_type = 'SMALL' THEN 0 ELSE 1 END", 1, 1) + f" FROM part WHERE p_type = 'SMALL' OR {_HAS.format('w = %s' % repr('small'))}")


def _hits(name: str, index: Callable, query: dict, sql: str, *columns: str) -> None:
    key = _KEYS[index.__name__]
    _add(name, lambda s, d: index(s, d).query({"highlightFields": None, **query}).hits().select(key, *columns), sql)


_W = _HAS.format("starts_with(w, 'widge')")
_hits("rank_custom_algo", part, {"q": "gold ", "rankAlgorithm": ["exact", "position"]}, _PW + "SELECT p_partkey FROM t WHERE damerau_levenshtein('gold', w) <= 1 GROUP BY p_partkey ORDER BY arg_min(p, damerau_levenshtein('gold', w) * 10 + p), p_partkey LIMIT 20")
_hits("rank_by_asc", part, {"q": "widge", "rankBy": {"p_retailprice": "asc"}}, f"SELECT p_partkey, p_retailprice FROM part WHERE {_W} ORDER BY p_retailprice, p_partkey LIMIT 20", "p_retailprice")
_hits("rank_by_desc", part, {"q": "widge", "rankBy": {"p_retailprice": "desc"}}, f"SELECT p_partkey, p_retailprice FROM part WHERE {_W} ORDER BY p_retailprice DESC, p_partkey LIMIT 20", "p_retailprice")
_hits("sort_by_asc", part, {"q": "red ", "sortBy": {"p_size": "asc"}}, _P + _HAS.format("w = 'red'") + " ORDER BY p_size, p_partkey LIMIT 20")
_hits("sort_by_desc", part, {"filter": {"p_type": "PROMO"}, "sortBy": {"p_size": "desc"}}, _P + "p_type = 'PROMO' ORDER BY p_size DESC, p_partkey LIMIT 20")
_hits("page_2", part, {"q": "wid", "page": 2, "hitsPerPage": 10}, _P + _HAS.format("starts_with(w, 'wid')") + " ORDER BY p_partkey LIMIT 10 OFFSET 10")
_hits("page_partial", part, {"filter": {"p_size": 5, "p_type": "PROMO"}, "page": 2, "hitsPerPage": 3}, _P + "p_size = 5 AND p_type = 'PROMO' ORDER BY p_partkey LIMIT 3 OFFSET 3")
_hits("rank_sort_missing_zero", labels, {"sortBy": {"n": "asc"}, "hitsPerPage": 30}, "SELECT doc_id FROM labels ORDER BY CASE WHEN quality = 1 THEN doc_id ELSE 0 END, doc_id LIMIT 30")
_add("hits_meta", lambda s, d: part(s, d).query({"q": "wid", "hitsPerPage": 7, "maxHits": 100, "page": 2}).meta(), f"SELECT count(*) AS totalHits, CAST(greatest(0, least(7, least(100, count(*)) - 7)) AS BIGINT) AS numHits, CAST(2 AS BIGINT) AS page, CAST(ceil(least(100, count(*)) / 7.0) AS BIGINT) AS numPages FROM part WHERE {_HAS.format('starts_with(w, %s)' % repr('wid'))}")


def _facet(name: str, index: Callable, query: dict, sql: str, fields: list[str] | None = None, k: int = 10) -> None:
    def run(s, d):
        i = index(s, d)
        return facet_ops.top_facets(facet_ops.facet_counts(i.query(query).matches(), i.mapping, fields), k).select("field", "key", "count")

    _add(name, run, sql)


_TOP = "SELECT field, key, count FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, key) AS n FROM ({})) WHERE n <= {}"
_facet("facet_string", part, {}, _TOP.format("SELECT 'p_brand' AS field, p_brand AS key, count(*) AS count FROM part GROUP BY p_brand", 10), ["p_brand"])
_facet("facet_string_list", part_words, {}, _TOP.format("SELECT 'words' AS field, w AS key, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w", 10), ["words"])
_facet("facet_number", vectors, {}, _TOP.format(f"SELECT 'v' AS field, printf('%f', x) AS key, count(*) AS count FROM (SELECT unnest({_LIST}) AS x FROM embeddings) GROUP BY x", 10), ["v"])
_BOTH = "SELECT 'p_brand' AS field, p_brand AS key, count(*) AS count FROM part {w} GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part {w} GROUP BY p_type"
_facet("facet_all_fields_topk", part, {}, _TOP.format(_BOTH.format(w=""), 5), k=5)
_WHERE = "WHERE " + _HAS.format("starts_with(w, 'wid')") + " AND p_size > 10"
_facet("facet_with_query_filter", part, {"q": "wid", "filter": {"p_size": {"$gt": 10}}}, _TOP.format(_BOTH.format(w=_WHERE), 10))
_add("facet_only_zero_hits", lambda s, d: part(s, d).query({"filter": {"p_type": "PROMO"}, "hitsPerPage": 0, "maxFacetResults": 3}).facets().select("field", "key", "count"), _TOP.format(_BOTH.format(w="WHERE p_type = 'PROMO'"), 3))


def _agg(name: str, index: Callable, query: dict, sql: str) -> None:
    def run(s, d):
        rows = index(s, d).query(query).aggs()
        return rows.select(*[(F.round(F.col(f"`{c}`"), 3) if dict(rows.dtypes)[c] == "double" else F.col(f"`{c}`")).alias(c.replace(".", "_")) for c in rows.columns])

    _add(name, run, sql)


_agg("agg_max", part, {"aggs": {"a": {"max": {"field": "p_retailprice"}}}}, "SELECT round(max(p_retailprice), 3) AS a_value FROM part")
_agg("agg_min", part, {"aggs": {"a": {"min": {"field": "p_retailprice"}}}}, "SELECT round(min(p_retailprice), 3) AS a_value FROM part")
_agg("agg_avg", part, {"aggs": {"a": {"avg": {"field": "p_size"}}}}, "SELECT round(avg(p_size), 3) AS a_value FROM part")
_agg("agg_stats", part, {"aggs": {"a": {"stats": {"field": "p_size"}}}}, "SELECT round(avg(p_size), 3) AS a_avg, CAST(sum(p_size) AS DOUBLE) AS a_sum, CAST(min(p_size) AS DOUBLE) AS a_min, CAST(max(p_size) AS DOUBLE) AS a_max, count(*) AS a_count FROM part")
_agg("agg_cardinality_str", part, {"aggs": {"a": {"cardinality": {"field": "p_brand"}}}}, "SELECT count(DISTINCT p_brand) AS a_value FROM part")
_agg("agg_cardinality_numlist", vectors, {"aggs": {"a": {"cardinality": {"field": "v"}}}}, f"SELECT count(DISTINCT x) AS a_value FROM (SELECT unnest({_LIST}) AS x FROM embeddings)")
_agg("agg_multi", part, {"aggs": {"a": {"max": {"field": "p_size"}}, "b": {"avg": {"field": "p_retailprice"}}, "c": {"cardinality": {"field": "p_type"}}}}, "SELECT CAST(max(p_size) AS DOUBLE) AS a_value, round(avg(p_retailprice), 3) AS b_value, count(DISTINCT p_type) AS c_value FROM part")
_agg("agg_filtered", part, {"filter": {"p_type": "SMALL"}, "q": "red ", "aggs": {"a": {"stats": {"field": "p_size"}}}}, f"SELECT round(avg(p_size), 3) AS a_avg, CAST(sum(p_size) AS DOUBLE) AS a_sum, CAST(min(p_size) AS DOUBLE) AS a_min, CAST(max(p_size) AS DOUBLE) AS a_max, count(*) AS a_count FROM part WHERE p_type = 'SMALL' AND {_HAS.format('w = %s' % repr('red'))}")
_agg("agg_numlist_last", vectors, {"aggs": {"a": {"max": {"field": "v"}}, "b": {"min": {"field": "v"}}}}, "SELECT max(floor(CAST(embedding[-1] AS DOUBLE) * 100)) AS a_value, min(floor(CAST(embedding[-1] AS DOUBLE) * 100)) AS b_value FROM embeddings")
_agg("agg_missing_zero", labels, {"aggs": {"a": {"avg": {"field": "n"}}, "b": {"min": {"field": "n"}}}}, "SELECT round(avg(CASE WHEN quality = 1 THEN doc_id ELSE 0 END), 3) AS a_value, CAST(min(CASE WHEN quality = 1 THEN doc_id ELSE 0 END) AS DOUBLE) AS b_value FROM labels")


def _fields(index: Callable, names: list[str], *columns) -> Callable:
    def run(s, d):
        return index(s, d).query({"getFields": names, "filter": {}, "highlightFields": None}).rows().selectExpr(*columns)

    return run


_add("get_fields_flat", _fields(part, ["p_partkey", "p_name"], "*"), "SELECT p_partkey, p_name FROM part")
_add("get_fields_nested", _fields(nested, ["p_partkey", "item.p_name", "item.maker.p_brand"], "p_partkey", "to_json(item) AS item"), """SELECT p_partkey, '{"p_name":"' || p_name || '","maker":{"p_brand":"' || p_brand || '"}}' AS item FROM part""")
_add("get_fields_obj_array", _fields(nested, ["p_partkey", "parts.kind", "nothing"], "p_partkey", "to_json(parts) AS parts"), """SELECT p_partkey, '[{"kind":"' || p_type || '"},{"kind":"BASE"}]' AS parts FROM part""")


def _highlight(name: str, q: str, marked: str, where: str, source: bool = False, index: Callable = part, fields: list[str] | None = None, text: str = "p_name") -> None:
    col = f"{text if source else f'_highlight.{text}'} AS marked"
    _add(name, lambda s, d: index(s, d).query({"q": q, "highlightFields": fields or [text], "highlightSource": source}).rows().selectExpr("p_partkey", col), f"SELECT p_partkey, {marked} AS marked FROM part WHERE {where}")


_highlight("highlight_exact", "red ", "replace(p_name, 'red', '<mark>red</mark>')", _HAS.format("w = 'red'"))
_highlight("highlight_prefix", "wid", "replace(p_name, 'wid', '<mark>wid</mark>')", _HAS.format("starts_with(w, 'wid')"))
_highlight("highlight_fuzzy", "widgt", "replace(p_name, 'widg', '<mark>widg</mark>')", _HAS.format("starts_with(w, 'widg')"))
_highlight("highlight_source", "red ", "replace(p_name, 'red', '<mark>red</mark>')", _HAS.format("w = 'red'"), True)
_highlight("highlight_tail", "ring ", "replace(p_name, 'ring', '<mark>ring</mark>')", _HAS.format("damerau_levenshtein('ring', w) <= 1"))
_highlight("highlight_no_match", "red ", "p_type", _HAS.format("w = 'red'"), text="p_type")
_highlight("highlight_overlap", "hypersmall ", "'hyper-' || p_name", "starts_with(p_name, 'small')", index=lambda s, d: hyphens(s, d), text="text")
ORACLES["highlight_overlap"] = "SELECT p_partkey, '<mark>hyper-small</mark>' || substr(p_name, 6) || ' end' AS marked FROM part WHERE starts_with(p_name, 'small ')"
_highlight("highlight_snippet", "widget ", "split_part(p_name, ' ', 1) || ' <mark>widget</mark>'", _HAS.format("w = 'widget'"), index=lambda s, d: longer(s, d), fields=["text:2"], text="text")
_add("highlight_null", lambda s, d: s.createDataFrame([("_highlight" in part(s, d).query({"q": "red ", "highlightFields": None}).rows().columns,)], "marked boolean"), "SELECT false AS marked")


def hyphens(spark, sf_dir) -> SearchIndex:
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("hyper-"), "p_name", F.lit(" end")).alias("text"))
    return _made(spark, sf_dir, "hyphens", lambda: SearchIndex.over(t, "hyphens", "p_partkey", {"indexedFields": ["text"]}))


def longer(spark, sf_dir) -> SearchIndex:
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("some words before "), "p_name", F.lit(" and others after")).alias("text"))
    return _made(spark, sf_dir, "longer", lambda: SearchIndex.over(t, "longer", "p_partkey", {"indexedFields": ["text"]}))


def _explain_hits(s, d):
    rows = part(s, d).query({"q": "red gizm", "explain": True, "highlightFields": None}).rows()
    return rows.select("p_partkey", *[F.col(f"_explain.{r}").alias(r) for r in RANK])


_add("explain", _explain_hits, ORACLES["rank_explain_two"])


def _multi(s, d):
    first, second = part(s, d).query({"q": "wid"}).matches(), part(s, d).query({"filter": {"p_size": 3}}).matches()
    return first.select(F.lit(0).alias("request_no"), "p_partkey").unionByName(second.select(F.lit(1).alias("request_no"), "p_partkey"))


_add("multi_search", _multi, f"SELECT CAST(0 AS INTEGER) AS request_no, p_partkey FROM part WHERE {_HAS.format('starts_with(w, %s)' % repr('wid'))} UNION ALL SELECT CAST(1 AS INTEGER), p_partkey FROM part WHERE p_size = 3")

_SUPPLIERS = {"indexedFields": ["s_name", "s_acctbal", "s_suppkey"], "facetFields": ["s_nationkey"]}


def _crud(change: Callable[[SearchIndex, DataFrame], None]) -> Callable:
    def run(s, d):
        t = table(s, d, "supplier")
        index = SearchIndex.over(t, "supplier", "s_suppkey", _SUPPLIERS)
        change(index, t.withColumn("_id", F.col("s_suppkey").cast("string")))
        return index.documents.select("_id", "s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))

    return run


_S = "SELECT CAST({i} AS VARCHAR) AS _id, {k} AS s_suppkey, {n} AS s_name, round({a}, 2) AS s_acctbal FROM supplier"
_SAME = _S.format(i="s_suppkey", k="s_suppkey", n="s_name", a="s_acctbal")
_add("crud_add", _crud(lambda i, t: i.merge_table(t.withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000).withColumn("_id", F.col("s_suppkey").cast("string")))), _SAME + " UNION ALL " + _S.format(i="s_suppkey + 1000000", k="s_suppkey + 1000000", n="s_name", a="s_acctbal"))
_add("crud_replace", _crud(lambda i, t: i.merge_table(t.filter("s_acctbal < 3000").withColumn("s_name", F.lit("new")))), _S.format(i="s_suppkey", k="s_suppkey", n="CASE WHEN s_acctbal < 3000 THEN 'new' ELSE s_name END", a="s_acctbal"))
_add("crud_patch", _crud(lambda i, t: i.patch_table(t.select("_id", (F.col("s_acctbal") + 1).alias("s_acctbal")))), _S.format(i="s_suppkey", k="s_suppkey", n="s_name", a="s_acctbal + 1"))
_add("crud_delete", _crud(lambda i, t: i.delete_table(t.filter("s_acctbal >= 5000"))), _SAME + " WHERE s_acctbal < 5000")
_add("crud_clear", _crud(lambda i, t: i.clear()), _SAME + " WHERE false")


def _patch_new_field(s, d):
    """A new column, and two rows for each id, of which the last by `at` counts."""
    t = table(s, d, "supplier")
    index = SearchIndex.over(t, "supplier", "s_suppkey", _SUPPLIERS)
    twice = F.explode(F.array(F.lit(1), F.lit(2))).alias("at")
    index.patch_table(t.filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("_id"), "s_name", twice).select("_id", "at", F.concat("s_name", F.lit("/"), "at").alias("note")), order="at")
    return index.documents.select("_id", "s_name", "note")


_add("crud_patch_new_field", _patch_new_field, "SELECT CAST(s_suppkey AS VARCHAR) AS _id, s_name, CASE WHEN s_acctbal > 0 THEN s_name || '/2' END AS note FROM supplier")


def _mixed_adds(s, d):
    """Single documents, a table, single documents, changes of both."""
    t = table(s, d, "supplier")
    index = SearchIndex(s, "mixed", _SUPPLIERS)
    index.add({"_id": "first", "s_suppkey": -1, "s_name": "one", "s_acctbal": 1.5, "s_nationkey": 1})
    index.add(t.withColumn("_id", F.col("s_suppkey").cast("string")))
    index.add([{"_id": "second", "s_suppkey": -2, "s_name": "two", "s_acctbal": 3.5}, {"_id": "0", "s_suppkey": 0, "s_name": "replaced", "s_acctbal": 2.5}])
    index.delete("1")
    index.patch("2", {"s_name": "patched"})
    index.patch("first", {"s_name": "uno"})
    return index.documents.select("_id", F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


_add("crud_mixed_adds", _mixed_adds, "SELECT * FROM (VALUES ('first', CAST(-1 AS BIGINT), 'uno', 1.5::DOUBLE), ('second', -2, 'two', 3.5), ('0', 0, 'replaced', 2.5)) AS v(_id, s_suppkey, s_name, s_acctbal) UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_suppkey, CASE WHEN s_suppkey = 2 THEN 'patched' ELSE s_name END, round(s_acctbal, 2) FROM supplier WHERE s_suppkey > 1")
_add("doc_get", lambda s, d: s.createDataFrame([{k: v for k, v in SearchIndex.over(table(s, d, "supplier"), "supplier", "s_suppkey", _SUPPLIERS).get("5").items()}], "_id string, s_suppkey long, s_name string"), "SELECT CAST(s_suppkey AS VARCHAR) AS _id, s_suppkey, s_name FROM supplier WHERE s_suppkey = 5")


def _scratch(s, name: str) -> str:
    return f"{shared_root(s)}/{name}-{uuid.uuid4().hex}"


def _late_field(s, d):
    """Lines of JSON in which a field comes up for the dearest parts only, long after the first lines."""
    folder = _scratch(s, "late")
    t = table(s, d, "part").select("p_partkey", "p_name", F.when(F.col("p_retailprice") >= 915, F.col("p_brand")).alias("late"))
    t.repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey").write.option("ignoreNullFields", True).json(folder)
    return read_documents(s, folder).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "late")


_add("json_late_field", _late_field, "SELECT p_partkey, p_name, CASE WHEN p_retailprice >= 915 THEN p_brand END AS late FROM part")


def _formats(s, d):
    """The same rows through several formats."""
    t, out = table(s, d, "customer").select("c_custkey", "c_name"), []
    for kind in ("parquet", "orc", "json", "csv"):
        folder = _scratch(s, kind)
        write_results(t, folder, kind)
        out.append(read_table(s, folder, kind, t.schema).select(F.lit(kind).alias("kind"), "c_custkey", "c_name"))
    return reduce(DataFrame.unionByName, out)


_add("formats", _formats, "SELECT kind, c_custkey, c_name FROM customer, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) AS k(kind)")


def _ingest_restart(s, d):
    """Two files by a stream; then an index made anew goes on from the same checkpoint with a third that replaces some."""
    folder, check = _scratch(s, "stream"), _scratch(s, "stream-check")
    t = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("_id"), "s_suppkey", "s_name", "s_acctbal")
    t.filter("s_acctbal < 3000").write.mode("append").parquet(folder)
    t.filter("s_acctbal between 3000 and 6000").write.mode("append").parquet(folder)
    stream = s.readStream.schema(t.schema).parquet(folder)
    ingest(stream, SearchIndex(s, "stream", _SUPPLIERS), check).awaitTermination()
    t.filter("s_acctbal > 5000").withColumn("s_name", F.lit("late")).write.mode("append").parquet(folder)
    index = SearchIndex(s, "stream", _SUPPLIERS)
    ingest(stream, index, check).awaitTermination()
    return index.documents.select("_id", "s_suppkey", "s_name")


_add("ingest_restart", _ingest_restart, "SELECT CAST(s_suppkey AS VARCHAR) AS _id, s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'late' ELSE s_name END AS s_name FROM supplier")


def _saved(s, d):
    folder = _scratch(s, "saved")
    part(s, d).saved(folder)
    return part(s, d).loaded(folder).query({"q": "widgte ", "filter": {"p_size": {"$gt": 10}}}).matches().select("p_partkey")


_add("index_saved", _saved, _P + _HAS.format("damerau_levenshtein('widgte', w) <= 1") + " AND p_size > 10")


def _metadata(s, d):
    folder = _scratch(s, "metadata")
    part(s, d).save_metadata(folder)
    settings, mapping = part(s, d).read_metadata(folder)
    return s.createDataFrame([(",".join(settings["indexedFields"]), ",".join(settings["facetFields"]), settings["hitsPerPage"], ",".join(mapping["strings"]), ",".join(mapping["numbers"]), mapping["readyToIndex"])], "indexed string, facets string, hits int, strings string, numbers string, ready boolean")


_add("metadata_saved", _metadata, "SELECT 'p_name,p_size,p_retailprice' AS indexed, 'p_brand,p_type' AS facets, CAST(20 AS INTEGER) AS hits, 'p_name' AS strings, 'p_size,p_retailprice' AS numbers, true AS ready")


def _shards(s, d):
    index = SearchIndex.over(table(s, d, "part"), "part", "p_partkey", _PART, shards=4)
    info = index.info()
    return s.createDataFrame([(len(info["shards"]), sum(x["numDocuments"] > 0 for x in info["shards"]), info["numDocuments"])], "shards long, used long, documents long")


_add("shard_split", _shards, "SELECT CAST(4 AS BIGINT) AS shards, CAST(4 AS BIGINT) AS used, count(*) AS documents FROM part")


def _response(s, d):
    """What a response says besides its hits, and how many hits it has."""
    r = part(s, d).search({"q": "wid", "filter": {"p_size": {"$gt": 10}}, "hitsPerPage": 7, "page": 2, "maxFacetResults": 0, "highlightFields": None})
    return s.createDataFrame([(r["queryText"], r["totalHits"], r["numHits"], r["page"], r["numPages"], len(r["hits"]), sum(map(len, r["facets"].values())), r["fullScan"], r["indexName"])], "q string, total long, n long, page long, pages long, hits long, facets long, exact boolean, name string")


_add("response", _response, f"SELECT 'wid' AS q, count(*) AS total, CAST(greatest(0, least(7, least(500, count(*)) - 7)) AS BIGINT) AS n, CAST(2 AS BIGINT) AS page, CAST(ceil(least(500, count(*)) / 7.0) AS BIGINT) AS pages, CAST(greatest(0, least(7, least(500, count(*)) - 7)) AS BIGINT) AS hits, CAST(0 AS BIGINT) AS facets, true AS exact, 'part' AS name FROM part WHERE {_HAS.format('starts_with(w, %s)' % repr('wid'))} AND p_size > 10")


def _facet_result(s, d):
    """The facets of a response as they are shaped: lists of key and count."""
    r = part(s, d).search({"filter": {"p_size": {"$lte": 25}}, "hitsPerPage": 0, "maxFacetResults": 2})
    return s.createDataFrame([(f, i, x["key"], x["count"]) for f, xs in r["facets"].items() for i, x in enumerate(xs)], "field string, place int, key string, count long")


_add("facet_result_shape", _facet_result, "SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY n) - 1 AS INTEGER) AS place, key, count FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, key) AS n FROM (" + _BOTH.format(w="WHERE p_size <= 25") + ")) WHERE n <= 2")


def _facet_only_number(s, d):
    """A number that is a facet and not indexed: counted, and no filter for it."""
    index = SearchIndex.over(table(s, d, "part"), "facet_number", "p_partkey", {"indexedFields": ["p_name"], "facetFields": ["p_size"]})
    counts = facet_ops.top_facets(facet_ops.facet_counts(index.query({"q": "red "}).matches(), index.mapping), 100)
    return counts.select("field", "key", "count")


_add("facet_only_number", _facet_only_number, f"SELECT 'p_size' AS field, printf('%f', p_size::DOUBLE) AS key, count(*) AS count FROM part WHERE {_HAS.format('w = %s' % repr('red'))} GROUP BY p_size")


def _engine(s, d) -> tuple[Engine, tuple[str, str]]:
    """An engine with an application whose indexes are part and supplier."""
    engine = Engine(s, "master", "key")
    _, app = engine.request("POST", "/1/applications", {"name": "shop"}, "master", "key")
    engine.apps["shop"].indexes["part"] = part(s, d)
    engine.apps["shop"].indexes["supplier"] = SearchIndex.over(table(s, d, "supplier"), "supplier", "s_suppkey", _SUPPLIERS, shards=2)
    return engine, (app["appId"], app["apiKey"])


def _api(name: str, calls: Callable[[Engine, tuple], list], sql: str) -> None:
    """Calls of the API, each with its status and a piece of its answer."""

    def run(s, d):
        rows = [(i, status, str(found)) for i, (status, found) in enumerate(calls(*_engine(s, d)))]
        return s.createDataFrame(rows, "step int, status int, found string")

    _add(name, run, sql)


def _steps(*found: str) -> str:
    """SQL for steps, each 'status, SQL of a string'."""
    return " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS step, CAST({f.partition(',')[0]} AS INTEGER) AS status, CAST({f.partition(',')[2]} AS VARCHAR) AS found" for i, f in enumerate(found))


def _then(answer: tuple[int, object], piece: Callable = lambda r: "") -> tuple[int, object]:
    return answer[0], piece(answer[1]) if answer[0] == 200 else ""


_api("api_ping_version", lambda e, a: [_then(e.request("GET", "/ping"), lambda r: r["success"]), _then(e.request("GET", "/1/version", None, "master", "key"), lambda r: r["version"] > ""), e.request("GET", "/1/version", None, *a)[:1] + ("",), e.request("GET", "/1/version")[:1] + ("",)], _steps("200, 'True'", "200, 'True'", "403, ''", "400, ''"))
_api(
    "api_applications",
    lambda e, a: [
        _then(e.request("POST", "/1/applications", {"name": "second"}, "master", "key"), lambda r: r["name"]), _then(e.request("GET", "/1/applications", None, "master", "key"), lambda r: ",".join(x["name"] for x in r)),
        _then(e.request("GET", "/1/applications/second", None, "master", "key"), lambda r: r["name"]), _then(e.request("POST", "/1/applications", {"name": "second"}, "master", "key")),
        _then(e.request("DELETE", "/1/applications/second", None, "master", "key"), lambda r: r["success"]), _then(e.request("GET", "/1/applications/second", None, "master", "key")),
    ],
    _steps("200, 'second'", "200, 'shop,second'", "200, 'second'", "400, ''", "200, 'True'", "404, ''"),
)
_api(
    "api_indexes",
    lambda e, a: [
        _then(e.request("GET", "/1/indexes", None, *a), lambda r: ",".join(f"{x['name']}/{x['numShards']}" for x in r)), _then(e.request("POST", "/1/indexes", {"name": "new", "numShards": 3}, *a), lambda r: r["name"]),
        _then(e.request("POST", "/1/indexes", {"name": "new"}, *a)), _then(e.request("DELETE", "/1/indexes/new", None, *a), lambda r: r["success"]), _then(e.request("GET", "/1/indexes/new/info", None, *a)),
    ],
    _steps("200, 'part/1,supplier/2'", "200, 'new'", "400, ''", "200, 'True'", "404, ''"),
)
_api("api_query", lambda e, a: [_then(e.request("POST", "/1/indexes/part/query", {"q": "wid", "filter": {"p_size": {"$gt": 10}}, "highlightFields": None}, *a), lambda r: ",".join(str(h["p_partkey"]) for h in r["hits"])), _then(e.request("POST", "/1/indexes/part/query", {"filter": {"nothing": 1}}, *a))], "SELECT CAST(0 AS INTEGER) AS step, CAST(200 AS INTEGER) AS status, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS found FROM (" + _P + _HAS.format("starts_with(w, 'wid')") + " AND p_size > 10 ORDER BY p_partkey LIMIT 20) UNION ALL SELECT 1, 400, ''")
_api(
    "api_multi_query",
    lambda e, a: [_then(e.request("POST", "/1/query", {"requests": [{"indexName": "part", "q": "wid"}, {"indexName": "supplier", "filter": {"s_acctbal": {"$lt": 0}}}, {"indexName": "none"}]}, *a), lambda r: ",".join(str(x.get("totalHits", x.get("success"))) for x in r))],
    f"SELECT CAST(0 AS INTEGER) AS step, CAST(200 AS INTEGER) AS status, (SELECT count(*) FROM part WHERE {_HAS.format('starts_with(w, %s)' % repr('wid'))}) || ',' || (SELECT count(*) FROM supplier WHERE s_acctbal < 0) || ',False' AS found",
)
_api(
    "api_documents",
    lambda e, a: [
        _then(e.request("POST", "/1/indexes/supplier", [{"_id": "x", "s_name": "added", "s_acctbal": 7}, {"_id": "y", "s_name": "gone"}], *a), lambda r: ",".join(r["ids"])), _then(e.request("GET", "/1/indexes/supplier/x", None, *a), lambda r: r["s_name"]),
        _then(e.request("PATCH", "/1/indexes/supplier/x", {"s_acctbal": 8}, *a), lambda r: r), _then(e.request("GET", "/1/indexes/supplier/x", None, *a), lambda r: f"{r['s_name']} {r['s_acctbal']}"),
        _then(e.request("PUT", "/1/indexes/supplier/3", {"s_name": "put"}, *a), lambda r: r), _then(e.request("GET", "/1/indexes/supplier/3", None, *a), lambda r: r["s_name"]),
        _then(e.request("DELETE", "/1/indexes/supplier/y", None, *a), lambda r: r["success"]), _then(e.request("DELETE", "/1/indexes/supplier/4", None, *a), lambda r: r["success"]), _then(e.request("GET", "/1/indexes/supplier/4", None, *a)),
        _then(e.request("GET", "/1/indexes/supplier/5", None, *a), lambda r: r["s_name"]), _then(e.request("GET", "/1/indexes/supplier/info", None, *a), lambda r: r["numDocuments"]),
        _then(e.request("POST", "/1/indexes/supplier/clear", None, *a), lambda r: r["success"]), _then(e.request("GET", "/1/indexes/supplier/info", None, *a), lambda r: r["numDocuments"]),
    ],
    _steps("200, 'x,y'", "200, 'added'", "200, 'x'", "200, 'added 8'", "200, '3'", "200, 'put'", "200, 'True'", "200, 'True'", "404, ''", "200, (SELECT s_name FROM supplier WHERE s_suppkey = 5)", "200, (SELECT count(*) FROM supplier)", "200, 'True'", "200, '0'"),
)
_api(
    "api_settings",
    lambda e, a: [
        _then(e.request("GET", "/1/indexes/supplier/settings", None, *a), lambda r: r["hitsPerPage"]), _then(e.request("POST", "/1/indexes/supplier/settings", {"hitsPerPage": 3}, *a), lambda r: r["success"]),
        _then(e.request("POST", "/1/indexes/supplier/query", {"sortBy": {"s_acctbal": "desc"}}, *a), lambda r: len(r["hits"])), _then(e.request("POST", "/1/indexes/supplier/settings", {"hitsPerPage": "x"}, *a)), _then(e.request("GET", "/1/indexes/supplier/mapping", None, *a), lambda r: ",".join(r["numbers"] + r["facets"])),
    ],
    _steps("200, '20'", "200, 'True'", "200, '3'", "400, ''", "200, 's_acctbal,s_suppkey,s_nationkey'"),
)


def _key_calls(e: Engine, a: tuple) -> list:
    status, key = e.request("POST", "/1/keys", {"permissions": ["queryIndex"], "indexes": ["part"], "description": "reader"}, *a)
    own = (a[0], key["apiKey"])
    calls = [(status, key["description"]), _then(e.request("GET", "/1/keys", None, *a), len), _then(e.request("GET", f"/1/keys/{own[1]}", None, *a), lambda r: ",".join(r["permissions"]))]
    calls += [_then(e.request("POST", "/1/indexes/part/query", {"q": "zzzz"}, *own), lambda r: r["totalHits"]), _then(e.request("POST", "/1/indexes/supplier/query", {}, *own)), _then(e.request("DELETE", "/1/indexes/part", None, *own)), _then(e.request("GET", "/1/keys", None, *own))]
    return [*calls, _then(e.request("POST", f"/1/keys/{own[1]}", {"permissions": ["delDoc"]}, *a), lambda r: ",".join(r["permissions"])), _then(e.request("POST", "/1/indexes/part/query", {}, *own)), _then(e.request("DELETE", f"/1/keys/{own[1]}", None, *a), lambda r: r["success"]), _then(e.request("GET", f"/1/keys/{own[1]}", None, *a)), _then(e.request("POST", "/1/keys", {"permissions": ["all"]}, *a))]


_api("api_keys", _key_calls, _steps("200, 'reader'", "200, '1'", "200, 'queryIndex'", "200, '0'", "403, ''", "403, ''", "403, ''", "200, 'delDoc'", "403, ''", "200, 'True'", "404, ''", "400, ''"))
_api("api_stats", lambda e, a: [_then(e.request("GET", "/1/indexes/supplier/stats", None, *a), lambda r: f"{r['numDocuments']} {r['numShards']} {r['numJobs']} {sum(x['sum'] for x in r['shards']) > 0}")], _steps("200, (SELECT count(*) FROM supplier) || ' 2 0 True'"))


def _mapping(s, d):
    rows = [(f.name, f.kind, f.indexed, f.facet, f.priority) for f in events(s, d).mapping.fields.values()]
    return s.createDataFrame(rows, "name string, kind string, indexed boolean, facet boolean, priority int")


_add("mapping_infer", _mapping, "SELECT name, kind, indexed, facet, CAST(priority AS INTEGER) AS priority FROM (VALUES ('event_id', 'number', false, false, -1), ('ts', 'number', false, false, -1), ('user_id', 'number', true, false, 1), ('event_type', 'string', false, true, -1), ('value', 'number', true, false, 0), ('props', 'object', false, false, -1), ('props.k', 'number', true, false, 2)) AS t(name, kind, indexed, facet, priority)")
_add("index_info", lambda s, d: part(s, d).shard_counts().select(F.col("_shard").alias("shard"), F.col("numDocuments").alias("n")), "SELECT CAST(0 AS INTEGER) AS shard, count(*) AS n FROM part")


def _stats(s, d):
    index = SearchIndex.over(table(s, d, "nation"), "nation", "n_nationkey", {"indexedFields": ["n_name"]})
    r = index.size_stats()
    return r.select(F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"), F.col("sum").cast("long").alias("sum"), F.round("avg", 3).alias("avg"))


_add("index_stats", _stats, """SELECT CAST(min(n) AS BIGINT) AS min, CAST(max(n) AS BIGINT) AS max, CAST(sum(n) AS BIGINT) AS sum, round(avg(n), 3) AS avg FROM (SELECT length('{"_id":"' || n_nationkey || '","n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS n FROM nation)""")
_add("vocab_df", lambda s, d: match.vocabulary(part(s, d).postings()), "SELECT w AS word, count(DISTINCT p_partkey) AS df FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
_add("postings", lambda s, d: part(s, d).postings().select(F.col("_docid").alias("p_partkey"), "word", "position"), "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, CAST(unnest([1, 2]) AS INTEGER) AS position FROM part")


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-you-type search with a filter, sorted by a number: one page of hits."""
    q = {"q": "wid", "filter": {"p_size": {"$gt": 10}}, "sortBy": {"p_retailprice": "desc"}, "hitsPerPage": 20, "highlightFields": None}
    return part(spark, sf_dir).query(q).hits().select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


_add("search_page", entry_query, "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part WHERE " + _HAS.format("starts_with(w, 'wid')") + " AND p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 20")

__all__ = ["ORACLES", "QUERIES", "T", "entry_query", "table"]

"""From a query's JSON to one logical plan: matches, then hits, facets and aggregations on them."""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.terms import TextPlan, text_plan
from ..operators import aggs, facets, filters, highlight, match, project, rank
from .settings import Settings

QUERY_KEYS = ("q", "filter", "aggs", "page", "explain")


@dataclass
class SearchPlan:
    """A compiled query; every part is lazy."""

    text: str | None
    words: TextPlan
    filter: Column | None
    aggs: list
    keys: list[tuple[Column, bool]]
    page: int
    explain: bool
    settings: Settings


def compile_query(index, query: dict) -> SearchPlan:
    if not isinstance(query, dict):
        raise QueryError("A query must be an object")
    settings = index.settings.changed(query, query=True)
    page = query.get("page", 1)
    if isinstance(page, bool) or not isinstance(page, (int, float)) or page < 1 or page != int(page):
        raise QueryError("page must be a number from 1 on")
    if int(page) * settings.hitsPerPage > settings.maxHits:
        raise QueryError("page is beyond maxHits")
    mapping, q = index.mapping, query.get("q")
    text = q if isinstance(q, str) else None
    return SearchPlan(
        text, text_plan(text), filters.compile_filter(query.get("filter"), mapping), aggs.parse_aggs(query.get("aggs"), mapping),
        rank.sort_keys(settings, mapping), int(page), bool(query.get("explain")), settings,
    )


class Search:
    """A query's results as DataFrames: matches, hits, facets, aggs; and all as a response."""

    def __init__(self, index, query: dict):
        self.index, self.query = index, query
        self.plan = compile_query(index, query)

    def filtered(self) -> DataFrame:
        """Documents that pass the filter, before any text is looked at."""
        docs = self.index.documents
        return docs if self.plan.filter is None else docs.filter(self.plan.filter)

    def matches(self, ranks: bool = False) -> DataFrame:
        """Matching documents; with rank columns if asked for. The filter is applied first; postings are
        joined on what it leaves, so that only the ids and ranks of survivors meet the documents."""
        docs, words = self.filtered(), self.plan.words
        if not words.words:
            return rank.unranked(docs) if ranks else docs
        posts, known = self.index.lookup()
        found = match.occurrences(posts, words, known)
        ids = rank.ranked(found, words) if ranks else match.matching(found, words)
        return docs.join(ids, "_docid")

    def total(self) -> DataFrame:
        return self.matches().agg(F.count("*").alias("totalHits"))

    def meta(self) -> DataFrame:
        """totalHits, numHits, page and numPages as one row."""
        p, s = self.plan, self.plan.settings
        within = F.least(F.col("totalHits"), F.lit(s.maxHits))
        pages = F.ceil(within / s.hitsPerPage) if s.hitsPerPage else F.lit(0)
        on_page = F.greatest(F.lit(0), F.least(F.lit(s.hitsPerPage), within - (p.page - 1) * s.hitsPerPage))
        return self.total().select("totalHits", on_page.cast("long").alias("numHits"), F.lit(p.page).cast("long").alias("page"), pages.cast("long").alias("numPages"))

    def hits(self) -> DataFrame:
        """The page of hits, in order, with `_explain`, `_highlight` and projected fields as asked."""
        p, s = self.plan, self.plan.settings
        top = rank.page(self.matches(ranks=True), p.keys, p.page, s.hitsPerPage)
        # A page has at most maxHits (1000) rows: whole documents are fetched for these only, and put in order again.
        asc = self.index.documents.join(F.broadcast(top), "_docid").orderBy(*rank.order(p.keys)).limit(max(1, s.hitsPerPage)).drop(*[f"_k{i}" for i in range(len(p.keys))])
        return self._shown(asc)

    def rows(self) -> DataFrame:
        """All matches as hits are shown, in no order and without a page."""
        return self._shown(self.matches(ranks=self.plan.explain))

    def _shown(self, rows: DataFrame) -> DataFrame:
        p, s = self.plan, self.plan.settings
        if p.explain:
            rows = rows.withColumn("_explain", F.struct(*[F.col(r) for r in s.rankAlgorithm]) if s.rankAlgorithm else F.struct(F.lit(0).alias("none")))
        rows = rows.drop(*rank.RANK, "_shard")
        keep = ("_explain",) if s.getFields is not None else ("_id", "_docid", "_explain")
        rows = project.get_fields(rows, s.getFields, keep)
        return highlight.highlighted(rows, p.words, s.highlightFields if p.words.words else None, s.highlightSource)

    def facets(self) -> DataFrame:
        return facets.top_facets(facets.facet_counts(self.matches(), self.index.mapping), self.plan.settings.maxFacetResults)

    def aggs(self) -> DataFrame:
        return aggs.aggregate(self.matches(), self.plan.aggs)

    def response(self) -> dict:
        """The whole response. Matches are found once: three consumers read their persisted rows."""
        began, p, s, out = time.time(), self.plan, self.plan.settings, {}
        with _Persisted(self) as shared:
            if p.aggs:
                out["aggs"] = aggs.as_dict(aggs.aggregate(shared, p.aggs).first())
            wanted = s.maxFacetResults > 0 and self.index.mapping.facets
            counts = facets.top_facets(facets.facet_counts(shared, self.index.mapping), s.maxFacetResults).collect() if wanted else []
            out["facets"] = facets.facets_as_dict(counts, self.index.mapping)
            total = shared.count()
            out["totalHits"] = total
            first = (p.page - 1) * s.hitsPerPage
            out["numHits"] = max(0, min(s.hitsPerPage, min(total, s.maxHits) - first))
            out["page"] = p.page
            out["numPages"] = math.ceil(min(s.maxHits, total) / s.hitsPerPage) if s.hitsPerPage else 0
            out["hits"] = [json.loads(r) for r in self.hits().toJSON().collect()] if s.hitsPerPage and total else []
            for hit in out["hits"] if p.words.words and s.highlightFields is not None and not s.highlightSource else []:
                hit.setdefault("_highlight", {})
        if p.text is not None:
            out["queryText"] = p.text
        return out | {"fullScan": True, "indexName": self.index.name, "took": math.ceil(1000 * (time.time() - began))}


class _Persisted:
    """The matches, narrowed and persisted while a response is made."""

    def __init__(self, search: Search):
        self.search = search

    def __enter__(self) -> DataFrame:
        p, mapping = self.search.plan, self.search.index.mapping
        ranks = bool(p.settings.hitsPerPage)
        named = [*mapping.facets, *(p.settings.sortBy or {}), *(p.settings.rankBy or {})]
        roots = dict.fromkeys([mapping.fields[n].path[0] for n in named] + [f.path[0] for _, _, f in p.aggs])
        rows = self.search.matches(ranks)
        # Only what facets, metrics and the sort look at is kept; the page's documents are fetched later.
        self.rows = rows.select("_docid", *[F.col(f"`{c}`") for c in roots], *(rank.RANK if ranks else [])).persist()
        self.old = self.search.matches
        self.search.matches = lambda ranks=False: self.rows  # type: ignore[method-assign]
        return self.rows

    def __exit__(self, *_) -> None:
        self.search.matches = self.old  # type: ignore[method-assign]
        self.rows.unpersist()


def multi_search(index, requests: list) -> list[dict]:
    """Independent queries in order; one that fails gives its failure."""
    out = []
    for r in requests:
        try:
            out.append(Search(index, r).response())
        except QueryError as e:
            out.append(e.as_dict())
    return out

"""Golden values of small datasets, and errors."""

import json

import pytest

from sievio.engine import Engine
from sievio.errors import NotFound, QueryError
from sievio.functions.analyzer import index_tokens, normalise, search_tokens, whitespace_tokens
from sievio.functions.terms import text_plan
from sievio.index import SearchIndex
from sievio.operators.highlight import Marker, highlight, snippet


def build(spark, rows, indexed, facets=(), **kw):
    index = SearchIndex(spark, "t", {"indexedFields": list(indexed), "facetFields": list(facets)}, **kw)
    index.add(rows)
    return index


def total(index, query):
    return index.query(query).total().first()[0]


def explains(index, q, **kw):
    return [json.loads(r)["_explain"] for r in index.query({"q": q, "explain": True, "highlightFields": None, **kw}).hits().toJSON().collect()]


def test_normalise():
    assert normalise("Éß ﬁ “don’t” ‐") == "ess fi \"don't\" -"
    assert [w for w, _ in index_tokens("U.S.A. don't foo.bar ama-xon foo- a_b")] == ["usa", "dont", "foo", "bar", "ama", "xon", "amaxon", "foo", "a_b"]
    assert index_tokens("ama-xon x") == [("ama", 1), ("xon", 1), ("amaxon", 1), ("x", 2)]
    assert [w for w, _ in search_tokens("ama-xon")] == ["ama", "xon"]
    assert whitespace_tokens("A  b") == [("A", 1), ("b", 2)]
    assert index_tokens("x" * 127 + "yz")[0][0] == "yz"


def test_terms():
    p = text_plan("a new hope")
    assert [(t.word, t.prefix, t.typos) for t in p.terms] == [("a", False, 0), ("anew", False, 0), ("new", False, 0), ("newhope", True, 0), ("hope", True, 1), ("anewhope", True, 0)]
    assert [t.prefix for t in text_plan("hope ").terms] == [False]


def test_typos_and_prefixes(spark):
    index = build(spark, [{"str": w} for w in "test best atest testa tset etst tets tesg tset tast tegt".split()], ["str"])
    for q, n in {"": 11, "test": 11, "btest": 4, "atest": 3, "ctest": 3, "tes": 3, "te": 5, "t": 8}.items():
        assert total(index, {"q": q}) == n, q


def test_combinations(spark):
    rows = ["aaaa", "aaaa bbbb", "aaaa bbbb cccc", "aaaa bbbb cccc dddd", "aaaa bbbb cccc dddd eeee", "aaaabbbb cccc dddd eeee", "aaaa bbbbcccc ddddeeee", "aaaabbbbccccddddeeee"]
    index = build(spark, [{"str": r} for r in rows], ["str"])
    for q, n in {"aaaa": 8, "dddd": 4, "baaa": 8, "baaa bbbb": 5, "aaaa bbbb": 7, "aaaa bbbb cccc": 6, "aaaa bbbb cccc dddd": 5, "aaaa bbbb cccc dddd e": 4}.items():
        assert total(index, {"q": q}) == n, q


def test_rank_one_word(spark):
    index = build(spark, [{"str": r} for r in ["this is worst", "this is best", "this best worst", "testing this", "test"]], ["str"])
    h = explains(index, "test")
    assert len(h) == 4 and (h[0]["exact"], h[0]["field"], h[0]["position"]) == (1, 0, 1)
    assert (h[1]["exact"], h[1]["position"], h[1]["typos"]) == (0, 1, 0)
    assert [(x["typos"], x["position"]) for x in h[2:]] == [(1, 2), (1, 3)]
    assert [x["position"] for x in explains(index, "th")] == [1, 1, 1, 2]
    assert [(x["position"], x["exact"]) for x in explains(index, "worst")] == [(3, 1)] * 2
    assert [(x["position"], x["exact"]) for x in explains(index, "wors")] == [(3, 0)] * 2
    assert [(x["position"], x["typos"]) for x in explains(index, "wurs")] == [(3, 1)] * 2


def test_rank_two_words(spark):
    rows = ["why is this my best day", "why is this why then my", "why my test me", "this is a new a new whymy", "mya what is then blah whys this"]
    index = build(spark, [{"str": r} for r in rows], ["str"])
    h = explains(index, "whys my")
    assert len(h) == 4 and (h[0]["typos"], h[0]["position"], h[0]["proximity"], h[0]["exact"]) == (0, 1, 5, 1)
    assert (h[1]["exact"], h[1]["typos"]) == (1, 1)
    assert total(index, {"q": "why my"}) == 4 and total(index, {"q": "a new"}) == 1


TEN = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize("q,typos,exact,position,proximity", [("one", 0, None, 1, None), ("fivs", 1, None, 5, None), ("eight", 0, None, 8, None), ("one two", 0, 2, 1, 1), ("one foor", 1, 1, 1, 3), ("one six", 0, 2, 1, 5), ("thre six", 1, 1, 3, 3), ("one nin", 0, 1, 1, 8), ("one ten", 0, 2, 1, 8)])
def test_positions(spark, q, typos, exact, position, proximity):
    (h,) = explains(build(spark, [{"str": TEN}], ["str"]), q)
    for k, v in {"typos": typos, "exact": exact, "position": position, "proximity": proximity}.items():
        assert v is None or h[k] == v, k


def test_lists_and_fields(spark):
    index = build(spark, [{"str": TEN, "strlist": ["aaaaa", "bbbbb", "cccccc"]}], ["str", "strlist"])
    assert {k: explains(index, "one aaaa")[0][k] for k in ("typos", "position", "proximity")} == {"typos": 0, "position": 1, "proximity": 8}
    h = explains(index, "aaaa bbbb")[0]
    assert (h["typos"], h["position"], h["field"], h["proximity"]) == (1, 1, 1, 8)
    h = explains(index, "aaaa ten")[0]
    assert (h["typos"], h["position"], h["field"], h["proximity"]) == (1, 10, 0, 8)
    index = build(spark, [{"str": "aa bb cc", "str2": "dd ee ff", "str3": "gg hh ii"}], ["str", "str2", "str3"])
    for q, f in {"aa": 0, "aa bb": 0, "aa dd": 0, "bb hh": 0, "ee hh": 1}.items():
        assert [x["field"] for x in explains(index, q)] == [f], q


def test_three_words(spark):
    index = build(spark, [{"str": r} for r in ["a new hope", "anew hope", "a newhope", "anewhope", "a blah new woah hope", "test"]], ["str"])
    assert total(index, {"q": ""}) == 6 and total(index, {"q": "a new hope"}) == 5


ROWS = [
    {"_id": str(i + 1), "str": "a", "n": i + 1, "nl": [i + 1, i + 2, i + 3], "f": f, "fl": fl, "b": i % 2 == 0}
    for i, (f, fl) in enumerate([("aaa", ["zzz", "yyy"]), ("bbb", ["yyy", "xxx"]), ("ccc", ["xxx", "www"]), ("ddd", ["www", "vvv"]), ("eee", ["vvv", "uuu"])])
]


@pytest.fixture(scope="module")
def five(spark):
    return build(spark, ROWS, ["str", "n", "nl", "b"], ["f", "fl"])


FILTERS = [
    ({"n": 5}, 1), ({"nl": 5}, 3), ({"nl": {"$eq": 5}}, 3), ({"n": 7}, 0), ({"f": "aaa"}, 1), ({"fl": {"$eq": "uuu"}}, 1), ({"fl": "xxx"}, 2), ({"f": "fff"}, 0), ({"b": True}, 3), ({"b": False}, 2),
    ({"nl": {"$ne": 5}}, 2), ({"n": {"$ne": 1}}, 4), ({"n": {"$ne": 7}}, 5), ({"fl": {"$ne": "uuu"}}, 4), ({"f": {"$ne": "blah"}}, 5), ({"b": {"$ne": True}}, 2), ({"b": {"$ne": False}}, 3),
    ({"n": {"$or": [1, 5]}}, 2), ({"$or": [{"n": 2}, {"n": 4}]}, 2), ({"$or": [{"n": 100}, {"n": 200}]}, 0), ({"$or": [{"n": 3}, {"n": 200}, {"b": False}]}, 3), ({"f": {"$or": ["aaa", "bbb"]}}, 2),
    ({"n": {"$and": [1, 5]}}, 0), ({"$and": [{"n": 3}, {"nl": 3}, {"b": False}]}, 0), ({"$and": [{"n": 3}, {"nl": 3}, {"b": True}]}, 1), ({"nl": [3, 4]}, 2),
    ({"n": {"$gt": 100}}, 0), ({"n": {"$gt": 0}}, 5), ({"nl": {"$gt": 3}}, 4), ({"nl": {"$gt": 4}}, 3), ({"nl": {"$gte": 3}}, 5), ({"nl": {"$gte": 4}}, 4), ({"n": {"$lt": 100}}, 5), ({"n": {"$lt": 0}}, 0),
    ({"nl": {"$lt": 3}}, 2), ({"nl": {"$lt": 4}}, 3), ({"n": {"$lte": 1}}, 1), ({"nl": {"$lte": 3}}, 3), ({"nl": {"$lte": 4}}, 4), ({"n": {"$gt": 1, "$lt": 3}}, 1), ({"n": {"$gte": 1, "$lte": 3}}, 3),
    ({"nl": {"$gt": 4, "$lt": 6}}, 3), ({"n": {"$gt": 1, "$ne": 5}}, 3), ({"f": {"$nin": ["aaa", "bbb"]}}, 3), ({"$nin": [{"n": 1}, {"b": False}]}, 2), ("{}", 5), (None, 5), ({}, 5), ({"n": {"$nin": []}}, 5), ({"n": {"$or": []}}, 0),
]


def test_filters(five):
    from pyspark.sql import functions as F

    searches = [five.query({"filter": f}) for f, _ in FILTERS]
    flags = [F.sum(F.coalesce(s.plan.filter, F.lit(True)).cast("int")) if s.plan.filter is not None else F.count("*") for s in searches]
    got = list(five.documents.agg(*flags).first())
    assert got == [n for _, n in FILTERS], [(f, n, g) for (f, n), g in zip(FILTERS, got) if n != g]
    assert total(five, {"q": "lkjasdfljasdf", "filter": {"n": {"$gt": 1, "$lt": 3}}}) == 0


@pytest.mark.parametrize("spec", [{"acet": "x"}, {"str": "a"}, {"n": "x"}, {"b": 5}, {"f": {"$eq": ["x"]}}, {"f": {"$eq": None}}, {"f": {"$gt": "x"}}, {"f": {"$mt": "x"}}, {"f": {"$eq": False}}, {"f": {"$nin": ["x", 5, True]}}, {"$gt": [1]}, {"$or": {"f": "x"}}, {"f": {"$in": "x"}}])
def test_bad_filters(five, spec):
    with pytest.raises(QueryError):
        five.query({"filter": spec})


def test_metrics_and_facets(spark):
    rows = [dict(r) for r in ROWS]
    rows[0]["nl"], rows[2]["n"], rows[3]["f"], rows[3]["fl"] = [8, 2, 3], 11, "ccc", ["www", "vvv", "xxx"]
    index = build(spark, rows, ["str", "n", "nl", "b"], ["f", "fl", "n", "nl"])
    q = {"aggs": {"x": {"max": {"field": "n"}}, "i": {"min": {"field": "n"}}, "a": {"avg": {"field": "n"}}, "s": {"stats": {"field": "n"}}, "c": {"cardinality": {"field": "f"}}, "l": {"cardinality": {"field": "nl"}}, "m": {"max": {"field": "nl"}}, "k": {"min": {"field": "nl"}}}, "sortBy": {"n": "desc"}, "highlightFields": None}
    r = index.search(q)
    assert {k: v["value"] for k, v in r["aggs"].items() if k != "s"} == {"x": 11, "i": 1, "a": 4.6, "c": 4, "l": 7, "m": 7, "k": 3}
    assert r["aggs"]["s"] == {"avg": 4.6, "sum": 23, "min": 1, "max": 11, "count": 5}
    assert r["facets"]["f"] == [{"count": 2, "key": "ccc"}, {"count": 1, "key": "aaa"}, {"count": 1, "key": "bbb"}, {"count": 1, "key": "eee"}]
    assert r["facets"]["fl"][0] == {"count": 3, "key": "xxx"} and r["facets"]["n"][0]["count"] == 1
    assert [h["n"] for h in r["hits"]] == [11, 5, 4, 2, 1]
    for bad in ({"max": {"field": "str"}}, {"cardinality": {"field": "str"}}, {"max": {}}, {"median": {"field": "n"}}, {"max": {"field": "zz"}}):
        with pytest.raises(QueryError):
            index.query({"aggs": {"a": bad}})
    empty = index.search({"q": "zzzz", "aggs": {"a": {"max": {"field": "n"}}}})
    assert empty["totalHits"] == 0 and empty["hits"] == [] and empty["aggs"]["a"]["value"] is None


def test_pages_and_settings(five):
    r = five.search({"hitsPerPage": 2, "page": 3, "highlightFields": None})
    assert (r["totalHits"], r["numHits"], r["page"], r["numPages"], len(r["hits"])) == (5, 1, 3, 3, 1)
    assert r["fullScan"] and r["indexName"] == "t" and "queryText" not in r
    assert five.search({"q": "a", "hitsPerPage": 0})["hits"] == []
    for bad in ({"page": 26}, {"page": -1}, {"page": 0}, {"hitsPerPage": 600}, {"maxHits": 2000}, {"fullScanThreshold": 1}, {"rankAlgorithm": ["geo"]}, {"sortBy": {"f": "asc"}}, {"sortBy": {"n": "up"}}, {"getFields": "x"}):
        with pytest.raises(QueryError):
            five.query(bad)
    answers = five.search({"requests": [{"q": ""}, {"q": "blah"}, {"filter": {"zz": 1}}]})
    assert [a.get("totalHits") for a in answers] == [5, 0, None] and answers[2]["success"] is False


NESTED = {
    "word": "this", "sentence": "well this is it", "number": 5, "boolean": True, "words": ["this", "that"], "numbers": [1, 2],
    "object": {"word": "this", "number": 33, "boolean": False, "iobject": {"iword": "this", "inum": 1}},
    "objects": [{"word": "this", "number": 1, "object": {"iword": "this", "inum": 2}}, {"word": "this one", "number": 2, "object": {"iword": "this", "inum": 3}}],
    "bigobject": {"levelone": {"leveltwo": {"levelthree": {"word": "this", "number": 1}}}},
}


def test_projection_and_highlight(spark):
    indexed = ["word", "sentence", "number", "boolean", "words", "numbers", "object.word", "object.number", "object.iobject.iword", "objects.word", "objects.object.iword", "bigobject.levelone.leveltwo.levelthree.word"]
    index = build(spark, [NESTED], indexed, ["word", "words"])

    def marks(**kw):
        (row,) = index.query({"q": "this", **kw}).hits().toJSON().collect()
        return row.count("<mark>")

    assert marks() == 10 and marks(highlightSource=True) == 10 and marks(highlightFields=None) == 0
    assert [marks(highlightFields=f) for f in (["word"], ["word", "object.word"], ["objects.word"], ["object.iobject.iword"])] == [1, 2, 2, 1]
    assert [marks(getFields=f) for f in (["word"], ["word", "words", "object.word"], ["word", "object.iobject.iword"], ["word", "objects"], ["objects.word"], ["objects.object.iword", "objects.word"])] == [1, 3, 2, 5, 2, 4]
    assert total(index, {"filter": {"object.number": 33}}) == 1


def test_highlight_texts():
    terms = text_plan("amazon").terms
    assert highlight("in the end amazon!", terms) == "in the end <mark>amazon</mark>!"
    assert highlight("a.m.a.z.o.n here", terms) == "<mark>a.m.a.z.o.n</mark> here"
    assert highlight("ama-xon", terms).count("<mark>") == 1
    assert highlight("Amazonas", text_plan("ama").terms) == "<mark>Ama</mark>zonas"
    assert highlight("nothing", terms) == "nothing" and highlight(None, terms) is None
    assert snippet("one two three amazon five", terms, 2) == "three <mark>amazon</mark>"


def _counted(monkeypatch) -> list[str]:
    """The words whose distances highlighting computes, filled as it goes."""
    from sievio.operators import highlight as module

    words, own = [], module.distances
    monkeypatch.setattr(module, "distances", lambda term, w: words.extend(w) or own(term, w))
    return words


def test_a_word_is_compared_once_for_all_marked_texts(monkeypatch):
    words = _counted(monkeypatch)
    marker = Marker(text_plan("hypersmall ").terms)
    texts = [f"hyper-small bolt {i % 7} end" for i in range(500)]
    assert [marker.highlight(t) for part in marker.learn([None, *texts]) for t in part] == [None, *[t.replace("hyper-small", "<mark>hyper-small</mark>") for t in texts]]
    assert len(words) <= 12  # of 3500 occurrences


def test_a_word_is_compared_once_for_all_snippets(monkeypatch):
    words = _counted(monkeypatch)
    marker = Marker(text_plan("widget ").terms)
    texts = [f"some words before red{i % 5} widget and others after" for i in range(500)]
    assert [marker.snippet(t, 2) for part in marker.learn(texts) for t in part] == [f"red{i % 5} <mark>widget</mark>" for i in range(500)]
    assert len(words) <= 12
    long = " ".join(["x"] * 100_000 + ["widget", "y", "widget"])
    assert marker.snippet(long, 50_000) == " ".join(["x"] * 49_997 + ["<mark>widget</mark>", "y", "<mark>widget</mark>"])  # linear in the text


def test_crud(spark):
    rows = [{**r, "str": s} for r, s in zip(ROWS, ["ffff", "gggg", "hhhh", "iiii", "jjjj"])]
    index = build(spark, rows, ["str", "n", "nl", "b"], ["f", "fl"])

    def counts(*queries):
        return [total(index, q) for q in queries]

    three = ({"q": "hhhh"}, {"q": "hh"}, {"filter": {"n": 3}}, {"filter": {"f": "ccc"}}, {"filter": {"b": True}})
    assert counts(*three) == [1, 1, 1, 1, 3]
    old = index.get("3")
    index.delete("3")
    assert counts({}, *three) == [4, 0, 0, 0, 0, 2]
    with pytest.raises(NotFound):
        index.get("3")
    index.replace("3", old)
    assert counts(*three) == [1, 1, 1, 1, 3]
    index.replace("3", {"b": False, "fl": ["ttt", "sss"], "f": "fff", "nl": [8, 9, 10], "n": 6, "str": "kkkk"})
    assert counts({"q": "kkkk"}, {"filter": {"n": 6}}, {"filter": {"fl": "ttt"}}, {"filter": {"nl": 9}}, {"filter": {"n": 3}}, {"q": "hhhh"}) == [1, 1, 1, 1, 0, 0]
    index.patch("3", {"str": "hhhh", "n": 3, "nl": [8, 10, 11]})
    assert counts({"q": "hhhh"}, {"filter": {"nl": 11}}, {"filter": {"nl": 9}}, {"filter": {"f": "fff"}}, {"q": "kk"}) == [1, 1, 0, 1, 0]
    for i in ("1", "2"):
        index.delete(i)
    index.add({"_id": "9", "str": "z"})
    assert index._ids["9"] == 1  # the lowest free ordinal first
    index.clear()
    assert total(index, {}) == 0


def test_api(spark):
    engine = Engine(spark, "master", "key")
    assert engine.request("GET", "/ping")[0] == 200 and engine.request("GET", "/1/indexes")[0] == 400
    _, app = engine.request("POST", "/1/applications", {"name": "shop"}, "master", "key")
    auth = (app["appId"], app["apiKey"])
    assert engine.request("POST", "/1/indexes", {"name": "books", "settings": {"indexedFields": ["t"]}}, *auth)[0] == 200
    assert engine.request("POST", "/1/indexes/books", [{"_id": "x", "t": "hello"}, {"t": "help"}], *auth)[0] == 200
    status, r = engine.request("POST", "/1/indexes/books/query", {"q": "hel"}, *auth)
    assert status == 200 and r["totalHits"] == 2 and r["hits"][0]["_highlight"]["t"] == "<mark>hel</mark>lo"
    assert engine.request("GET", "/1/indexes/books/x", None, *auth)[1]["t"] == "hello"
    assert engine.request("GET", "/1/indexes/books/y", None, *auth)[0] == 404
    assert engine.request("POST", "/1/query", {"indexName": "zz"}, *auth)[0] == 400
    assert engine.request("GET", "/1/indexes/books/info", None, *auth)[1]["numDocuments"] == 2
    assert "sum" in engine.request("GET", "/1/indexes/books/stats", None, *auth)[1]["shards"][0]
    _, m = engine.request("GET", "/1/indexes/books/mapping", None, *auth)
    assert m["readyToIndex"] and m["strings"] == ["t"]
    _, key = engine.request("POST", "/1/keys", {"permissions": ["queryIndex"], "indexes": ["books"]}, *auth)
    limited = (app["appId"], key["apiKey"])
    assert engine.request("POST", "/1/indexes/books/query", {}, *limited)[0] == 200
    assert engine.request("DELETE", "/1/indexes/books", None, *limited)[0] == 403
    assert engine.request("GET", "/1/nothing", None, *auth)[0] == 403
    assert engine.request("DELETE", "/1/indexes/books", None, *auth)[0] == 200


def test_first_type_wins(spark):
    index = build(spark, [{"a": None, "n": 1}, {"a": "x", "n": "later"}, {"a": 5, "n": 2}], ["a", "n"])
    assert index.mapping.fields["a"].kind == "string" and index.mapping.fields["n"].kind == "number"
    assert [r["n"] for r in index.documents.orderBy("_docid").select("n").collect()] == [1.0, None, 2.0]


def test_naughty_strings(spark):
    texts = ["", " ", "\x00", "👾 🙇 💁", "Ω≈ç√∫˜µ≤≥÷", "田中さんにあげて下さい", "'; DROP TABLE x--", "<script>alert(1)</script>", "Z̮̞̠͙͔ͅḀ̗̞͈̻̗", "ᠮᠣᠩᠭᠣᠯ", "‮test‮", "../../etc/passwd", "ﬃ", "--", "...", "'''"]
    index = build(spark, [{"t": t} for t in texts], ["t"], ["t"])
    for t in ["👾", "田中", "'; DROP", "Z̮̞̠͙͔ͅḀ̗", "...", "ﬃ"]:
        assert index.query({"q": t, "filter": {"t": t}}).total().first()[0] >= 0


def test_saved_index(spark, tmp_path):
    index = build(spark, [{"t": "hello world"}, {"t": "other"}], ["t"]).saved(str(tmp_path))
    assert total(index, {"q": "wor"}) == 1 and total(index, {"q": "wolrd "}) == 1
    plan = index.query({"q": "wor"}).matches()._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(word,wor)" in plan


def test_stream(spark, tmp_path):
    from sievio.sources.readers import read_documents
    from sievio.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"_id": "1", "t": "hello"}\n{"_id": "2", "t": "world"}\n')
    table = read_documents(spark, str(tmp_path / "in"))
    index = SearchIndex(spark, "s", {"indexedFields": ["t"]})
    index.merge_table(table.limit(0))
    ingest(spark.readStream.schema(table.schema).json(str(tmp_path / "in")), index, str(tmp_path / "check")).awaitTermination()
    assert total(index, {"q": "wor"}) == 1


def test_engine_is_saved(spark, tmp_path):
    engine = Engine(spark, "m", "k")
    app = engine.create_app("a")
    app.create_index("i", {"indexedFields": ["t"]}).add([{"_id": "1", "t": "hello"}])
    key = app.add_key({"permissions": ["queryIndex"]})
    engine.save(str(tmp_path / "e"))
    again = Engine.load(spark, str(tmp_path / "e"))
    status, r = again.request("POST", "1/indexes/i/query", {"q": "hel"}, app.app_id, key.value)
    assert status == 200 and r["totalHits"] == 1 and again.request("GET", "1/version", None, "m", "k")[0] == 200
    assert again.request("GET", "1/indexes/i/1", None, app.app_id, app.api_key)[1]["t"] == "hello"


def test_late_fields_are_found(spark, tmp_path):
    """A field that comes up after any number of lines, in the second of several files, has the type that it has first."""
    from sievio.sources.readers import read_documents

    (tmp_path / "in").mkdir()
    lines = [json.dumps({"a": i} | ({"late": "x", "deep": {"n": [1]}} if i > 1200 else {})) for i in range(1500)]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "in" / "b.json").write_text('{"late": 5, "last": null}\n')
    table = read_documents(spark, str(tmp_path / "in"))
    assert dict(table.dtypes) == {"a": "double", "late": "string", "deep": "struct<n:array<double>>", "last": "string"}
    assert table.count() == 1501 and table.filter("late = 'x'").count() == 299
    (tmp_path / "in" / "c.json").write_text("[1]\n")
    with pytest.raises(QueryError):
        read_documents(spark, str(tmp_path / "in"))


def test_adds_by_both_routes(spark):
    """Nothing is lost, whichever way documents come and in whatever order."""
    index = SearchIndex(spark, "t", {"indexedFields": ["t", "n"]})
    table = lambda *rows: spark.createDataFrame(rows, "_id string, t string, n long")
    index.add({"_id": "1", "t": "one", "n": 1})
    index.add(table(("2", "two", 2), ("3", "three", 3)))
    index.add({"_id": "4", "t": "four", "n": 4})
    assert sorted(r["_id"] for r in index.documents.collect()) == ["1", "2", "3", "4"] and index.get("2")["t"] == "two"
    index.add({"_id": "2", "t": "zwei", "n": 2.5})
    index.patch("3", {"t": "drei"})
    index.delete("1")
    index.add(table(("4", "vier", 4), ("5", "five", 5)))
    index.replace("5", {"t": "fuenf"})
    got = {r["_id"]: (r["t"], r["n"]) for r in index.documents.collect()}
    assert got == {"2": ("zwei", 2.5), "3": ("drei", 3.0), "4": ("vier", 4.0), "5": ("fuenf", None)}
    assert len({r["_docid"] for r in index.documents.collect()}) == 4 and total(index, {"q": "vier"}) == 1
    for i in (1, 7):
        with pytest.raises(NotFound):
            index.get(str(i))
    for n in range(10):  # plans don't grow with the number of changes
        index.merge_table(table((f"m{n}", "more", n)))
    assert index.documents.count() == 14 and index.documents._jdf.queryExecution().logical().toString().count("Join") <= 12
    index.clear()
    assert index.documents.count() == 0
    index.add({"_id": "x", "t": "after"})
    assert total(index, {"q": "after"}) == 1


def test_patch_by_table(spark):
    """New columns are added; of several rows of an id one counts."""
    index = SearchIndex(spark, "t", {"indexedFields": ["t"]})
    index.add([{"_id": str(i), "t": f"w{i}"} for i in range(3)])
    index.patch_table(spark.createDataFrame([("1", "new", 1, 1), ("1", "newer", 2, 2), ("9", "none", 3, 3), ("2", None, 4, 4)], "_id string, t string, extra int, at int"), order="at")
    got = {r["_id"]: (r["t"], r["extra"]) for r in index.documents.collect()}
    assert got == {"0": ("w0", None), "1": ("newer", 2), "2": ("w2", 4)}


def test_one_row_of_an_id_is_merged(spark):
    index = SearchIndex(spark, "t", {"indexedFields": ["t"]})
    rows = spark.createDataFrame([("1", "a", 1), ("1", "b", 3), ("1", "c", 2), (None, "d", 0), (None, "e", 0)], "_id string, t string, at int")
    index.merge_table(rows.filter("_id is not null"), order="at")
    assert [r["t"] for r in index.documents.collect()] == ["b"]
    index.merge_table(rows.filter("_id is null"))
    found = index.documents.collect()
    assert len(found) == 3 and {r["_id"] for r in found} == {r["_id"] for r in index.documents.collect()}
    assert index.query({"q": "d"}).hits().select("_id").first()[0] in {r["_id"] for r in found}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from sievio.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("_id string, t string").json(str(tmp_path / "in"))
    (tmp_path / "in" / "a.json").write_text('{"_id": "1", "t": "hello"}\n{"_id": "2", "t": "world"}\n')
    ingest(stream, SearchIndex(spark, "s", {"indexedFields": ["t"]}), str(tmp_path / "check")).awaitTermination()
    (tmp_path / "in" / "b.json").write_text('{"_id": "2", "t": "again"}\n{"_id": "3", "t": "third"}\n')
    index = SearchIndex(spark, "s", {"indexedFields": ["t"]})
    ingest(stream, index, str(tmp_path / "check")).awaitTermination()
    assert sorted((r["_id"], r["t"]) for r in index.documents.collect()) == [("1", "hello"), ("2", "again"), ("3", "third")]
    assert total(index, {"q": "hel"}) == 1 and total(index, {"q": "world"}) == 0


def test_far_words(spark):
    """A word beyond place 2^20 keeps its field and its place, by one word and by two."""
    long = "x " * 1_048_580 + "needle pin"
    index = build(spark, [{"a": long, "b": "pin"}], ["a", "b"])
    (h,) = explains(index, "needle ")
    assert (h["field"], h["position"]) == (0, 1_048_581)
    (h,) = explains(index, "needle pin ")
    assert (h["field"], h["position"], h["proximity"]) == (0, 1_048_581, 1)


def test_jobs_wait_their_turn(spark):
    import threading

    from sievio.errors import SearchError
    from sievio.index import _Jobs

    jobs, order, first = _Jobs(3), [], threading.Event()

    def job(n):
        with jobs:
            first.wait(10)
            order.append(n)

    threads = []
    for n in range(3):
        threads.append(threading.Thread(target=job, args=(n,)))
        threads[-1].start()
        while jobs.waiting <= n:
            pass
    with pytest.raises(SearchError) as e, jobs:
        pass
    assert e.value.status == 429 and jobs.waiting == 3
    first.set()
    for t in threads:
        t.join()
    assert order == [0, 1, 2] and jobs.waiting == 0


def test_snippets(spark):
    index = build(spark, [{"t": "one two three amazon five six", "o": {"t": "far amazon near"}, "l": ["an amazon", "none here"]}], ["t", "o.t", "l"])
    (row,) = index.query({"q": "amazon", "highlightFields": ["t:2", "o.t:1", "l:1"]}).hits().collect()
    assert row["_highlight"]["t"] == "three <mark>amazon</mark>" and row["_highlight"]["o"]["t"] == "<mark>amazon</mark>"
    assert row["_highlight"]["l"] == ["<mark>amazon</mark>", "none"] and row["t"] == "one two three amazon five six"


def test_package_for_workers(spark):
    from sievio.sources.staging import ship

    ship(ship(spark))
    assert "sievio.zip" in " ".join(spark.sparkContext.listFiles if isinstance(spark.sparkContext.listFiles, list) else spark.sparkContext.listFiles())


def _walk(a: list[int], b: list[int]) -> int:
    """The least distance that a merge walk over two sorted lists of places meets, at most 8; equal places don't count."""
    best, i, j = 8, 0, 0
    while i < len(a) and j < len(b):
        if a[i] != b[j]:
            best = min(best, abs(a[i] - b[j]))
        if a[i] <= b[j]:
            i += 1
        else:
            j += 1
    return best


def _rank(occurrences: list[dict], plan) -> dict:
    """The rank of a document with these matched occurrences (key, first, dist, word), two words or more."""
    n = plan.slots
    literal = set(plan.words) & {o["word"] for o in occurrences}
    exact = sum(w in literal for w in plan.words)
    typos: list[int | None] = [None] * n
    spare: list[int] = []
    places: list[set[int]] = [set() for _ in range(n)]
    near = [None] * n
    everywhere = None
    lowest = min(o["key"] for o in occurrences)
    if n == 2:
        for o in occurrences:
            if o["first"] < 2:
                s = o["first"]
                typos[s] = o["dist"] if typos[s] is None else min(typos[s], o["dist"])
                places[s].add(o["key"])
            else:
                near[0], typos = 1, [0, 0]
                places[0].add(o["key"])
                places[1].add(o["key"])
                break
        if near[0] == 1:
            return _result(0, 1, lowest, exact)
    else:
        last = 2 * n - 1
        for o in occurrences:
            t, s = o["first"], o["first"] // 2
            typos[s] = o["dist"] if typos[s] is None else min(typos[s], o["dist"])
            places[s].add(o["key"])
            if t == last:
                everywhere = n - 1
            elif t % 2:
                near[s], typos[s + 1] = 1, 0
                places[s + 1].add(o["key"])
        if everywhere is not None:
            typos = [0] * n
    spare = [t for t in typos if t is not None]
    total = sum(min(spare, default=0) if t is None else t for t in typos)  # a slot whose word an earlier one took counts as that one
    if everywhere is not None:
        return _result(total, everywhere, lowest, exact)
    ordered = [sorted(p) for p in places]
    proximity = sum(near[i] or _walk(ordered[i], ordered[i + 1]) for i in range(n - 1))
    return _result(total, proximity, lowest, exact)


def _result(typos: int, proximity: int, key: int, exact: int) -> dict:
    return {"typos": typos, "proximity": proximity, "field": key // (1 << 40), "position": key % (1 << 40), "exact": exact}


@pytest.mark.parametrize("q", ["red gizm", "aa bb ", "abcd abce ", "one two thre", "aa bb cc dd ", "one one ", "abcd abcd abcd "])
def test_ranks_of_several_words(spark, q):
    """The plan's ranks are those of a walk over each document's occurrences."""
    import random

    from sievio.operators import match, rank

    rnd, plan = random.Random(q), text_plan(q)
    words = sorted({t.word for t in plan.terms} | {"redgizmo", "gizmo", "abcf", "xx", "twothree", "aabb", "three"})
    index = build(spark, [{"a": " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12))), "b": " ".join(rnd.choice(words) for _ in range(rnd.randrange(4)))} for _ in range(80)], ["a", "b"])
    found = match.occurrences(index.postings(), plan, index.vocabulary())
    per = {}
    for r in found.collect():
        per.setdefault(r["_docid"], []).append({"key": r["priority"] * (1 << 40) + r["position"], "first": r["first"], "dist": r["dist"], "word": r["word"]})
    got = {r["_docid"]: tuple(r[c] for c in rank.RANK) for r in rank.ranked(found, plan).collect()}
    held = {r["_docid"] for r in match.matching(found, plan).collect()}
    assert set(got) == held and got == {d: tuple(_rank(per[d], plan)[c] for c in rank.RANK) for d in held}


def _blocks(analyzer, docs, texts):
    import pyarrow as pa

    from sievio.functions.analyzer import _Block

    block = _Block(analyzer)
    for a in range(0, len(texts), 40):
        block.add(pa.array(docs[a : a + 40], pa.int64()), pa.array(texts[a : a + 40]), 1)
    return block.close(3).to_pylist()


@pytest.mark.parametrize("analyzer", ["default", "whitespace"])
def test_blocks_have_the_words_of_the_analyzer(monkeypatch, analyzer):
    """Each word once (or in lines of MOST), sorted, with all its documents and positions, whatever the texts."""
    import random

    from sievio.functions import analyzer as module

    monkeypatch.setattr(module, "MOST", 3)
    rnd, signs = random.Random(7), ["a", "B", "ab", "Foo", "ña", "İ", "½", "²", "-", ".", "'", "###", '"', " ", " ", "\n", "\x1c", "\x85", "\u3000", "\u0301", "z" * 126, "_1"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(15))) for _ in range(600)]
    docs = [None if i % 97 == 0 else i for i in range(600)]
    lines = _blocks(analyzer, docs, texts)
    assert [r["word"].encode() for r in lines] == sorted(r["word"].encode() for r in lines) and all(0 < len(r["docs"]) <= 3 and r["priority"] == 3 for r in lines)
    got = sorted((str(d), r["word"], p) for r in lines for d, p in zip(r["docs"], r["positions"]))
    assert got == sorted((str(d), w, p) for d, t in zip(docs, texts) for w, p in module.ANALYZERS[analyzer](t))


def test_typos_need_no_vocabulary_and_no_shuffle_of_postings(spark):
    """A distance is computed for a line of a block; the only shuffles are those of matches."""
    index = build(spark, [{"a": "worthless thing"}, {"a": "worhtless, other"}, {"a": "words"}] * 20, ["a"])
    q = index.query({"q": "worhtless "})
    plan = q.matches().select("_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and index._words is None
    assert q.matches().count() == 40
    assert sorted(map(tuple, index.vocabulary().collect())) == [("other", 20), ("thing", 20), ("words", 20), ("worhtless", 20), ("worthless", 20)]


def test_kept_postings_have_a_line_for_a_word(spark):
    """Not one for every occurrence: that is what keeping them costs."""
    index = build(spark, [{"a": "one two one"}] * 300, ["a"])
    kept, _ = index.lookup()
    assert index.postings().count() == 900 and kept.count() < 100
    assert index.query({"q": "one two "}).matches().count() == 300

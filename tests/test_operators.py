"""Operators on small literal collections: semantics that the tables don't show, and what queries are refused for."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from fathom.plans import query as q
from fathom.plans.catalog import IndexCatalog
from fathom.plans.compiler import Compiler
from fathom.plans.definition import IndexDefinition
from fathom.plans.errors import QueryError
from fathom.plans.index import SearchIndex

ROWS = [
    (1, "The quick brown fox jumps", ["red", "green"], 3.0, [1, 9], True, dt.datetime(2020, 1, 1)),
    (2, "A quick red fox; the lazy dog", ["blue"], None, [4], False, dt.datetime(2021, 6, 1)),
    (3, "brown dogs are never quick", [], float("nan"), [], None, None),
    (4, None, None, -1.5, None, True, dt.datetime(2019, 3, 5)),
    (5, "Fox fox fox", ["", "red", "red"], 3.0, [5, 6], False, dt.datetime(2020, 1, 1)),
]
SCHEMA = "_id int, title string, colours array<string>, size double, marks array<int>, flag boolean, day timestamp"
FIELDS = {
    "title": [{"type": "string", "multi": {"english": {"type": "string", "analyzer": "lucene.english"}}}, {"type": "autocomplete"}],
    "colours": [{"type": "token"}, {"type": "stringFacet"}], "size": [{"type": "number"}, {"type": "numberFacet"}], "marks": {"type": "number"}, "flag": {"type": "boolean"}, "day": [{"type": "date"}, {"type": "dateFacet"}],
}


@pytest.fixture(scope="module")
def index(spark):
    return SearchIndex(spark.createDataFrame(ROWS, SCHEMA), {"mappings": {"fields": FIELDS}, "storedSource": {"include": ["title"]}})


def ids(index, op, **options):
    return [r["_id"] for r in q.search(index, op | {"limit": 10} | options).collect()]


def found(index, op):
    return sorted(ids(index, op, limit=100))


@pytest.mark.parametrize(
    ("op", "wanted"),
    [
        ({"text": {"path": "title", "query": "FOX dog"}}, [1, 2, 5]),
        ({"text": {"path": "title", "query": "fox the", "matchCriteria": "all"}}, [1, 2]),
        ({"text": {"path": "title", "query": "..."}}, []),
        ({"text": {"path": {"value": "title", "multi": "english"}, "query": "dog jumping"}}, [1, 2, 3]),
        ({"text": {"path": "title", "query": "qiuck", "fuzzy": {"maxEdits": 1}}}, [1, 2, 3]),
        ({"text": {"path": "title", "query": "xuick", "fuzzy": {"maxEdits": 1, "prefixLength": 1}}}, []),
        ({"phrase": {"path": "title", "query": "quick fox"}}, []),
        ({"phrase": {"path": "title", "query": "quick fox", "slop": 1}}, [1, 2]),
        ({"phrase": {"path": "title", "query": ["lazy dog", "brown fox"]}}, [1, 2]),
        ({"autocomplete": {"path": "title", "query": "qui"}}, [1, 2, 3]),
        ({"autocomplete": {"path": "title", "query": "brown f", "tokenOrder": "sequential"}}, [1]),
        ({"wildcard": {"path": "title", "query": "d?g*", "allowAnalyzedField": True}}, [2, 3]),
        ({"regex": {"path": "title", "query": "fo[xy]", "allowAnalyzedField": True}}, [1, 2, 5]),
        ({"term": {"path": "title", "query": "Fox"}}, [1, 2, 5]),
        ({"term": {"path": "title", "query": "do", "prefix": True}}, [2, 3]),
        ({"search": {"path": "title", "query": "quick bro", "phrase": {"prefix": True}}}, [1]),
        ({"queryString": {"defaultPath": "title", "query": "fox AND NOT lazy"}}, [1, 5]),
        ({"queryString": {"defaultPath": "title", "query": '"lazy dog" OR size:[2 TO 4]'}}, [1, 2, 5]),
        ({"moreLikeThis": {"like": {"title": "fox fox brown unknown"}}}, [1, 2, 3, 5]),
        ({"span": {"near": {"clauses": [{"term": {"path": "title", "query": "fox"}}, {"term": {"path": "title", "query": "quick"}}], "slop": 1}}}, [1, 2]),
        ({"span": {"near": {"clauses": [{"term": {"path": "title", "query": "fox"}}, {"term": {"path": "title", "query": "quick"}}], "slop": 1, "inOrder": True}}}, []),
        ({"span": {"first": {"operator": {"term": {"path": "title", "query": "fox"}}, "endPositionLte": 1}}}, [5]),
        ({"equals": {"path": "colours", "value": "red"}}, [1, 5]),
        ({"equals": {"path": "flag", "value": True}}, [1, 4]),
        ({"equals": {"path": "size", "value": 3}}, [1, 5]),
        ({"equals": {"path": "size", "value": None}}, [2]),
        ({"in": {"path": "marks", "value": [9, 4]}}, [1, 2]),
        ({"range": {"path": "marks", "gt": 4, "lt": 9}}, [5]),  # both bounds on one element: 1 and 9 don't count together
        ({"range": {"path": "size", "gte": -1.5}}, [1, 4, 5]),  # NaN is in no range
        ({"range": {"path": "size", "gt": 5, "lt": 2}}, []),
        ({"range": {"path": "day", "gte": dt.datetime(2020, 1, 1), "lt": dt.datetime(2021, 1, 1)}}, [1, 5]),
        ({"exists": {"path": "size"}}, [1, 3, 4, 5]),
        ({"exists": {"path": "colours"}}, [1, 2, 3, 5]),
        ({"compound": {"mustNot": [{"exists": {"path": "title"}}]}}, [4]),
        ({"compound": {"should": [{"term": {"path": "title", "query": "brown"}}, {"term": {"path": "title", "query": "dogs"}}], "minimumShouldMatch": 2}}, [3]),
        ({"compound": {"filter": [{"exists": {"path": "title"}}], "should": [{"term": {"path": "title", "query": "never"}}]}}, [1, 2, 3, 5]),
    ],
)
def test_matches(index, op, wanted):
    assert found(index, op) == wanted


@pytest.mark.parametrize(
    "query",
    [
        {}, {"text": {"path": "title", "query": "a"}, "exists": {"path": "size"}}, {"text": {"path": "title"}}, {"text": {"path": "title", "query": "a", "unknown": 1}},
        {"text": {"path": "title", "query": "a", "fuzzy": {}, "synonyms": "x"}}, {"text": {"path": "title", "query": "a", "fuzzy": {"maxEdits": 3}}},
        {"range": {"path": "size"}}, {"range": {"path": "size", "gt": 1, "gte": 2}}, {"range": {"path": "size", "gt": 1, "lt": "x"}}, {"range": {"path": "flag", "gt": True}},
        {"in": {"path": "size", "value": [1, "x"]}}, {"in": {"path": "size", "value": []}}, {"equals": {"path": "title", "value": "x"}}, {"autocomplete": {"path": "colours", "query": "x"}},
        {"wildcard": {"path": "title", "query": "x*"}}, {"near": {"path": "size", "origin": 1, "pivot": 0}}, {"compound": {}},
        {"exists": {"path": "size"}, "sort": {"size": 2}}, {"exists": {"path": "size"}, "sort": {"title": 1}}, {"exists": {"path": "size"}, "sort": {"size": 1}, "sortBetaV1": {"size": 1}},
        {"exists": {"path": "size"}, "searchAfter": "a", "searchBefore": "b"}, {"exists": {"path": "size"}, "count": {"type": "none"}}, {"exists": {"path": "size"}, "returnScope": {"path": "title"}},
        {"exists": {"path": "size", "score": {"constant": {"value": -1}}}}, {"exists": {"path": "size", "score": {"dismax": {}}}}, {"exists": {"path": "size", "score": {"boost": {"value": 2, "path": "size"}}}},
        {"facet": {"facets": {}}}, {"facet": {"facets": {"a": {"type": "number", "path": "size", "boundaries": [2, 1]}}}}, {"facet": {"facets": {"a": {"type": "string", "path": "colours", "numBuckets": 0}}}},
        {"span": {"near": {"clauses": []}}}, {"term": {"path": "title", "query": "a", "prefix": True, "regex": True}}, {"queryString": {"defaultPath": "title", "query": "$x:1"}},
    ],
)
def test_refused(index, query):
    with pytest.raises(QueryError):
        (q.search_meta if "facet" in query else q.search)(index, query)


def test_scores(index):
    op = {"near": {"path": "size", "origin": 3, "pivot": 2}}
    assert [(r["_id"], round(r["__score"], 6)) for r in q.search(index, op | {"limit": 3}).collect()] == [(1, 1.0), (5, 1.0), (4, round(2 / 6.5, 6))]
    boosted = {"equals": {"path": "flag", "value": True, "score": {"boost": {"path": "size", "undefined": 7}}}}
    assert [(r["_id"], r["__score"]) for r in q.search(index, boosted).collect()] == [(1, 3.0), (4, -1.5)]
    # A stored array and one that is analysed in the query give the same scores.
    a = {r["_id"]: r["__score"] for r in q.search(index, {"text": {"path": "title", "query": "fox quick"}}).collect()}
    b = {r["_id"]: r["__score"] for r in q.search(index.materialized(), {"text": {"path": "title", "query": "fox quick"}}).collect()}
    assert a == b and set(a) == {1, 2, 3, 5}


def test_sort_of_nulls_nan_and_arrays(index):
    op = {"compound": {"mustNot": [{"equals": {"path": "marks", "value": 99}}]}}
    assert ids(index, op, sort={"size": 1}) == [2, 3, 4, 1, 5]
    assert ids(index, op, sort={"size": -1}) == [1, 5, 4, 3, 2]
    assert ids(index, op, sort={"size": {"order": 1, "noData": "highest"}}) == [3, 4, 1, 5, 2]
    assert ids(index, op, sort={"marks": 1}) == [3, 4, 1, 2, 5]  # least element
    assert ids(index, op, sort={"marks": -1})[:3] == [1, 5, 2]  # largest element


@pytest.mark.parametrize("sort", [{"size": 1}, {"size": -1, "_id": -1}, {"day": -1}, None])
def test_pages_cover_everything_once(spark, sort):
    own = SearchIndex(spark.createDataFrame(ROWS, SCHEMA), {"mappings": {"fields": FIELDS | {"_id": {"type": "number"}}}})
    query = {"exists": {"path": "_id"}, "limit": 2} | ({"sort": sort} if sort else {})
    whole = ids(own, {k: v for k, v in query.items() if k != "limit"}, limit=100)
    seen, token = [], None
    while rows := q.search(own, query | ({"searchAfter": token} if token else {})).collect():
        seen += [r["_id"] for r in rows]
        token = rows[-1]["__token"]
    assert seen == whole and len(whole) == 5
    last = q.search(own, query | {"limit": 5}).collect()[-1]["__token"]
    assert [r["_id"] for r in q.search(own, query | {"searchBefore": last}).collect()] == whole[2:4]


def test_facets_of_arrays_and_empty_labels(index):
    rows = q.search_meta(index, {"facet": {"facets": {"c": {"type": "string", "path": "colours"}, "s": {"type": "number", "path": "size", "boundaries": [-2, 0, 5], "default": "rest"}}}}).collect()
    assert sorted((r["facet"], r["rank"], r["label"], r["count"]) for r in rows) == [("c", 0, "red", 2), ("c", 1, "blue", 1), ("c", 2, "green", 1), ("s", 0, "-2.0", 1), ("s", 1, "0.0", 2), ("s", 3, "rest", 2)]


def test_stored_source_details_highlights_explain(index):
    got = q.search(index, {"text": {"path": "title", "query": "fox"}, "returnStoredSource": True, "scoreDetails": True, "highlight": {"path": "title"}}).collect()
    assert set(got[0].asDict()) == {"title", "__score", "__details", "__token", "__highlights"}
    assert got[0]["__details"]["value"] == got[0]["__score"]
    texts = {r["title"]: [[(t["value"], t["type"]) for t in h["texts"]] for h in r["__highlights"]] for r in got}
    assert texts["The quick brown fox jumps"] == [[("The quick brown ", "text"), ("fox", "hit"), (" jumps", "text")]]
    made = q.explain(index, {"text": {"path": "title", "query": "fox"}}, "executionStats")
    assert made["matches"] == 3 and "title" in made["fields"] and "Window" not in made["plan"]


def test_text_is_analysed_once_in_a_plan(index):
    plan = q.explain(index, {"compound": {"must": [{"text": {"path": "title", "query": "fox quick"}}], "filter": [{"range": {"path": "size", "gt": 1}}]}})["plan"]
    assert plan.count("regexp_extract_all") <= 2  # the generator's node and its entry in the details
    assert "PushedFilters" not in plan or "size" in plan


def test_nested_documents(spark):
    rows = [(1, [("a", 1.0, [("x", 1)]), ("b", 5.0, [])], "in"), (2, [("a", 5.0, [("y", 2), ("x", 3)])], "out"), (3, [], "in"), (4, None, "in")]
    df = spark.createDataFrame(rows, "_id int, parts array<struct<kind:string,n:double,subs:array<struct<name:string,m:int>>>>, state string")
    fields = {"parts": {"type": "embeddedDocuments", "fields": {"kind": [{"type": "token"}, {"type": "string"}], "n": {"type": "number"}, "subs": {"type": "embeddedDocuments", "fields": {"name": {"type": "token"}, "m": {"type": "number"}}}}}, "state": [{"type": "token"}]}
    index = SearchIndex(df, {"mappings": {"fields": fields}, "storedSource": True})
    both = {"compound": {"must": [{"equals": {"path": "parts.kind", "value": "a"}}, {"range": {"path": "parts.n", "gte": 5}}]}}
    assert found(index, {"embeddedDocument": {"path": "parts", "operator": both}}) == [2]
    deep = {"embeddedDocument": {"path": "parts.subs", "operator": {"equals": {"path": "parts.subs.name", "value": "x"}}}}
    assert found(index, {"embeddedDocument": {"path": "parts", "operator": deep}}) == [1, 2]
    assert found(index, {"embeddedDocument": {"path": "parts", "operator": {"text": {"path": "parts.kind", "query": "B"}}}}) == [1]
    op = {"compound": {"must": [{"exists": {"path": "parts.kind"}}], "filter": [{"hasRoot": {"operator": {"equals": {"path": "state", "value": "in"}}}}]}}
    got = q.search(index, op | {"returnScope": {"path": "parts"}, "returnStoredSource": True}).collect()
    assert sorted((r["__root_id"], r["kind"]) for r in got) == [(1, "a"), (1, "b")]
    op = {"compound": {"must": [{"exists": {"path": "parts.subs.name"}}], "filter": [{"hasAncestor": {"ancestorPath": "parts", "operator": {"range": {"path": "parts.n", "gt": 2}}}}]}}
    got = q.search(index, op | {"returnScope": {"path": "parts.subs"}, "returnStoredSource": True}).collect()
    assert sorted((r["__root_id"], r["name"]) for r in got) == [(2, "x"), (2, "y")]
    with pytest.raises(QueryError):
        q.search(index, {"embeddedDocument": {"path": "parts", "operator": {"equals": {"path": "state", "value": "in"}}}})


def test_geo(spark):
    at = lambda lon, lat: {"type": "Point", "coordinates": [float(lon), float(lat)]}
    square = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}
    rows = [(1, at(0.5, 0.5), json.dumps(square)), (2, at(1.5, 1.5), json.dumps(at(3, 3))), (3, at(10, 10), json.dumps({"type": "LineString", "coordinates": [[-1, 3], [5, 3]]})), (4, None, None)]
    df = spark.createDataFrame(rows, "_id int, place struct<type:string,coordinates:array<double>>, shape string")
    index = SearchIndex(df, {"mappings": {"fields": {"place": {"type": "geo"}, "shape": {"type": "geo", "indexShapes": True}}}})
    assert found(index, {"geoWithin": {"path": "place", "geometry": square}}) == [1]  # 2 is in the hole
    assert found(index, {"geoWithin": {"path": "place", "box": {"bottomLeft": at(0, 0), "topRight": at(2, 2)}}}) == [1, 2]
    assert found(index, {"geoWithin": {"path": "place", "circle": {"center": at(0, 0), "radius": 80_000}}}) == [1]
    assert ids(index, {"near": {"path": "place", "origin": at(2, 2), "pivot": 1000}}) == [2, 1, 3]
    solid = {"type": "Polygon", "coordinates": [square["coordinates"][0]]}
    assert found(index, {"geoShape": {"path": "shape", "relation": "within", "geometry": solid}}) == [1, 2]
    assert found(index, {"geoShape": {"path": "shape", "relation": "intersects", "geometry": solid}}) == [1, 2, 3]
    assert found(index, {"geoShape": {"path": "shape", "relation": "disjoint", "geometry": {"type": "Point", "coordinates": [50, 50]}}}) == [1, 2, 3]


def test_vectors(spark):
    rows = [(k, [1 - k / 10, k / 10, 0.0], k % 2, [k - 5, 3 - k]) for k in range(10)] + [(10, [0.0, 0.0, 0.0], 0, [1, 1]), (11, [1.0], 1, None), (12, None, 1, None)]
    df = spark.createDataFrame(rows, "_id int, v array<float>, f int, b array<tinyint>")
    fields = [{"type": "vector", "path": "v", "numDimensions": 3, "similarity": "cosine"}, {"type": "filter", "path": "f"}, {"type": "vector", "path": "b", "numDimensions": 2, "similarity": "euclidean"}]
    index = SearchIndex(df, IndexDefinition.vector(fields))
    hits = q.vector(index, {"path": "v", "queryVector": [1, 0, 0], "exact": True, "limit": 20}).collect()
    assert [r["_id"] for r in hits] == list(range(10)) and hits[0]["__score"] == pytest.approx(1.0)  # zero and short vectors have no place
    assert [r["_id"] for r in q.vector(index, {"path": "v", "queryVector": [1, 0, 0], "numCandidates": 5, "limit": 2, "filter": {"f": {"$gte": 1}}}).collect()] == [1, 3]
    assert [r["_id"] for r in q.vector(index, {"path": "b", "queryVector": [0, 0], "exact": True, "limit": 2}).collect()] == [4, 10]
    traced = {r["_id"]: (r["rank"], r["in_results"]) for r in __import__("fathom.operators.vector", fromlist=["trace"]).trace(Compiler(index), {"path": "v", "queryVector": [1, 0, 0], "exact": True, "limit": 3}, [2, 7, 12]).collect()}
    assert traced == {2: (3, True), 7: (8, False), 12: (None, False)}
    for bad in ({"queryVector": [1, 0]}, {"queryVector": [0, 0, 0]}, {"queryVector": [1, 0, float("nan")]}, {"queryVector": [1, 0, 0], "numCandidates": 5}, {"queryVector": [1, 0, 0], "query": "x"}):
        with pytest.raises(QueryError):
            q.vector(index, {"path": "v", "exact": True, "limit": 2} | bad)
    with pytest.raises(QueryError):
        q.vector(index, {"path": "v", "queryVector": [1, 0, 0], "numCandidates": 2, "limit": 3})


def test_catalog(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    held = IndexCatalog()
    made = held.manage("things", {"createSearchIndexes": {"indexes": [{"name": "default", "definition": {"mappings": {"dynamic": True}}}]}}, df)
    assert [x["name"] for x in made] == ["default"]
    assert {r["_id"] for r in held.run("things", {"search": {"text": {"path": "title", "query": "fox"}}}).collect()} == {1, 2, 5}
    held.manage("things", {"updateSearchIndex": {"name": "default", "definition": {"mappings": {"dynamic": False}}}})
    assert held.run("things", {"search": {"text": {"path": "title", "query": "fox"}}}).count() == 0
    assert held.manage("things", {"dropSearchIndex": {"name": "default"}}) == []
    with pytest.raises(QueryError):
        held.run("things", {"search": {"exists": {"path": "title"}}})


def test_written_index_reads_what_a_query_names(spark, index, tmp_path):
    held = index.write(f"file://{tmp_path}/index")
    assert sorted(ids(held, {"text": {"path": "title", "query": "fox"}})) == [1, 2, 5]
    plan = q.count(held, {"range": {"path": "size", "gt": 1}, "count": {"type": "total"}})._jdf.queryExecution().executedPlan().toString()
    assert "title" not in plan.split("ReadSchema")[-1] and "GreaterThan(size,1" in plan


def test_field_names_tell_null_from_missing(spark):
    df = spark.createDataFrame([(1, None, ["_id", "a"]), (2, None, ["_id"]), (3, 5, ["_id", "a"])], "_id int, a int, names array<string>")
    index = SearchIndex(df, {"mappings": {"dynamic": True}}, field_names_col="names")
    assert found(index, {"equals": {"path": "a", "value": None}}) == [1]
    assert found(index, {"exists": {"path": "a"}}) == [1, 3]


def test_mixed_types_sort(spark):
    df = spark.createDataFrame([(1, '"b"'), (2, "10"), (3, "true"), (4, "null"), (5, "2.5"), (6, '"a"'), (7, "{}"), (8, None)], "_id int, j string").select("_id", F.try_parse_json("j").alias("x"))
    index = SearchIndex(df, {"mappings": {"fields": {"x": {"type": "token"}, "_id": {"type": "number"}}}})
    assert ids(index, {"exists": {"path": "_id"}}, sort={"x": 1})[2:] == [5, 2, 6, 1, 7, 3]


def test_shards_merge_to_one_result(spark, index):
    from fathom.plans import sharded

    halves = [SearchIndex(spark.createDataFrame([r for r in ROWS if r[0] % 2 == k], SCHEMA), {"mappings": {"fields": FIELDS}}) for k in (0, 1)]
    query = {"exists": {"path": "_id"}, "sort": {"size": -1}, "limit": 3}
    assert [r["_id"] for r in sharded.search(halves, query).collect()] == ids(index, {"exists": {"path": "_id"}}, sort={"size": -1}, limit=3)
    assert sharded.plan(halves[0], query) == {"merge": "sort", "sortSpec": {"size": -1}, "limit": 3}
    meta = {"facet": {"facets": {"c": {"type": "string", "path": "colours"}, "s": {"type": "number", "path": "size", "boundaries": [-2, 0, 5]}}}}
    rows = lambda df: sorted((r["facet"], r["rank"], r["label"], r["count"]) for r in df.collect())
    assert rows(sharded.search_meta(halves, meta)) == rows(q.search_meta(index, meta))


@pytest.mark.parametrize(("slop", "groups"), [(3, None), (3, [(0, 0), (1, 0)]), (40, [(0, 0), (1, 0), (3, 0)]), (4, [(0, 0), (1, 1), (2, 0)])])
def test_sloppy_phrases_against_a_plain_loop(spark, slop, groups):
    from fathom.operators.text import _sloppy

    rng, n = random.Random(slop), len(groups or [0, 0, 0])
    rows = []
    for k in range(100):
        own = {g: [rng.randrange(60) for _ in range(rng.randint(0, 20))] for g in range(n)}
        rows.append((k, [[p - at for p in own[g]] for at, g in groups or [(j, j) for j in range(n)]]))
    got = {r["k"]: r["f"] for r in spark.createDataFrame(rows, "k int, p array<array<int>>").select("k", _sloppy([F.col("p")[j] for j in range(n)], slop, groups).alias("f")).collect()}
    for k, places in rows:
        total = 0.0
        for v in {p for own in places for p in own}:
            reach, taken = 0, set()
            for own, (at, g) in zip(places, groups or [(j, j) for j in range(n)], strict=True):
                p = min((p for p in own if p >= v and (g, p + at) not in taken), default=1 << 30)
                reach = max(reach, p - v)
                taken.add((g, p + at))
            total += 1 / (1 + reach) if reach <= slop else 0.0
        assert got[k] == pytest.approx(total), places


def test_sloppy_phrases_in_a_text_of_one_word(spark):
    """Time grows with the number of places: pair by pair this takes minutes."""
    index = SearchIndex(spark.createDataFrame([(1, "de " * 40_000)], "_id long, t string"), {"mappings": {"fields": {"t": {"type": "string", "analyzer": "lucene.simple"}}}})
    start = time.monotonic()
    assert ids(index, {"phrase": {"path": "t", "query": "de de", "slop": 3}}) == [1]
    assert time.monotonic() - start < 30


@pytest.mark.parametrize(("n", "slop"), [(2, 0), (2, 3), (3, 2), (3, 8)])
def test_terms_in_order_against_pairs(spark, n, slop):
    """Spans of single terms, found by sets of places, are those found pair by pair."""
    import importlib

    span, rng = importlib.import_module("fathom.operators.span"), random.Random(n * 10 + slop)
    df = spark.createDataFrame([(k, [[rng.randrange(30) for _ in range(rng.randint(0, 12))] for _ in range(n)]) for k in range(100)], "k int, p array<array<int>>")
    own = [F.transform(F.col("p")[j], lambda p: F.struct(p.alias("s"), (p + 1).alias("e"), F.lit(1).alias("n"))) for j in range(n)]
    sets = span.in_order([span.Spans(None, x, [], F.col("p")[j]) for j, x in enumerate(own)], slop)
    pairs = span.in_order([span.Spans(None, x, []) for x in own], slop)
    assert df.where(~F.sort_array(sets).eqNullSafe(F.sort_array(pairs))).count() == 0
    assert df.select(F.sum(F.size(sets))).first()[0] > 0


def test_spans_in_a_text_of_two_words(spark):
    """Time grows with the number of spans: pair by pair this takes minutes."""
    index = SearchIndex(spark.createDataFrame([(1, "the of " * 30_000)], "_id long, t string"), {"mappings": {"fields": {"t": {"type": "string", "analyzer": "lucene.simple"}}}})
    clauses = [{"term": {"path": "t", "query": w}} for w in ("the", "of")]
    start = time.monotonic()
    assert ids(index, {"span": {"near": {"clauses": clauses, "slop": 1, "inOrder": True}}}) == [1]
    assert time.monotonic() - start < 30

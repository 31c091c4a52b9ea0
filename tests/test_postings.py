"""Written indexes: hits from postings give what token arrays give, and read less."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.plans import index as plans
from fathom.plans import query as q
from fathom.plans.index import SearchIndex

DEFINITION = {"mappings": {"fields": {
    "title": [{"type": "string", "analyzer": "lucene.simple", "multi": {"stem": {"type": "string", "analyzer": "lucene.english"}}}, {"type": "autocomplete", "analyzer": "lucene.simple"}],
    "tags": {"type": "string", "analyzer": "lucene.keyword"}, "n": {"type": "number"}}}}
QUERIES = [
    {"text": {"path": "title", "query": "alder birch"}},
    {"text": {"path": ["title", "tags"], "query": "cedar x1"}},
    {"text": {"path": {"value": "title", "multi": "stem"}, "query": "walking"}},
    {"text": {"path": "title", "query": "bitch", "fuzzy": {"maxEdits": 1}}},
    {"text": {"path": "title", "query": "nothinglikeit"}},
    {"phrase": {"path": "title", "query": "birch alder", "slop": 2}},
    {"autocomplete": {"path": "title", "query": "ced"}},
    {"span": {"near": {"clauses": [{"term": {"path": "title", "query": "alder"}}, {"term": {"path": "title", "query": "oak"}}], "slop": 3}}},
    {"compound": {"should": [{"text": {"path": "title", "query": "oak"}}, {"range": {"path": "n", "lt": 10}}], "mustNot": [{"text": {"path": "title", "query": "elm"}}]}},
    {"compound": {"mustNot": [{"text": {"path": "title", "query": "oak"}}]}},
    {"compound": {"must": [{"text": {"path": "title", "query": "oak"}}], "filter": [{"range": {"path": "n", "gte": 100}}]}},
]


@pytest.fixture(scope="module")
def indexes(spark, tmp_path_factory):
    rng = random.Random(4)
    words = "alder birch cedar elm oak walking walked walks".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 12))) if k % 17 else None, [f"x{k % 5}", "y"] if k % 3 else None, k) for k in range(300)]
    plain = SearchIndex(spark.createDataFrame(rows, "_id long, title string, tags array<string>, n int"), DEFINITION)
    return plain, plain.write(f"file://{tmp_path_factory.mktemp('index')}/i")


def found(index, query, limit):
    return [(r["_id"], round(r["__score"], 9)) for r in q.search(index, query | {"limit": limit}).collect()]


@pytest.mark.parametrize("bound", [64 << 20, 0])
@pytest.mark.parametrize("query", QUERIES)
def test_postings_give_what_arrays_give(indexes, monkeypatch, query, bound):
    plain, written = indexes
    monkeypatch.setattr(plans, "BROADCAST_HITS", bound)
    assert written.postings is not None and plain.postings is None
    for limit in (7, None):
        assert found(written, query, limit) == found(plain, query, limit)
    assert q.count(written, query | {"count": {"type": "total"}}).first() == q.count(plain, query | {"count": {"type": "total"}}).first()


def test_what_is_read(indexes):
    _, written = indexes
    df = q.search(written, QUERIES[10] | {"limit": 5})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "__tok_title__lucene_simple:array" not in plan and "BroadcastHashJoin" in plan and "Inner" in plan  # documents without a hit are no candidates
    assert "In(term" in plan or "EqualTo(term" in plan
    assert q.search(written, {"exists": {"path": "n"}})._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    terms = {(r["field"], r["term"]): (r["df"], r["n"]) for r in written.terms.where("field LIKE '%lucene_simple'").collect() if "autocomplete" not in r["field"]}
    tokens = written.docs.select(F.explode("__tok_title__lucene_simple").alias("t"), "_id")
    want = {r["term"]: (r["d"], r["n"]) for r in tokens.groupBy("t.term").agg(F.count_distinct("_id").alias("d"), F.count("*").alias("n")).collect()}
    assert {t: x for (f, t), x in terms.items() if f == "__tok_title__lucene_simple"} == want


def test_an_index_without_rows(spark, tmp_path):
    written = SearchIndex(spark.createDataFrame([], "_id long, title string, tags array<string>, n int"), DEFINITION).write(f"file://{tmp_path}/i")
    assert found(written, QUERIES[0], 5) == [] and found(written, QUERIES[5], None) == []


def test_frequent_terms_are_scanned(indexes, monkeypatch):
    _, written = indexes
    monkeypatch.setattr(plans, "BROADCAST_HITS", 0)
    plan = q.search(written, QUERIES[0] | {"limit": 5})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # a top-k over one scan


def test_blocks_hold_every_place(indexes, monkeypatch):
    _, written = indexes
    name = "__tok_title__lucene_simple"
    want = sorted((r["__docrow"], r["term"], r["pos"]) for r in written.docs.select("__docrow", F.inline(name)).collect())
    blocks = written.postings.where(F.col("field") == name).select("term", "base", F.inline(F.arrays_zip("rows", "places")))
    assert sorted((r["base"] + r["rows"], r["term"], r["places"]) for r in blocks.collect()) == want
    monkeypatch.setattr(plans, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(plans, "BLOCK_ROWS", 40)
    made = list(plans._blocks(written.docs.select("__docrow", name).toArrow().combine_chunks().to_batches()))
    rows = [r for b in made for r in b.to_pylist()]
    assert len(made) > 7 and sum(r["n"] for r in rows) == len(want)
    assert sorted((r["base"] + d, r["term"], p) for r in rows for d, p in zip(r["rows"], r["places"], strict=True)) == want
    assert all(r["df"] == len(set(r["rows"])) and r["n"] == len(r["rows"]) for r in rows)


def test_postings_of_all_analyzers(indexes):
    _, written = indexes
    for name in [c for c in written.docs.columns if c.startswith("__tok_")]:
        want = sorted((r["__docrow"], r["term"], r["pos"]) for r in written.docs.select("__docrow", F.inline(name)).collect())
        blocks = written.postings.where(F.col("field") == name).select("term", "base", F.inline(F.arrays_zip("rows", "places")))
        assert sorted((r["base"] + r["rows"], r["term"], r["places"]) for r in blocks.collect()) == want and want


def test_terms_keep_places_that_are_not_counted(spark, tmp_path):
    """Places come from a count only where no filter leaves terms out."""
    fields = {"a": {"type": "string", "analyzer": "lucene.stop"}, "b": {"type": "string", "analyzer": "lucene.simple"}, "c": {"type": "string", "analyzer": "lucene.simple"}}
    df = spark.createDataFrame([(1, "the oak and Elm", "Oak elm oak", ["oak", None, "Elm oak"]), (2, None, "", [])], "_id long, a string, b string, c array<string>")
    made = SearchIndex(df, {"mappings": {"fields": fields}}).write(f"file://{tmp_path}/i")
    at = lambda c: sorted((r["term"], r["places"]) for r in made.postings.where(F.col("field") == f"__tok_{c}").select("term", F.inline(F.arrays_zip("rows", "places"))).collect())
    assert at("a__lucene_stop") == [("elm", 3), ("oak", 1)]
    assert at("b__lucene_simple") == [("elm", 1), ("oak", 0), ("oak", 2)]
    assert at("c__lucene_simple") == [("elm", 200_000), ("oak", 0), ("oak", 200_001)]


def test_an_index_is_made_without_sampling(spark, tmp_path, monkeypatch):
    """Terms are written as their counts deal them out, and words get their places in compiled code."""
    from pyspark.sql import DataFrame

    df = spark.createDataFrame([(1, "oak elm")], "_id long, a string")
    index = SearchIndex(df, {"mappings": {"fields": {"a": {"type": "string", "analyzer": "lucene.simple"}}}})
    assert "arrays_zip" in index.materialized().docs._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *a: pytest.fail("a range partition reads its rows twice"), raising=False)
    monkeypatch.setattr(type(df), "repartitionByRange", lambda *a: pytest.fail("a range partition reads its rows twice"))
    assert index.write(f"file://{tmp_path}/i").terms.count() == 2

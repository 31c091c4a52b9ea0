"""Queries of the engine's own operators over the test tables, and the SQL that each is held against.

Each query is a search as a user would write it; the SQL computes the same from the tables without the engine.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.vector import filter_column
from fathom.plans import query as q
from fathom.plans.compiler import Compiler, Scope
from fathom.plans.definition import IndexDefinition
from fathom.plans.index import SearchIndex
from fathom.sources.storage import opened
from fathom.streaming.cdc import last_events

DOCUMENTS = {"mappings": {"dynamic": False, "fields": {
    "text": {"type": "string", "analyzer": "lucene.simple"}, "lang": [{"type": "token"}, {"type": "stringFacet"}],
    "source": [{"type": "token"}, {"type": "stringFacet"}], "n_chars": [{"type": "number"}, {"type": "numberFacet"}],
}}, "synonyms": [{"name": "words", "source": {"collection": "words"}, "analyzer": "lucene.simple"}]}
PARTS = {"mappings": {"fields": {
    "p_name": [{"type": "string", "analyzer": "lucene.simple", "multi": {"whole": {"type": "string", "analyzer": "lucene.keyword"}}}, {"type": "autocomplete", "analyzer": "lucene.simple"}],
    "p_brand": [{"type": "token"}, {"type": "stringFacet"}], "p_type": [{"type": "token"}, {"type": "stringFacet"}], "p_size": [{"type": "number"}], "p_retailprice": [{"type": "number"}],
}}}
ORDERS = {"mappings": {"fields": {
    "o_orderstatus": [{"type": "token"}, {"type": "stringFacet"}], "o_orderpriority": [{"type": "token"}, {"type": "stringFacet"}], "o_totalprice": [{"type": "number"}, {"type": "numberFacet"}],
    "o_orderdate": [{"type": "date"}, {"type": "dateFacet"}], "o_custkey": {"type": "number"}, "o_orderkey": {"type": "number"},
    "items": {"type": "embeddedDocuments", "fields": {"l_quantity": {"type": "number"}, "l_returnflag": {"type": "token"}, "l_discount": {"type": "number"}}},
}}, "storedSource": True}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str, definition: dict = DOCUMENTS) -> SearchIndex:
    rows = spark.createDataFrame([("equivalent", ["that", "this"], None), ("explicit", ["with", "and"], ["with"])], "mappingType string, synonyms array<string>, input array<string>")
    index = opened(spark, "documents", [f"{sf_dir}/documents.parquet"], lambda: SearchIndex(read(spark, sf_dir, "documents"), DOCUMENTS, "doc_id"))
    return SearchIndex.open(spark, index.path, definition, "doc_id", synonyms={"words": rows})


def parts(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return opened(spark, "parts", [f"{sf_dir}/part.parquet"], lambda: SearchIndex(read(spark, sf_dir, "part"), PARTS, "p_partkey"))


def orders(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return SearchIndex(read(spark, sf_dir, "orders"), ORDERS, "o_orderkey")


def nested_orders(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """Orders with their lines embedded: the join is done once, when the index is written."""

    def made() -> SearchIndex:
        items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_discount"))).alias("items"))
        return SearchIndex(read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey"), ORDERS, "o_orderkey")

    return opened(spark, "nested-orders", [f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet"], made)


def hits(index: SearchIndex, query: dict, *columns: str, limit: int | None = None, score: bool = True) -> DataFrame:
    """Ids, other columns and the rounded score. Without a limit all matches, in order where a sort is given: these queries are held against SQL as a whole."""
    found = q.search(index, query | {"limit": limit}, in_order="sort" in query)
    out = found.select(index.id_col, *columns, *([F.round("__score", 6).alias("score")] if score else []))
    return out


# SQL helpers

TOK = "tok AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\p{L}+'), lambda x: lower(x)) AS t FROM documents)"
NAMES = "tok AS (SELECT p_partkey AS doc_id, list_transform(regexp_extract_all(p_name, '\\p{L}+'), lambda x: lower(x)) AS t FROM part)"


def tf(term: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{term}'))"


def stats(terms: list[str]) -> str:
    dfs = ", ".join(f"count(*) FILTER (list_contains(t, '{w}')) AS d{k}" for k, w in enumerate(terms))
    return f"st AS (SELECT count(*) FILTER (len(t) > 0) AS n, avg(len(t)) FILTER (len(t) > 0) AS mean, {dfs} FROM tok)"


def idf(k: int) -> str:
    return f"ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5))"


def bm25(k: int, freq: str) -> str:
    return f"({idf(k)} * {freq} / ({freq} + 1.2 * (0.25 + 0.75 * len(t) / mean)))"


def text_sql(terms: list[str], every: bool = False, tail: str = "", tok: str = TOK, ident: str = "doc_id", score: str | None = None) -> str:
    joined = (" AND " if every else " OR ").join(f"{tf(w)} > 0" for w in terms)
    total = score or " + ".join(bm25(k, tf(w)) for k, w in enumerate(terms))
    return f"WITH {tok}, {stats(terms)} SELECT doc_id AS {ident}, round({total}, 6) AS score FROM tok, st WHERE {joined} {tail}"


DAY = dt.datetime(1996, 1, 1)
PRICE = "(o_totalprice > 100000)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def by(index: Callable, op: dict, *columns: str, name: str, sql: str | None = None, limit: int | None = None, score: bool = True, **options) -> None:
    """Registers a search by name."""
    QUERIES[name] = lambda s, d: hits(index(s, d), op | options, *columns, limit=limit, score=score)
    if sql:
        ORACLE_SQL[name] = sql


# Analysed text

by(documents, {"text": {"path": "text", "query": "with thing that"}}, name="text_bm25_top10", limit=10, sql=text_sql(["with", "thing", "that"], tail="ORDER BY score DESC, doc_id LIMIT 10"))
by(documents, {"text": {"path": "text", "query": "de la para", "matchCriteria": "all"}}, name="text_all", sql=text_sql(["de", "la", "para"], True))
by(documents, {"text": {"path": {"wildcard": "te*"}, "query": ["with", "para"]}}, name="text_wildcard_path", sql=text_sql(["with", "para"]))
by(
    documents, {"phrase": {"path": "text", "query": "of the"}}, name="phrase_slop0",
    sql=f"WITH {TOK}, {stats(['of', 'the'])}, f AS (SELECT doc_id, t, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i+1] = 'the')) AS f FROM tok) "
    f"SELECT doc_id, round(({idf(0)} + {idf(1)}) * f / (f + 1.2 * (0.25 + 0.75 * len(t) / mean)), 6) AS score FROM f, st WHERE f > 0",
)
by(
    documents, {"phrase": {"path": "text", "query": "with the", "slop": 2}}, name="phrase_slop2", score=False,
    sql=f"WITH {TOK} SELECT doc_id FROM tok WHERE len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'with' AND len(list_filter(range(-1, 4), lambda k: i + k >= 1 AND t[i+k] = 'the')) > 0)) > 0",
)
by(documents, {"text": {"path": "text", "query": "that", "synonyms": "words"}}, name="text_synonyms", sql=f"WITH {TOK}, {stats(['that', 'this'])}, s AS (SELECT doc_id, {bm25(0, tf('that'))} AS a, {bm25(1, tf('this'))} AS b FROM tok, st) SELECT doc_id, round(greatest(a, b) + 0.1 * least(a, b) + 2 * a, 6) AS score FROM s WHERE a > 0 OR b > 0")
by(documents, {"phrase": {"path": "text", "query": "with the", "synonyms": "words"}}, name="phrase_synonyms", score=False, sql=f"WITH {TOK} SELECT doc_id FROM tok WHERE len(list_filter(range(1, len(t)), lambda i: t[i] IN ('with', 'and') AND t[i+1] = 'the')) > 0")
by(parts, {"text": {"path": "p_name", "query": "widgte", "fuzzy": {"maxEdits": 1}}}, name="text_fuzzy", score=False, sql=f"WITH {NAMES} SELECT doc_id AS p_partkey FROM tok WHERE len(list_filter(t, lambda x: damerau_levenshtein(x, 'widgte') <= 1)) > 0")
by(parts, {"text": {"path": "p_name", "query": "colt anvil", "matchCriteria": "all", "fuzzy": {"maxEdits": 1, "prefixLength": 2, "maxExpansions": 10}}}, name="text_fuzzy_all_prefix", score=False, sql=f"WITH {NAMES} SELECT doc_id AS p_partkey FROM tok WHERE len(list_filter(t, lambda x: damerau_levenshtein(x, 'colt') <= 1 AND x[1:2] = 'co')) > 0 AND len(list_filter(t, lambda x: damerau_levenshtein(x, 'anvil') <= 1 AND x[1:2] = 'an')) > 0")
by(parts, {"autocomplete": {"path": "p_name", "query": "wid"}}, name="autocomplete_prefix", score=False, sql="SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '(^| )wid')")
by(parts, {"autocomplete": {"path": "p_name", "query": "red an", "tokenOrder": "sequential"}}, name="autocomplete_sequential", score=False, sql="SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '(^| )red an')")
by(parts, {"autocomplete": {"path": "p_name", "query": "wibg", "fuzzy": {"maxEdits": 1, "prefixLength": 2}}}, name="autocomplete_fuzzy", score=False, sql=f"WITH {NAMES}, g AS (SELECT doc_id, unnest(list_concat(t, [t[1] || ' ' || t[2]])) AS w FROM tok), p AS (SELECT doc_id, unnest(list_transform(range(2, 16), lambda n: w[1:n])) AS g FROM g) SELECT DISTINCT doc_id AS p_partkey FROM p WHERE g[1:2] = 'wi' AND damerau_levenshtein(g, 'wibg') <= 1")
by(parts, {"wildcard": {"path": {"value": "p_name", "multi": "whole"}, "query": "re* ?idget"}}, name="wildcard", sql="SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE p_name SIMILAR TO 're.* .idget'")
by(parts, {"regex": {"path": "p_name", "query": "(bolt|gear)s?", "allowAnalyzedField": True}}, name="regex", sql=f"WITH {NAMES} SELECT doc_id AS p_partkey, 1.0::DOUBLE AS score FROM tok WHERE len(list_filter(t, lambda x: regexp_full_match(x, '(bolt|gear)s?'))) > 0")
by(parts, {"term": {"path": "p_name", "query": "red"}}, name="term_exact", sql=text_sql(["red"], tok=NAMES, ident="p_partkey"))
by(parts, {"term": {"path": "p_name", "query": "wi", "prefix": True}}, name="term_prefix", sql=f"WITH {NAMES} SELECT doc_id AS p_partkey, 1.0::DOUBLE AS score FROM tok WHERE len(list_filter(t, lambda x: starts_with(x, 'wi'))) > 0")
by(parts, {"term": {"path": "p_name", "query": "w.*t", "regex": True}}, name="term_regex", sql=f"WITH {NAMES} SELECT doc_id AS p_partkey, 1.0::DOUBLE AS score FROM tok WHERE len(list_filter(t, lambda x: regexp_full_match(x, 'w.*t'))) > 0")
by(parts, {"term": {"path": "p_name", "query": "?ed", "wildcard": True}}, name="term_wildcard", sql=f"WITH {NAMES} SELECT doc_id AS p_partkey, 1.0::DOUBLE AS score FROM tok WHERE len(list_filter(t, lambda x: regexp_full_match(x, '.ed'))) > 0")
by(parts, {"term": {"path": "p_name", "query": "rde", "fuzzy": {"maxEdits": 1}}}, name="term_fuzzy", score=False, sql=f"WITH {NAMES} SELECT doc_id AS p_partkey FROM tok WHERE len(list_filter(t, lambda x: damerau_levenshtein(x, 'rde') <= 1)) > 0")
by(parts, {"search": {"path": "p_name", "query": "red widget"}}, name="search_legacy", sql=text_sql(["red", "widget"], tok=NAMES, ident="p_partkey"))
by(parts, {"search": {"path": "p_name", "query": "red wid", "phrase": {"prefix": True}}}, name="search_phrase_prefix", score=False, sql="SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '(^| )red wid')")
by(parts, {"queryString": {"defaultPath": "p_name", "query": 'red AND (widget OR anvil) NOT p_size:[10 TO 20]'}}, name="query_string", score=False, sql="SELECT p_partkey FROM part WHERE p_name LIKE '%red%' AND (p_name LIKE '%widget%' OR p_name LIKE '%anvil%') AND NOT p_size BETWEEN 10 AND 20")
by(documents, {"moreLikeThis": {"like": {"text": "thing thing paraguas"}}}, name="more_like_this", sql=text_sql(["thing"]))
by(documents, {"span": {"near": {"clauses": [{"term": {"path": "text", "query": "the"}}, {"term": {"path": "text", "query": "of"}}], "slop": 1, "inOrder": True}}}, name="span_near", score=False, sql=f"WITH {TOK} SELECT doc_id FROM tok WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND (t[i+1] = 'of' OR t[i+2] = 'of'))) > 0")
by(documents, {"span": {"near": {"clauses": [{"term": {"path": "text", "query": "la"}}, {"term": {"path": "text", "query": "de"}}], "slop": 0}}}, name="span_near_unordered", score=False, sql=f"WITH {TOK} SELECT doc_id FROM tok WHERE len(list_filter(range(1, len(t)), lambda i: (t[i] = 'la' AND t[i+1] = 'de') OR (t[i] = 'de' AND t[i+1] = 'la'))) > 0")
by(documents, {"span": {"first": {"operator": {"term": {"path": "text", "query": ["the", "la"]}}, "endPositionLte": 5}}}, name="span_first", score=False, sql=f"WITH {TOK} SELECT doc_id FROM tok WHERE len(list_filter(t[1:5], lambda x: x IN ('the', 'la'))) > 0")
by(documents, {"span": {"or": {"clauses": [{"term": {"path": "text", "query": "und"}}, {"term": {"path": "text", "query": "para"}}]}}}, name="span_or", score=False, sql=f"WITH {TOK} SELECT doc_id FROM tok WHERE list_contains(t, 'und') OR list_contains(t, 'para')")
by(
    documents, {"span": {"contains": {"spanToReturn": "outer", "little": {"term": {"path": "text", "query": "of"}}, "big": {"near": {"inOrder": True, "slop": 2, "clauses": [{"term": {"path": "text", "query": "the"}}, {"term": {"path": "text", "query": "a"}}]}}}}},
    name="span_contains", score=False,
    sql=f"WITH {TOK} SELECT doc_id FROM tok WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND ((t[i+2] = 'a' AND t[i+1] = 'of') OR (t[i+3] = 'a' AND (t[i+1] = 'of' OR t[i+2] = 'of'))))) > 0",
)
by(
    documents, {"span": {"subtract": {"include": {"term": {"path": "text", "query": "the"}}, "exclude": {"near": {"inOrder": True, "clauses": [{"term": {"path": "text", "query": "of"}}, {"term": {"path": "text", "query": "the"}}]}}}}},
    name="span_subtract", score=False,
    sql=f"WITH {TOK} SELECT doc_id FROM tok WHERE len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'the' AND (i = 1 OR t[i-1] <> 'of'))) > 0",
)

# Predicates

by(orders, {"equals": {"path": "o_orderstatus", "value": "F"}}, name="equals_string", sql="SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_orderstatus = 'F'")
by(orders, {"equals": {"path": "o_custkey", "value": 7}}, name="equals_number", sql="SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_custkey = 7")
by(orders, {"equals": {"path": "o_orderdate", "value": DAY}}, name="equals_date", sql="SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_orderdate = TIMESTAMP '1996-01-01'")
by(orders, {"equals": {"path": "o_totalprice", "value": None}}, name="equals_null", sql="SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_totalprice IS NULL")
by(orders, {"in": {"path": "o_orderpriority", "value": ["1-URGENT", "2-HIGH"]}}, name="in_string", sql="SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
by(orders, {"in": {"path": ["o_custkey", "o_orderkey"], "value": [3, 5, 8]}}, name="in_number_paths", sql="SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_custkey IN (3, 5, 8) OR o_orderkey IN (3, 5, 8)")
by(orders, {"range": {"path": "o_totalprice", "gte": 50000, "lt": 90000}}, name="range_number", sql="SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 90000")
by(orders, {"range": {"path": "o_orderdate", "gt": DAY}}, name="range_date", sql="SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01'")
by(parts, {"range": {"path": "p_brand", "gte": "Brand#2", "lt": "Brand#4"}}, name="range_string", sql="SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE p_brand >= 'Brand#2' AND p_brand < 'Brand#4'")
by(orders, {"exists": {"path": "o_totalprice"}}, name="exists", sql="SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_totalprice IS NOT NULL")
by(orders, {"near": {"path": "o_totalprice", "origin": 100000, "pivot": 5000}}, name="near_number", limit=20, sql="SELECT o_orderkey, round(5000 / (5000 + abs(o_totalprice - 100000)), 6) AS score FROM orders ORDER BY 5000 / (5000 + abs(o_totalprice - 100000)) DESC, o_orderkey LIMIT 20")
by(orders, {"near": {"path": "o_orderdate", "origin": DAY, "pivot": 86400000}}, name="near_date", sql="SELECT o_orderkey, round(86400000 / (86400000 + abs(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1996-01-01'))), 6) AS score FROM orders")

# Boolean composition and scores

by(
    orders, {"compound": {"must": [{"range": {"path": "o_totalprice", "gt": 20000}}], "mustNot": [{"equals": {"path": "o_orderstatus", "value": "O"}}], "filter": [{"exists": {"path": "o_orderdate"}}], "minimumShouldMatch": 1,
        "should": [{"equals": {"path": "o_orderpriority", "value": "1-URGENT", "score": {"constant": {"value": 3}}}}, {"range": {"path": "o_totalprice", "gte": 100000, "score": {"boost": {"value": 2}}}}]}},
    name="compound_min_should",
    sql=f"SELECT o_orderkey, (1.0 + CASE WHEN o_orderpriority = '1-URGENT' THEN 3.0 ELSE 0 END + CASE WHEN o_totalprice >= 100000 THEN 2.0 ELSE 0 END)::DOUBLE AS score FROM orders WHERE o_totalprice > 20000 AND o_orderstatus <> 'O' AND o_orderdate IS NOT NULL AND (o_orderpriority = '1-URGENT' OR o_totalprice >= 100000) AND {PRICE} IS NOT NULL",
)
by(orders, {"compound": {"mustNot": [{"equals": {"path": "o_orderstatus", "value": "O"}}]}}, name="compound_must_not_only", sql="SELECT o_orderkey, 0.0::DOUBLE AS score FROM orders WHERE o_orderstatus <> 'O'")
by(
    parts, {"compound": {"should": [{"term": {"path": "p_name", "query": "red"}}, {"term": {"path": "p_name", "query": "widget"}}], "score": {"dismax": {"tieBreakerScore": 0.25}}}}, name="compound_dismax",
    sql=f"WITH {NAMES}, {stats(['red', 'widget'])}, s AS (SELECT doc_id, {bm25(0, tf('red'))} AS a, {bm25(1, tf('widget'))} AS b FROM tok, st) SELECT doc_id AS p_partkey, round(greatest(a, b) + 0.25 * least(a, b), 6) AS score FROM s WHERE a > 0 OR b > 0",
)
by(parts, {"term": {"path": "p_name", "query": "red", "score": {"boost": {"path": "p_size"}}}}, name="score_boost_path", sql=text_sql(["red"], tok="tok AS (SELECT p_partkey AS doc_id, p_size, list_transform(regexp_extract_all(p_name, '\\p{L}+'), lambda x: lower(x)) AS t FROM part)", ident="p_partkey", score=bm25(0, tf("red")) + " * p_size"))
by(
    orders, {"exists": {"path": "o_totalprice", "score": {"function": {"add": [{"gauss": {"path": "o_totalprice", "origin": 100000, "scale": 20000, "offset": 5000, "decay": 0.3}}, {"multiply": [{"constant": 2}, {"log1p": {"path": {"value": "o_totalprice", "undefined": 1}}}]}, {"score": "relevance"}]}}}}, name="score_function",
    sql="SELECT o_orderkey, round(exp(power(greatest(0, abs(o_totalprice - 100000) - 5000), 2) / (20000.0 * 20000.0 / ln(0.3))) + 2 * log10(1 + o_totalprice) + 1, 6) AS score FROM orders",
)


def _similar(kind: str) -> Callable:
    return lambda s, d: documents(s, d, {"mappings": {"fields": {"text": {"type": "string", "analyzer": "lucene.simple", "similarity": {"type": kind}}}}})


by(_similar("boolean"), {"text": {"path": "text", "query": "with para"}}, name="similarity_boolean", sql=f"WITH {TOK} SELECT doc_id, (list_contains(t, 'with')::INT + list_contains(t, 'para')::INT)::DOUBLE AS score FROM tok WHERE list_contains(t, 'with') OR list_contains(t, 'para')")
by(_similar("stableTfl"), {"text": {"path": "text", "query": "thing"}}, name="similarity_stable_tfl", sql=f"WITH {TOK}, p AS (SELECT doc_id, {tf('thing')} AS f, 1 - power(1 - 0.00781 * power(2, -0.917 * 5), len(t)) AS p FROM tok) SELECT doc_id, round(ln(1 + (1 - p + 0.05) / (p + 0.05)) * f / (f + 1.2), 6) AS score FROM p WHERE f > 0")

# Counts, facets


@query("SELECT count(*) AS total FROM orders WHERE o_totalprice > 100000")
def count_total(spark, sf_dir):
    return q.count(orders(spark, sf_dir), {"range": {"path": "o_totalprice", "gt": 100000}, "count": {"type": "total"}})


@query("SELECT least(count(*), 101) AS \"lowerBound\" FROM orders WHERE o_totalprice > 1000")
def count_lower_bound(spark, sf_dir):
    return q.count(orders(spark, sf_dir), {"range": {"path": "o_totalprice", "gt": 1000}, "count": {"threshold": 100}})


FACETS = {"status": {"type": "string", "path": "o_orderstatus", "numBuckets": 2}, "price": {"type": "number", "path": "o_totalprice", "boundaries": [0, 50000, 100000, 200000], "default": "other"}, "date": {"type": "date", "path": "o_orderdate", "boundaries": [dt.datetime(1992, 1, 1), dt.datetime(1995, 1, 1), dt.datetime(1998, 1, 1)]}}
BUCKETS = "(VALUES (0, '0.0', 0, 50000), (1, '50000.0', 50000, 100000), (2, '100000.0', 100000, 200000)) b(rank, label, lo, hi)"
DATES = "(VALUES (0, '1992-01-01T00:00:00', TIMESTAMP '1992-01-01', TIMESTAMP '1995-01-01'), (1, '1995-01-01T00:00:00', TIMESTAMP '1995-01-01', TIMESTAMP '1998-01-01')) b(rank, label, lo, hi)"


@query(f"""
WITH s AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, label LIMIT 2)
SELECT 'status' AS facet, label, n AS count, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INT) AS rank FROM s
UNION ALL SELECT 'price', label, (SELECT count(*) FROM orders WHERE o_totalprice >= lo AND o_totalprice < hi), rank FROM {BUCKETS}
UNION ALL SELECT 'price', 'other', count(*), 4 FROM orders WHERE NOT coalesce(o_totalprice >= 0 AND o_totalprice < 200000, false)
UNION ALL SELECT 'date', label, (SELECT count(*) FROM orders WHERE o_orderdate >= lo AND o_orderdate < hi), rank FROM {DATES}
""")
def facets_all(spark, sf_dir):
    return q.search_meta(orders(spark, sf_dir), {"facet": {"facets": FACETS}})


SIDEWAYS = {"compound": {"filter": [{"equals": {"path": "o_orderstatus", "value": "F", "doesNotAffect": "status"}}, {"range": {"path": "o_totalprice", "gte": 100000, "doesNotAffect": ["price"]}}]}}


@query(f"""
WITH s AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders WHERE o_totalprice >= 100000 GROUP BY 1 ORDER BY n DESC, label LIMIT 2),
p AS (SELECT label, (SELECT count(*) FROM orders WHERE o_totalprice >= lo AND o_totalprice < hi AND o_orderstatus = 'F') AS n, rank FROM {BUCKETS}
  UNION ALL SELECT 'other', count(*), 4 FROM orders WHERE o_orderstatus = 'F' AND NOT coalesce(o_totalprice >= 0 AND o_totalprice < 200000, false))
SELECT 'status' AS facet, label, n AS count, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INT) AS rank FROM s
UNION ALL SELECT 'price', label, n, rank FROM p WHERE n > 0
""")
def facets_drill_sideways(spark, sf_dir):
    return q.search_meta(orders(spark, sf_dir), {"facet": {"operator": SIDEWAYS, "facets": {k: FACETS[k] for k in ("status", "price")}}})


# Sort and paging

by(orders, {"exists": {"path": "o_orderkey"}}, "o_totalprice", name="sort_top", limit=15, score=False, sort={"o_orderpriority": 1, "o_totalprice": -1}, sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 15")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS LAST, doc_id DESC LIMIT 400")
def sort_no_data_highest(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    index = SearchIndex(df, {"mappings": {"fields": {"doc_id": {"type": "number"}, "quality": {"type": "number"}}}}, "doc_id")
    return q.search(index, {"exists": {"path": "doc_id"}, "sort": {"quality": {"order": 1, "noData": "highest"}, "doc_id": -1}, "limit": 400}).select("doc_id", "quality")


def _page(spark, sf_dir, way: str):
    index, sort = orders(spark, sf_dir), {"o_orderdate": -1, "o_totalprice": 1}
    first = q.search(index, {"exists": {"path": "o_orderkey"}, "sort": sort, "limit": 20}).select("__token").collect()
    return q.search(index, {"exists": {"path": "o_orderkey"}, "sort": sort, "limit": 10, way: first[14 if way == "searchBefore" else 19]["__token"]}).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_totalprice, o_orderkey LIMIT 10 OFFSET 20")
def search_after_page(spark, sf_dir):
    return _page(spark, sf_dir, "searchAfter")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_totalprice, o_orderkey LIMIT 10 OFFSET 4")
def search_before_page(spark, sf_dir):
    return _page(spark, sf_dir, "searchBefore")


# Vectors and their filters

VECTORS = [{"type": "vector", "path": "embedding", "numDimensions": 64, "similarity": "cosine"}, {"type": "filter", "path": "label"}]
QUERY = [((k * 37) % 17 - 8) / 8 for k in range(64)]
SQL_QUERY = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
SQL_EMBEDDING = "CAST(embedding AS DOUBLE[])"


def _vectors(similarity: str, quantization: str = "none") -> Callable:
    return lambda s, d: SearchIndex(read(s, d, "embeddings"), IndexDefinition.vector([VECTORS[0] | {"similarity": similarity, "quantization": quantization}, VECTORS[1]]), "vec_id")


def vector_by(name: str, index: Callable, body: dict, sql: str | None = None) -> None:
    QUERIES[name] = lambda s, d: q.vector(index(s, d), {"path": "embedding", "queryVector": QUERY} | body).select("vec_id", F.round("__score", 6).alias("score"))
    if sql:
        ORACLE_SQL[name] = sql


FORMULAS = {"cosine": f"(1 + list_cosine_similarity({SQL_EMBEDDING}, {SQL_QUERY})) / 2", "dotProduct": f"(1 + list_inner_product({SQL_EMBEDDING}, {SQL_QUERY})) / 2", "euclidean": f"1 / (1 + power(list_distance({SQL_EMBEDDING}, {SQL_QUERY}), 2))"}
for _kind, _sql in FORMULAS.items():
    vector_by(f"vector_exact_{_kind.lower()}", _vectors(_kind), {"exact": True, "limit": 25}, f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_sql} AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 25")
vector_by("vector_filtered", _vectors("cosine"), {"exact": True, "limit": 10, "filter": {"label": {"$in": [1, 3]}}}, f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {FORMULAS['cosine']} AS s FROM embeddings WHERE label IN (1, 3)) ORDER BY s DESC, vec_id LIMIT 10")
vector_by("vector_approximate", _vectors("cosine"), {"numCandidates": 100, "limit": 10}, f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {FORMULAS['cosine']} AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10")
_SIGNS = "[" + ", ".join("1" if x > 0 else "0" for x in QUERY) + "]"
vector_by(
    "vector_binary_rescore", _vectors("cosine", "binary"), {"numCandidates": 200, "limit": 10},
    f"""WITH h AS (SELECT vec_id, embedding, list_sum(list_transform(range(1, 65), lambda k: CASE WHEN (embedding[k] > 0) <> ({_SIGNS}[k] = 1) THEN 1 ELSE 0 END)) AS d FROM embeddings ORDER BY d, vec_id LIMIT 200),
a AS (SELECT vec_id, embedding, list_sum(list_transform(range(1, 65), lambda k: CASE WHEN embedding[k] > 0 THEN {SQL_QUERY}[k] ELSE -{SQL_QUERY}[k] END)) AS s FROM h ORDER BY s DESC, vec_id LIMIT 44)
SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {FORMULAS['cosine']} AS s FROM a) ORDER BY s DESC, vec_id LIMIT 10""",
)


def _labelled(spark, sf_dir) -> SearchIndex:
    df = read(spark, sf_dir, "documents").select("doc_id", "lang", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.sin(F.col("doc_id") * k)).alias("v")).join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return SearchIndex(df, IndexDefinition.vector([{"type": "vector", "path": "v", "numDimensions": 4, "similarity": "dotProduct"}, *[{"type": "filter", "path": p} for p in ("quality", "toxic", "lang")]]), "doc_id")


def filtered(index: SearchIndex, clause: dict) -> DataFrame:
    """All documents that a filter of vector search lets through, however many."""
    c = Compiler(index)
    return c.docs().where(filter_column(c, Scope(), clause))


def mql_by(name: str, clause: dict, where: str) -> None:
    QUERIES[name] = lambda s, d: filtered(_labelled(s, d), clause).select("doc_id")
    ORACLE_SQL[name] = f"SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE {where}"


mql_by("mql_ne_missing", {"quality": {"$ne": 1}}, "NOT coalesce(quality = 1, false)")
mql_by("mql_nin_not", {"$and": [{"toxic": {"$nin": [1]}}, {"quality": {"$not": {"$gte": 1}}}, {"lang": {"$in": ["en", "fr"]}}]}, "NOT coalesce(toxic IN (1), false) AND NOT coalesce(quality >= 1, false) AND lang IN ('en', 'fr')")
mql_by("mql_nor_exists", {"$nor": [{"lang": "en"}, {"quality": {"$exists": False}}]}, "NOT (lang = 'en' OR quality IS NULL)")
mql_by("mql_or_range", {"$or": [{"lang": {"$gt": "en", "$lte": "es"}}, {"toxic": 1}]}, "(lang > 'en' AND lang <= 'es') OR coalesce(toxic = 1, false)")

# Embedded documents

CHILD = {"compound": {"must": [{"equals": {"path": "items.l_returnflag", "value": "R"}}, {"near": {"path": "items.l_quantity", "origin": 30, "pivot": 10}}]}}
CHILD_SQL = "SELECT l_orderkey, 1 + 10 / (10 + abs(l_quantity - 30)) AS s FROM lineitem WHERE l_returnflag = 'R'"
for _how, _agg in {"sum": "sum", "maximum": "max", "minimum": "min", "mean": "avg"}.items():
    by(nested_orders, {"embeddedDocument": {"path": "items", "operator": CHILD, "score": {"embedded": {"aggregate": _how}}}}, name=f"embedded_{_how}", sql=f"SELECT l_orderkey AS o_orderkey, round({_agg}(s), 6) AS score FROM ({CHILD_SQL}) JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")


@query("SELECT o_orderkey AS __root_id, l_linenumber, round(1 + 10 / (10 + abs(l_quantity - 30)), 6) AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F'")
def return_scope_has_root(spark, sf_dir):
    op = {"compound": {"must": [CHILD], "filter": [{"hasRoot": {"operator": {"equals": {"path": "o_orderstatus", "value": "F"}}}}]}}
    return q.search(nested_orders(spark, sf_dir), op | {"returnScope": {"path": "items"}, "returnStoredSource": True, "limit": None}).select("__root_id", "l_linenumber", F.round("__score", 6).alias("score"))


@query(f"SELECT o_orderkey, round(max(s), 6) AS score FROM (SELECT l_orderkey AS o_orderkey, 1 / (1 + power(l_quantity - 5, 2) + power(l_discount - 0.05, 2)) AS s FROM lineitem WHERE l_returnflag = 'R') JOIN orders USING (o_orderkey) WHERE {PRICE} GROUP BY o_orderkey ORDER BY max(s) DESC, o_orderkey LIMIT 20")
def vector_nested(spark, sf_dir):
    df = nested_orders(spark, sf_dir).docs.withColumn("items", F.transform("items", lambda e: F.struct(F.array(e["l_quantity"], e["l_discount"]).alias("v"), e["l_returnflag"].alias("flag"))))
    fields = [{"type": "vector", "path": "items.v", "numDimensions": 2, "similarity": "euclidean"}, {"type": "filter", "path": "items.flag"}, {"type": "filter", "path": "o_totalprice"}]
    index = SearchIndex(df, IndexDefinition.vector(fields, nested_root="items"), "o_orderkey")
    return q.vector(index, {"path": "items.v", "queryVector": [5, 0.05], "exact": True, "limit": 20, "filter": {"items.flag": "R"}, "parentFilter": {"o_totalprice": {"$gt": 100000}}}).select("o_orderkey", F.round("__score", 6).alias("score"))


# Streams and views


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def cdc_last_write_wins(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("seq", F.struct("ts", "event_id"))
    return last_events(events, "user_id").select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_orderstatus = 'F' AND o_totalprice * 2 >= 250000")
def view_pipeline(spark, sf_dir):
    view = [{"$match": {"o_orderstatus": "F"}}, {"$addFields": {"doubled": {"$multiply": ["$o_totalprice", 2]}}}]
    index = SearchIndex(read(spark, sf_dir, "orders"), {"mappings": {"fields": {"doubled": {"type": "number"}}}, "view": view}, "o_orderkey")
    return hits(index, {"range": {"path": "doubled", "gte": 250000}})


@query()
def highlight_passages(spark, sf_dir):
    found = q.search(documents(spark, sf_dir), {"text": {"path": "text", "query": "thing para"}, "highlight": {"path": "text", "maxNumPassages": 2}, "limit": 50})
    return found.select("doc_id", F.size("__highlights").alias("passages"), F.to_json("__highlights").alias("highlights"))


_PARTS = " + ".join(bm25(k, tf(w)) for k, w in enumerate(["with", "thing"]))


@query(f"WITH {TOK}, {stats(['with', 'thing'])} SELECT doc_id, round({_PARTS}, 6) AS score, CAST(({tf('with')} > 0)::INT + ({tf('thing')} > 0)::INT AS INT) AS parts FROM tok, st WHERE {tf('with')} > 0 OR {tf('thing')} > 0 ORDER BY {_PARTS} DESC, doc_id LIMIT 50")
def score_details(spark, sf_dir):
    return q.search(documents(spark, sf_dir), {"text": {"path": "text", "query": "with thing"}, "scoreDetails": True, "limit": 50}).select("doc_id", F.round("__details.value", 6).alias("score"), F.size("__details.details").alias("parts"))

"""More queries over the test tables: values of all types, shapes, arrays, vectors of all kinds, nesting, sources and sinks."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.vector import trace
from fathom.plans import query as q
from fathom.plans import sharded
from fathom.plans.catalog import IndexCatalog
from fathom.plans.definition import IndexDefinition
from fathom.plans.index import SearchIndex
from fathom.registry import FORMULAS, ORDERS, QUERY, VECTORS, by, filtered, hits, orders, parts, query, read, vector_by
from fathom.registry import ORACLE_SQL, QUERIES
from fathom.sources import tables
from fathom.sources.storage import work_dir
from fathom.streaming.cdc import IndexedTable, apply_stream, changes, follow_synonyms, relevant

# Orders with a value of each type

TYPED = {"mappings": {"fields": {
    "flag": {"type": "boolean"}, "oid": {"type": "objectId"}, "uid": {"type": "uuid"}, "spot": {"type": "geo", "indexShapes": True}, "square": {"type": "geo", "indexShapes": True},
    "prices": [{"type": "number"}, {"type": "numberFacet"}], "words": [{"type": "token"}, {"type": "stringFacet"}], "days": {"type": "date"}, "ratio": {"type": "number"}, "o_orderstatus": {"type": "token"},
    "o_totalprice": {"type": "number"},
}}, "storedSource": {"include": ["o_orderstatus", "o_totalprice"]}}
#: The same columns in SQL. md5 of a key serves as object id (24 hex digits) and UUID (32).
TYPES = """t AS (SELECT *, substr(h, 1, 24) AS oid, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS uid, [o_totalprice, o_totalprice / 2] AS prices,
 [o_orderstatus, substr(o_orderpriority, 3)] AS words, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice / 1000 END AS ratio
 FROM (SELECT *, o_totalprice > 100000 AS flag, md5(CAST(o_orderkey AS VARCHAR)) AS h, (o_custkey * 37 % 3600) / 10.0 - 180 AS lon, (o_orderkey * 53 % 1800) / 10.0 - 90 AS lat FROM orders))"""


def typed(spark: SparkSession, sf_dir: str) -> SearchIndex:
    h = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    lon, lat = (F.col("o_custkey") * 37 % 3600) / 10 - 180, (F.col("o_orderkey") * 53 % 1800) / 10 - 90
    point = F.struct(F.lit("Point").alias("type"), F.array(lon.cast("double"), lat.cast("double")).alias("coordinates"))
    corner = lambda dx, dy: F.concat(F.lit("["), (lon + dx).cast("double").cast("string"), F.lit(","), (lat + dy).cast("double").cast("string"), F.lit("]"))
    square = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", corner(0, 0), corner(20, 0), corner(20, 15), corner(0, 15), corner(0, 0)), F.lit("]]}"))
    df = read(spark, sf_dir, "orders").withColumns({
        "flag": F.col("o_totalprice") > 100000, "oid": F.substring(h, 1, 24),
        "uid": F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)),
        "spot": point, "square": square, "prices": F.array("o_totalprice", F.col("o_totalprice") / 2), "words": F.array("o_orderstatus", F.substring("o_orderpriority", 3, 100)),
        "days": F.array("o_orderdate", F.timestamp_add("DAY", F.lit(30), F.col("o_orderdate"))),
        "ratio": F.when(F.col("o_custkey") % 7 == 0, None).when(F.col("o_custkey") % 5 == 0, float("nan")).otherwise(F.col("o_totalprice") / 1000),
    })
    return SearchIndex(df, TYPED, "o_orderkey")


def typed_by(name: str, op: dict, where: str, score: str = "1.0::DOUBLE", **options) -> None:
    by(typed, op, name=name, sql=f"WITH {TYPES} SELECT o_orderkey, {score} AS score FROM t WHERE {where}", **options)


def md5(key: int) -> str:
    return hashlib.md5(str(key).encode()).hexdigest()


typed_by("equals_boolean", {"equals": {"path": "flag", "value": True}}, "flag")
typed_by("equals_boolean_false", {"equals": {"path": "flag", "value": False}}, "NOT flag")
typed_by("equals_object_id", {"equals": {"path": "oid", "value": bytes.fromhex(md5(7)[:24])}}, f"oid = '{md5(7)[:24]}'")
typed_by("equals_uuid", {"equals": {"path": "uid", "value": uuid.UUID(md5(33))}}, f"uid = '{uuid.UUID(md5(33))}'")
typed_by("in_uuid", {"in": {"path": "uid", "value": [uuid.UUID(md5(k)) for k in (1, 2, 3, 32)]}}, "uid IN (" + ", ".join(f"'{uuid.UUID(md5(k))}'" for k in (1, 2, 3, 32)) + ")")
typed_by("in_object_id", {"in": {"path": "oid", "value": [bytes.fromhex(md5(k)[:24]) for k in (5, 6)]}}, f"oid IN ('{md5(5)[:24]}', '{md5(6)[:24]}')")
typed_by("range_object_id", {"range": {"path": "oid", "gte": bytes.fromhex("3" + "0" * 23), "lt": bytes.fromhex("5" + "0" * 23)}}, "oid >= '3' AND oid < '5'")
typed_by("range_uuid", {"range": {"path": "uid", "gt": uuid.UUID("c" + "0" * 31)}}, "uid > 'c0000000'")
typed_by("equals_of_several", {"equals": {"path": "words", "value": "URGENT"}}, "list_contains(words, 'URGENT')")
typed_by("in_of_several", {"in": {"path": "words", "value": ["F", "LOW"]}}, "list_contains(words, 'F') OR list_contains(words, 'LOW')")
# Both bounds hold for one value: half of 200,000 and 200,000 itself aren't in between.
typed_by("range_of_several", {"range": {"path": "prices", "gt": 90000, "lt": 110000}}, "len(list_filter(prices, lambda p: p > 90000 AND p < 110000)) > 0")
typed_by("near_of_several", {"near": {"path": "prices", "origin": 50000, "pivot": 1000}}, "true", "round(1000 / (1000 + list_min(list_transform(prices, lambda p: abs(p - 50000)))), 6)")
typed_by("exists_value", {"exists": {"path": "ratio"}}, "ratio IS NOT NULL")
typed_by("equals_null_value", {"equals": {"path": "ratio", "value": None}}, "ratio IS NULL")
typed_by("equals_nan", {"equals": {"path": "ratio", "value": float("nan")}}, "isnan(ratio)")
typed_by("range_without_nan", {"range": {"path": "ratio", "gte": 100}}, "NOT isnan(ratio) AND ratio >= 100")

# Shapes

FAR = "2 * 6371008.7714 * asin(sqrt(least(1, power(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * power(sin(radians({lon} - lon) / 2), 2))))"
POINT = {"type": "Point", "coordinates": [10.25, 20.5]}
FROM_POINT = FAR.format(lon=10.25, lat=20.5)
DIAMOND = [[50.03, 0.04], [0.03, 40.04], [-49.97, 0.04], [0.03, -39.96], [50.03, 0.04]]
HOLE = [[-10.03, -10.04], [10.03, -10.04], [10.03, 10.04], [-10.03, 10.04], [-10.03, -10.04]]
BLOCK = [[100.05, 10.05], [140.05, 10.05], [140.05, 50.05], [100.05, 50.05], [100.05, 10.05]]
IN_DIAMOND = "abs(lon - 0.03) / 50 + abs(lat - 0.04) / 40 < 1"
IN_HOLE, IN_BLOCK = "(abs(lon) < 10.03 AND abs(lat) < 10.04)", "(lon > 100.05 AND lon < 140.05 AND lat > 10.05 AND lat < 50.05)"
typed_by("near_geo", {"near": {"path": "spot", "origin": POINT, "pivot": 1_000_000}}, "true", f"round(1000000 / (1000000 + {FROM_POINT}), 6)")
typed_by("geo_within_circle", {"geoWithin": {"path": "spot", "circle": {"center": POINT, "radius": 2_500_000}}}, f"{FROM_POINT} <= 2500000")
typed_by("geo_within_box", {"geoWithin": {"path": "spot", "box": {"bottomLeft": {"type": "Point", "coordinates": [-30.5, -20.5]}, "topRight": {"type": "Point", "coordinates": [60.25, 45.75]}}}}, "lon BETWEEN -30.5 AND 60.25 AND lat BETWEEN -20.5 AND 45.75")
typed_by("geo_within_polygon", {"geoWithin": {"path": "spot", "geometry": {"type": "Polygon", "coordinates": [DIAMOND]}}}, IN_DIAMOND)
typed_by("geo_within_multi_polygon", {"geoWithin": {"path": "spot", "geometry": {"type": "MultiPolygon", "coordinates": [[DIAMOND, HOLE], [BLOCK]]}}}, f"({IN_DIAMOND} AND NOT {IN_HOLE}) OR {IN_BLOCK}")
#: Boxes of 20 by 15 degrees by their south-western corner, against a block.
TOUCHES, INSIDE = "(lon + 20 >= 100.05 AND lon <= 140.05 AND lat + 15 >= 10.05 AND lat <= 50.05)", "(lon >= 100.05 AND lon + 20 <= 140.05 AND lat >= 10.05 AND lat + 15 <= 50.05)"
for _relation, _where in {"intersects": TOUCHES, "disjoint": f"NOT {TOUCHES}", "within": INSIDE}.items():
    typed_by(f"geo_shape_{_relation}", {"geoShape": {"path": "square", "relation": _relation, "geometry": {"type": "Polygon", "coordinates": [BLOCK]}}}, _where)
typed_by("geo_shape_contains", {"geoShape": {"path": "square", "relation": "contains", "geometry": {"type": "Point", "coordinates": [10.25, 20.25]}}}, "lon <= 10.25 AND lon + 20 >= 10.25 AND lat <= 20.25 AND lat + 15 >= 20.25")

# Sort

by(orders, {"near": {"path": "o_totalprice", "origin": 100000, "pivot": 5000}}, name="sort_by_score_ascending", limit=25, sort={"unused": {"$meta": "searchScore", "order": 1}}, sql="SELECT o_orderkey, round(s, 6) AS score FROM (SELECT o_orderkey, 5000 / (5000 + abs(o_totalprice - 100000)) AS s FROM orders) ORDER BY s, o_orderkey LIMIT 25")


@query(f"WITH {TYPES} SELECT o_orderkey FROM t ORDER BY list_min(prices), o_orderkey LIMIT 30")
def sort_by_least_of_several(spark, sf_dir):
    return q.search(typed(spark, sf_dir), {"exists": {"path": "flag"}, "sort": {"prices": 1}, "limit": 30}).select("o_orderkey")


@query(f"WITH {TYPES} SELECT o_orderkey, words_max AS first FROM (SELECT *, list_max(words) AS words_max FROM t) ORDER BY words_max DESC, o_orderkey LIMIT 30")
def sort_by_largest_of_several(spark, sf_dir):
    found = q.search(typed(spark, sf_dir), {"exists": {"path": "flag"}, "sort": {"words": -1}, "limit": 30})
    return found.select("o_orderkey", F.col("__sort_values.key0").alias("first"))


@query(f"WITH {TYPES} SELECT row_number() OVER (ORDER BY ratio IS NOT NULL, NOT isnan(ratio), ratio, o_orderkey) AS place, o_orderkey FROM t")
def sort_nan_below_numbers(spark, sf_dir):
    found = q.search(typed(spark, sf_dir), {"exists": {"path": "flag"}, "sort": {"ratio": 1}, "limit": None}).select("o_orderkey")
    return tables.numbered(found)  # the order of the result as a column


@query("""WITH m AS (SELECT event_id, event_id % 6 AS kind, value FROM events)
SELECT row_number() OVER (ORDER BY CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 7 ELSE 8 END, CASE kind WHEN 1 THEN round(value, 2) WHEN 4 THEN CAST(event_id % 12 = 4 AS INT) WHEN 5 THEN event_id END, CASE kind WHEN 2 THEN 's' || event_id WHEN 3 THEN md5(CAST(event_id AS VARCHAR)) END, event_id) AS place, event_id FROM m""")
def sort_mixed_types(spark, sf_dir):
    """Values of one path of several types: nulls, numbers, strings, object ids, booleans, dates."""
    e, kind = F.col("event_id"), F.col("event_id") % 6
    oid = F.parse_json(F.concat(F.lit('{"$oid":"'), F.md5(e.cast("string").cast("binary")), F.lit('"}')))
    plain = F.parse_json(F.when(kind == 1, F.round("value", 2).cast("string")).when(kind == 2, F.concat(F.lit('"s'), e.cast("string"), F.lit('"'))).when(kind == 4, (e % 12 == 4).cast("string")).otherwise("null"))
    date = F.timestamp_seconds(e).cast("variant")
    df = read(spark, sf_dir, "events").select("event_id", F.when(kind == 3, oid).when(kind == 5, date).otherwise(plain).alias("mixed"))
    index = SearchIndex(df, {"mappings": {"fields": {"event_id": {"type": "number"}, "mixed": [{"type": "number"}, {"type": "token"}]}}}, "event_id")
    found = q.search(index, {"exists": {"path": "event_id"}, "sort": {"mixed": 1}, "limit": None}).select("event_id")
    return tables.numbered(found)


# Facets of several values, counts beside hits


@query(f"""WITH {TYPES}, w AS (SELECT unnest(list_distinct(words)) AS label FROM t WHERE flag), c AS (SELECT label, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, label LIMIT 5)
SELECT 'words' AS facet, label, n AS count, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INT) AS rank FROM c UNION ALL SELECT 'prices', 'several', (SELECT count(*) FROM t WHERE flag), 2""")
def facet_of_several(spark, sf_dir):
    facets = {"words": {"type": "string", "path": "words", "numBuckets": 5}, "prices": {"type": "number", "path": "prices", "boundaries": [0, 1e9], "default": "several"}}
    found = q.search_meta(typed(spark, sf_dir), {"facet": {"operator": {"equals": {"path": "flag", "value": True}}, "facets": facets}})
    return found.where("facet = 'words' OR label = 'several'")


@query("SELECT o_orderkey, 1.0::DOUBLE AS score, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10")
def facet_hits_and_counts(spark, sf_dir):
    index = orders(spark, sf_dir)
    spec = {"operator": {"equals": {"path": "o_orderstatus", "value": "F"}}, "facets": {"s": {"type": "string", "path": "o_orderstatus"}}}
    counts = q.search_meta(index, {"facet": spec}).select(F.col("count").alias("total"))
    return q.search(index, {"facet": spec, "limit": 10}).select("o_orderkey", F.col("__score").alias("score")).join(F.broadcast(counts))


# Options that change nothing about the result, and stored source


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 250000")
def query_options(spark, sf_dir):
    body = {"range": {"path": "o_totalprice", "gt": 250000}, "concurrent": True, "searchNodePreference": {"key": "a"}, "tracking": {"searchTerms": "large orders"}, "index": "default", "limit": None}
    return q.search(orders(spark, sf_dir), body).select("o_orderkey", "o_orderstatus")


@query(f"WITH {TYPES} SELECT o_orderstatus, o_totalprice FROM t WHERE flag AND o_totalprice > 200000")
def stored_source_included(spark, sf_dir):
    found = q.search(typed(spark, sf_dir), {"range": {"path": "o_totalprice", "gt": 200000}, "returnStoredSource": True, "limit": None})
    return found.drop(*[c for c in found.columns if c.startswith("__")])


@query("""SELECT 'compound' AS operator, count(*) FILTER (o_totalprice > 50000 AND o_orderstatus <> 'O') AS matches FROM orders UNION ALL SELECT 'compound.must[0].range', count(*) FILTER (o_totalprice > 50000) FROM orders
UNION ALL SELECT 'compound.mustNot[0].equals', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 'compound.should[0].in', count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) FROM orders""")
def explain_operators(spark, sf_dir):
    parts_of = {"must": [{"range": {"path": "o_totalprice", "gt": 50000}}], "mustNot": [{"equals": {"path": "o_orderstatus", "value": "O"}}], "should": [{"in": {"path": "o_orderpriority", "value": ["1-URGENT", "5-LOW"]}}]}
    return q.operator_stats(orders(spark, sf_dir), {"compound": parts_of})


# Several indexes of one collection

SHARD = {"range": {"path": "o_totalprice", "gte": 1000}}


def _shards(spark, sf_dir) -> list[SearchIndex]:
    df = read(spark, sf_dir, "orders")
    return [SearchIndex(df.where(F.col("o_orderkey") % 3 == k), ORDERS, "o_orderkey") for k in range(3)]


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
def sharded_search(spark, sf_dir):
    return sharded.search(_shards(spark, sf_dir), SHARD | {"sort": {"o_orderdate": -1}, "limit": 40}).select("o_orderkey", "o_totalprice")


@query("""SELECT 'price' AS facet, label, (SELECT count(*) FROM orders WHERE o_totalprice >= greatest(lo, 1000) AND o_totalprice < hi) AS count, rank FROM (VALUES (0, '0.0', 0, 50000), (1, '50000.0', 50000, 900000)) b(rank, label, lo, hi)
UNION ALL SELECT 'status', label, n, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INT) FROM (SELECT o_orderstatus AS label, count(*) AS n FROM orders WHERE o_totalprice >= 1000 GROUP BY 1)""")
def sharded_facets(spark, sf_dir):
    facets = {"price": {"type": "number", "path": "o_totalprice", "boundaries": [0, 50000, 900000]}, "status": {"type": "string", "path": "o_orderstatus"}}
    return sharded.search_meta(_shards(spark, sf_dir), {"facet": {"operator": SHARD, "facets": facets}})


@query("""SELECT * FROM (VALUES ('hits', 'sort', 'o_orderdate', -1), ('counts', 'sum', 'label', 0)) v(part, merge, keyed, direction)""")
def plan_sharded_search(spark, sf_dir):
    index = orders(spark, sf_dir)
    hits_plan = sharded.plan(index, SHARD | {"sort": {"o_orderdate": -1}})
    facet_plan = sharded.plan(index, {"facet": {"operator": SHARD, "facets": {"s": {"type": "string", "path": "o_orderstatus"}}}})
    rows = [("hits", hits_plan["merge"], *next(iter(hits_plan["sortSpec"].items()))), ("counts", facet_plan["merge"], facet_plan["by"][-1], 0)]
    return spark.createDataFrame(rows, "part string, merge string, keyed string, direction int")


@query("SELECT * FROM (VALUES ('default', 'search', 'READY', true), ('second', 'search', 'READY', true)) v(name, type, status, queryable)")
def catalog_commands(spark, sf_dir):
    catalog, df = IndexCatalog(), read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "_id")
    bare = {k: v for k, v in ORDERS["mappings"]["fields"].items() if k not in ("items", "o_orderkey")}
    catalog.manage("orders", {"createSearchIndexes": {"indexes": [{"name": n, "definition": {"mappings": {"fields": bare}}} for n in ("default", "second", "third")]}}, df)
    catalog.manage("orders", {"updateSearchIndex": {"name": "second", "definition": {"mappings": {"dynamic": True}}}})
    listed = catalog.manage("orders", {"dropSearchIndex": {"name": "third"}})
    return spark.createDataFrame([(x["name"], x["type"], x["status"], x["queryable"]) for x in listed], "name string, type string, status string, queryable boolean")


# Vectors of other kinds

BYTES = [max(-127, min(127, round(x * 100))) for x in QUERY]
BYTE_VECTOR = "list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100) AS DOUBLE))"
BYTE_QUERY = "[" + ", ".join(f"{x}::DOUBLE" for x in BYTES) + "]"


def _bytes(similarity: str):
    def made(spark, sf_dir) -> SearchIndex:
        df = read(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("tinyint")))
        return SearchIndex(df, IndexDefinition.vector([VECTORS[0] | {"similarity": similarity}]), "vec_id")

    return made


BYTE_FORMULAS = {"cosine": f"(1 + list_cosine_similarity({BYTE_VECTOR}, {BYTE_QUERY})) / 2", "euclidean": f"1 / (1 + power(list_distance({BYTE_VECTOR}, {BYTE_QUERY}), 2))"}
for _kind, _sql in BYTE_FORMULAS.items():
    vector_by(f"vector_bytes_{_kind}", _bytes(_kind), {"queryVector": BYTES, "exact": True, "limit": 20}, f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_sql} AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 20")


@query(f"""SELECT vec_id, round((128 - list_sum(list_transform(range(1, 33), lambda k: bit_count(xor(CAST('0x' || h[k] AS INT), CAST('0x' || '{md5(42)}'[k] AS INT))))))/ 128.0, 6)::DOUBLE AS score
FROM (SELECT vec_id, md5(CAST(vec_id AS VARCHAR)) AS h FROM embeddings) ORDER BY score DESC, vec_id LIMIT 20""")
def vector_bits(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.unhex(F.md5(F.col("vec_id").cast("string").cast("binary"))).alias("bits"))
    index = SearchIndex(df, IndexDefinition.vector([{"type": "vector", "path": "bits", "numDimensions": 128, "similarity": "euclidean"}]), "vec_id")
    return q.vector(index, {"path": "bits", "queryVector": bytes.fromhex(md5(42)), "exact": True, "limit": 20}).select("vec_id", F.round("__score", 6).alias("score"))


def _plain(quantization: str = "none"):
    return lambda s, d: SearchIndex(read(s, d, "embeddings"), IndexDefinition.vector([VECTORS[0] | {"similarity": "cosine", "quantization": quantization}, VECTORS[1]]), "vec_id")


STEPS = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: lo + floor((x - lo) / w + 0.5) * w)"
vector_by(
    "vector_scalar_rescore", _plain("scalar"), {"numCandidates": 100, "limit": 10},
    f"""WITH b AS (SELECT min(list_min(CAST(embedding AS DOUBLE[]))) AS lo, (max(list_max(CAST(embedding AS DOUBLE[]))) - min(list_min(CAST(embedding AS DOUBLE[])))) / 127 AS w FROM embeddings),
a AS (SELECT vec_id, embedding, {FORMULAS['cosine'].replace('CAST(embedding AS DOUBLE[])', STEPS)} AS s FROM embeddings, b ORDER BY s DESC, vec_id LIMIT 100)
SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {FORMULAS['cosine']} AS s FROM a) ORDER BY s DESC, vec_id LIMIT 10""",
)


def _searchable(spark, sf_dir) -> SearchIndex:
    fields = {"embedding": {"type": "knnVector", "dimensions": 64, "similarity": "cosine"}, "label": {"type": "number"}}
    return SearchIndex(read(spark, sf_dir, "embeddings"), {"mappings": {"fields": fields}}, "vec_id")


by(_searchable, {"knnBeta": {"path": "embedding", "vector": QUERY, "k": 15, "filter": {"range": {"path": "label", "lte": 3}}}}, name="knn_beta", sql=f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {FORMULAS['cosine']} AS s FROM embeddings WHERE label <= 3) ORDER BY s DESC, vec_id LIMIT 15")
by(
    _searchable, {"compound": {"must": [{"vectorSearch": {"path": "embedding", "queryVector": QUERY, "numCandidates": 60, "limit": 40}}], "filter": [{"range": {"path": "label", "gte": 2}}]}}, name="vector_search_operator",
    sql=f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, label, {FORMULAS['cosine']} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 40) WHERE label >= 2",
)


@query(f"""WITH s AS (SELECT vec_id, {FORMULAS['cosine']} AS s FROM embeddings), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT vec_id, round(s, 6) AS score, rank, rank <= 10 AS in_results FROM r WHERE vec_id IN (1, 5, 17, 100)""")
def vector_trace(spark, sf_dir):
    from fathom.plans.compiler import Compiler

    found = trace(Compiler(_plain()(spark, sf_dir)), {"path": "embedding", "queryVector": QUERY, "numCandidates": 50, "limit": 10}, [1, 5, 17, 100])
    return found.select("vec_id", F.round("score", 6).alias("score"), "rank", "in_results")


@query("SELECT o_orderkey, round(avg(s), 6) AS score FROM (SELECT l_orderkey AS o_orderkey, 1 / (1 + power(l_quantity - 5, 2) + power(l_discount - 0.05, 2)) AS s FROM lineitem) JOIN orders USING (o_orderkey) GROUP BY o_orderkey ORDER BY avg(s) DESC, o_orderkey LIMIT 20")
def vector_nested_average(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.array("l_quantity", "l_discount").alias("v"))).alias("items"))
    df = read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    index = SearchIndex(df, IndexDefinition.vector([{"type": "vector", "path": "items.v", "numDimensions": 2, "similarity": "euclidean"}], nested_root="items"), "o_orderkey")
    body = {"path": "items.v", "queryVector": [5, 0.05], "exact": True, "limit": 20, "nestedOptions": {"scoreMode": "avg"}}
    return q.vector(index, body).select("o_orderkey", F.round("__score", 6).alias("score"))


# The filter language on booleans, equality, dates


def filter_by(name: str, clause: dict, where: str) -> None:
    fields = [{"type": "filter", "path": p} for p in ("flag", "o_orderstatus", "o_totalprice", "words")]
    QUERIES[name] = lambda s, d: filtered(SearchIndex(typed(s, d).docs, IndexDefinition.vector([{"type": "vector", "path": "prices", "numDimensions": 2, "similarity": "cosine"}, *fields]), "o_orderkey"), clause).select("o_orderkey")
    ORACLE_SQL[name] = f"WITH {TYPES} SELECT o_orderkey FROM t WHERE {where}"


filter_by("mql_eq", {"o_orderstatus": {"$eq": "F"}, "flag": True}, "o_orderstatus = 'F' AND flag")
filter_by("mql_boolean_range", {"flag": {"$gt": False}}, "flag")
filter_by("mql_several", {"words": {"$in": ["HIGH", "O"]}, "o_totalprice": {"$lt": 150000}}, "(list_contains(words, 'HIGH') OR list_contains(words, 'O')) AND o_totalprice < 150000")

# Embedded documents in embedded documents

CUSTOMERS = {"mappings": {"fields": {"c_mktsegment": {"type": "token"}, "orders": {"type": "embeddedDocuments", "fields": {
    "status": {"type": "token"}, "lines": {"type": "embeddedDocuments", "fields": {"quantity": {"type": "number"}}}}}}}, "storedSource": True}
LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


def customers(spark: SparkSession, sf_dir: str) -> SearchIndex:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("quantity"))).alias("lines"))
    each = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), "lines")).alias("orders"))
    return SearchIndex(read(spark, sf_dir, "customer").join(each, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey"), CUSTOMERS, "c_custkey")


@query(f"SELECT c_custkey AS __root_id, l_linenumber AS number, l_quantity AS quantity FROM {LINES} WHERE l_quantity > 45 AND o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'")
def return_scope_has_ancestor(spark, sf_dir):
    ancestor = {"hasAncestor": {"ancestorPath": "orders", "operator": {"equals": {"path": "orders.status", "value": "F"}}}}
    root = {"hasRoot": {"operator": {"equals": {"path": "c_mktsegment", "value": "BUILDING"}}}}
    op = {"compound": {"filter": [{"range": {"path": "orders.lines.quantity", "gt": 45}}, ancestor, root]}}
    return q.search(customers(spark, sf_dir), op | {"returnScope": {"path": "orders.lines"}, "returnStoredSource": True, "limit": None}).select("__root_id", "number", "quantity")


by(
    customers, {"embeddedDocument": {"path": "orders", "operator": {"compound": {"must": [{"equals": {"path": "orders.status", "value": "P"}}, {"embeddedDocument": {"path": "orders.lines", "operator": {"range": {"path": "orders.lines.quantity", "gte": 49}}}}]}}}}, name="embedded_in_embedded",
    sql=f"SELECT c_custkey, round(sum(1 + n), 6)::DOUBLE AS score FROM (SELECT c_custkey, o_orderkey, count(*) AS n FROM {LINES} WHERE o_orderstatus = 'P' AND l_quantity >= 49 GROUP BY ALL) GROUP BY c_custkey",
)

# Sources and sinks


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500")
def scan_resumed(spark, sf_dir):
    return tables.scan(spark, f"{sf_dir}/orders.parquet", "o_orderkey", 500).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sink_partitioned(spark, sf_dir):
    path = work_dir(spark, "partitioned")
    tables.write_partitioned(read(spark, sf_dir, "orders"), path, 5, "o_orderkey")
    return tables.scan(spark, path).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_name, 1.0::DOUBLE AS score FROM part WHERE p_size >= 40")
def index_written_and_opened(spark, sf_dir):
    held = parts(spark, sf_dir)
    index = SearchIndex(read(spark, sf_dir, "part"), {"mappings": {"fields": {"p_name": {"type": "string"}, "p_size": {"type": "number"}}}, "numPartitions": 4, "sort": {"p_size": 1}}, held.id_col).write(work_dir(spark, "written"))
    return q.search(SearchIndex.open(spark, index.path, index.definition, index.id_col), {"range": {"path": "p_size", "gte": 40}, "limit": None}).select("p_partkey", "p_name", F.col("__score").alias("score"))


@query("""WITH RECURSIVE b(k, begin_at, size, total) AS (SELECT 0, CAST(0 AS BIGINT), CAST(101 AS DOUBLE), (SELECT count(*) FROM orders)
UNION ALL SELECT k + 1, begin_at + CAST(floor(size) AS BIGINT), power(size, 1.03), total FROM b WHERE begin_at + CAST(floor(size) AS BIGINT) < total)
SELECT k AS batch, least(CAST(floor(size) AS BIGINT), total - begin_at) AS n FROM b""")
def cursor_batches(spark, sf_dir):
    found = q.search(orders(spark, sf_dir), {"exists": {"path": "o_orderkey"}, "limit": None}).select("o_orderkey")
    return tables.in_batches(found).groupBy("batch").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, sha256(p_name || CASE WHEN p_partkey % 10 = 0 THEN ' changed' ELSE '' END) AS digest, CAST(16 AS INT) AS dims FROM part WHERE p_partkey % 3 <> 0")
def sink_embedding_view(spark, sf_dir):
    """The view after a change: rows gone, texts changed, the others as they were."""
    df, path = read(spark, sf_dir, "part"), work_dir(spark, "view")
    tables.materialize_embeddings(df, path, "p_name", "vector", dims=16, id_col="p_partkey")
    later = df.where("p_partkey % 3 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit(" changed"))).otherwise(F.col("p_name")))
    return tables.materialize_embeddings(later, path, "p_name", "vector", dims=16, id_col="p_partkey").select("p_partkey", "digest", F.size("vector").alias("dims"))


# Streams

CHANGES = """e AS (SELECT *, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'delete' ELSE 'insert' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)"""


def _changed(spark, sf_dir, refreshes: int) -> DataFrame:
    """Events as changes of a table of users, streamed; started anew as often as said, each time from the checkpoint."""
    least = read(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    doc = F.struct(F.col("user_id").alias("_id"), "event_id", "value")
    for _ in range(refreshes):
        source = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        events = source.select(F.col("user_id").alias("_id"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == least, "delete").otherwise("insert").alias("op"), F.when(F.col("event_type") != least, doc).alias("doc"))
        if _ == 0:
            path, checkpoint = work_dir(spark, "users"), work_dir(spark, "checkpoint")
            table = IndexedTable(spark, path, "_id long, event_id long, value double")
        apply_stream(events, table, checkpoint, once=True).awaitTermination()
    return table.read()


@query(f"WITH {CHANGES} SELECT user_id AS _id, event_id, value FROM e WHERE r = 1 AND op <> 'delete'")
def cdc_stream(spark, sf_dir):
    return _changed(spark, sf_dir, 1)


@query(f"WITH {CHANGES} SELECT user_id AS _id, event_id, value FROM e WHERE r = 1 AND op <> 'delete'")
def cdc_stream_resumed(spark, sf_dir):
    return _changed(spark, sf_dir, 2)


def _events(spark, sf_dir) -> DataFrame:
    """Events as updates: those of every third one touch `props` alone, of every fifth one the list of fields isn't known."""
    e = read(spark, sf_dir, "events")
    touched = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 3 == 0, F.array(F.lit("props.k"))).otherwise(F.array(F.lit("props"), F.lit("value.amount")))
    doc = F.struct(F.col("user_id").alias("_id"), "event_id", "value")
    return e.select(F.col("user_id").alias("_id"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, "insert").otherwise("update").alias("op"), doc.alias("doc"), touched.alias("updated"))


@query("SELECT user_id AS _id, event_id FROM events WHERE event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 3 <> 0")
def cdc_irrelevant_updates(spark, sf_dir):
    return relevant(_events(spark, sf_dir), ["value"]).select("_id", "doc.event_id")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id AS _id, NOT coalesce(value >= 50, false) AS deleted, CASE WHEN value >= 50 THEN value * 2 END AS twice FROM e WHERE r = 1""")
def cdc_view_rewriting(spark, sf_dir):
    """The last change of each id as a view has it: what the view leaves out is deleted."""
    view = [{"$match": {"value": {"$gte": 50}}}, {"$addFields": {"twice": {"$multiply": ["$value", 2]}}}]
    found = changes(_events(spark, sf_dir), view=view)
    return found.select("_id", "deleted", F.when(~F.col("deleted"), F.col("twice")).alias("twice"))


@query("SELECT p_partkey FROM part WHERE split_part(p_name, ' ', 2) IN ('bolt', 'gear')")
def synonyms_followed(spark, sf_dir):
    """A synonym mapping after its collection changed: one row replaced, one deleted."""
    mapping = {"mappings": {"fields": {"p_name": {"type": "string", "analyzer": "lucene.simple"}}}, "synonyms": [{"name": "words", "source": {"collection": "words"}, "analyzer": "lucene.simple"}]}
    doc = "_id int, mappingType string, synonyms array<string>, input array<string>"
    index = SearchIndex(read(spark, sf_dir, "part"), mapping, "p_partkey", synonyms={"words": spark.createDataFrame([(1, "equivalent", ["bolt", "anvil"], None), (2, "equivalent", ["gear", "red"], None)], doc)})
    schema, folder = f"op string, _id int, seq int, doc struct<{doc.replace(' ', ':').replace(',:', ', ')}>", work_dir(spark, "synonyms")
    rows = [("insert", 1, 1, (1, "equivalent", ["bolt", "anvil"], None)), ("insert", 2, 2, (2, "equivalent", ["gear", "red"], None)), ("replace", 1, 3, (1, "equivalent", ["bolt", "gear"], None)), ("delete", 2, 4, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/events")
    events = spark.readStream.schema(schema).parquet(f"{folder}/events")
    follow_synonyms(events, index, "words", IndexedTable(spark, f"{folder}/table", doc), f"{folder}/checkpoint", once=True).awaitTermination()
    return q.search(index, {"text": {"path": "p_name", "query": "bolt", "synonyms": "words"}, "limit": None}).select("p_partkey")

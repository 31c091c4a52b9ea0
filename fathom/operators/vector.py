"""Vector search: exact, or by binary quantisation in two stages; filters, nested vectors, texts as queries."""

from __future__ import annotations

import math
from functools import reduce
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import vectors
from fathom.operators import mql
from fathom.operators.embedded import elements
from fathom.operators.scoring import apply_score
from fathom.plans.compiler import Compiler, Row, Scope, limit_error
from fathom.plans.definition import type_at
from fathom.plans.errors import need, only

FIELDS = "path! queryVector query limit! numCandidates exact filter parentFilter nestedOptions returnStoredSource explainOptions model concurrent index score"


def spec(c: Compiler, path: str) -> dict:
    d = c.index.kind(path, "vector", "knnVector", "autoEmbedVector")
    need(d, f"{path} must be indexed as vector")
    return {"numDimensions": d.get("numDimensions", d.get("dimensions")), "similarity": d.get("similarity", "cosine"), "quantization": d.get("quantization", "none"), "type": d["type"]}


def query_vector(c: Compiler, body: dict, d: dict, embedder: Callable | None) -> list[float] | bytes:
    need(("queryVector" in body) != ("query" in body), "vectorSearch has either queryVector or query")
    if "query" in body:
        q = body["query"]["text"] if isinstance(body["query"], dict) else body["query"]
        return embedder([q])[0] if embedder else vectors.hash_embedding(q, d["numDimensions"] or 64)
    v = body["queryVector"]
    n = d["numDimensions"]
    if isinstance(v, (bytes, bytearray)):
        need(d["similarity"] == "euclidean", "bit vectors need euclidean similarity")
        need(n is None or 8 * len(v) == n, f"query vector must have {n} dimensions")
        return bytes(v)
    need(isinstance(v, list) and v and all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in v), "query vector must be of finite numbers")
    need(n is None or len(v) == n, f"query vector must have {n} dimensions, not {len(v)}")
    need(d["similarity"] != "cosine" or any(v), "cosine similarity takes no zero vector")
    return [float(x) for x in v]


def check(body: dict) -> None:
    only(body, FIELDS, "vectorSearch")
    limit_error(body["limit"], 1, 10_000_000, "limit")
    if body.get("exact", False):
        need("numCandidates" not in body, "exact search takes no numCandidates")
    else:
        need("numCandidates" in body, "numCandidates is required, unless exact is true")
        limit_error(body["numCandidates"], 1, 10_000, "numCandidates")
        need(body["limit"] <= body["numCandidates"], "limit must not be over numCandidates")


def score_column(v: Column, q: list[float] | bytes, similarity: str) -> Column:
    return vectors.bit_similarity(v, q) if isinstance(q, bytes) else vectors.similarity(v, q, similarity)


def nested_root(c: Compiler, path: str) -> str | None:
    """The path of the embedded documents that hold the vectors: the index's nestedRoot, or the nearest array of structs around them."""
    if c.d.nested_root and path.startswith(c.d.nested_root + "."):
        return c.d.nested_root
    parts = path.split(".")
    for k in range(len(parts) - 1, 0, -1):
        kind = type_at(c.index.schema, ".".join(parts[:k]))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return ".".join(parts[:k])
    return None


def top(df: DataFrame, score: str, id_col: str, n: int) -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(id_col).asc()).limit(n)


def vector_search(c: Compiler, body: dict, embedder: Callable | None = None) -> DataFrame:
    """The `limit` best documents: all columns and __score. Ties by id.

    Exact search is one scan with a top-k in each task, and so is approximate search, of the nearest lists of a written
    index, else of all rows (an exact answer has recall one). With
    scalar quantisation numCandidates come from components in seven bits, and are scored in full. With binary quantisation numCandidates come from Hamming distances, are scored against their signs, and the best
    sqrt(limit * numCandidates) in full; each stage is a bounded top-k of the one before.
    """
    check(body)
    path = body["path"]
    d = spec(c, path)
    q = query_vector(c, body, d, embedder)
    ident = c.index.id_col
    nested = nested_root(c, path)
    mode = body.get("nestedOptions", {}).get("scoreMode", "max")
    need(mode in ("max", "avg"), "scoreMode is max or avg")
    if body.get("parentFilter") is not None:
        need(nested, "parentFilter is for nested vectors")
    conditions = [filter_column(c, Scope(), body[k]) for k in ("parentFilter", *(() if nested else ("filter",))) if body.get(k) is not None]
    df = reduce(lambda d, x: d.where(x), conditions, c.docs())
    if nested:
        field = path[len(nested) + 1 :]
        df = df.withColumn("__vs_e", F.explode(elements(c, Scope(), nested)))
        inner = Scope(nested, F.col("__vs_e"), None, Scope())
        if body.get("filter") is not None:
            df = df.where(filter_column(c, inner, body["filter"]))
        v = F.col("__vs_e")
        for part in field.split("."):
            v = v[part]
        scored = df.select(F.col(ident), score_column(v, q, d["similarity"]).alias("__s")).where(F.col("__s").isNotNull())
        best = scored.groupBy(ident).agg((F.max("__s") if mode == "max" else F.avg("__s")).alias("__score"))
        hits = top(best, "__score", ident, body["limit"])
        return c.index.docs.join(F.broadcast(hits), ident) if body["limit"] <= 10_000 else c.index.docs.join(hits, ident)
    v = F.col(path)
    if path in c.index.lists and not body.get("exact") and not isinstance(q, bytes):
        # Rows of the nearest lists only; a filter is among those that they have.
        df = df.where(F.col("__list").isin(c.index.lists[path].nearest(q, body["numCandidates"])))
    if d["quantization"] == "binary" and not body.get("exact") and not isinstance(q, bytes):
        stored = f"__sgn_{path}"
        words = F.col(stored) if stored in c.index.docs.columns else vectors.signs(v, len(q))
        slim = df.select(ident, v.alias("__v"), words.alias("__w")).where(F.col("__w").isNotNull())
        n = body["numCandidates"]
        some = slim.withColumn("__h", vectors.hamming(F.col("__w"), vectors.sign_words(q))).orderBy(F.col("__h").asc(), F.col(ident).asc()).limit(n)
        some = top(some.withColumn("__a", vectors.dequantized_similarity(F.col("__w"), q, d["similarity"])), "__a", ident, max(body["limit"], math.isqrt(body["limit"] * n)))
        hits = top(some.select(ident, vectors.similarity(F.col("__v"), q, d["similarity"]).alias("__score")).where(F.col("__score").isNotNull()), "__score", ident, body["limit"])
    elif d["quantization"] == "scalar" and not body.get("exact") and not isinstance(q, bytes):
        low, high = c.expanded(("bounds", path), lambda: [vectors.component_bounds(c.index.docs, path)])[0]
        slim = df.select(ident, v.alias("__v"), vectors.similarity(vectors.requantized(v, low, high), q, d["similarity"]).alias("__a")).where(F.col("__a").isNotNull())
        some = top(slim, "__a", ident, body["numCandidates"])
        hits = top(some.select(ident, vectors.similarity(F.col("__v"), q, d["similarity"]).alias("__score")), "__score", ident, body["limit"])
    else:
        hits = top(df.select(ident, score_column(v, q, d["similarity"]).alias("__score")).where(F.col("__score").isNotNull()), "__score", ident, body["limit"])
    # The winners' other columns are read in a second pass, so the first reads ids, vectors and filter fields only.
    return c.index.docs.join(F.broadcast(hits) if body["limit"] <= 10_000 else hits, ident)


def filter_column(c: Compiler, scope: Scope, body: dict) -> Column:
    """A filter is an operator, or a document of the filter language."""
    from fathom.operators import OPERATORS

    if len(body) == 1 and next(iter(body)) in OPERATORS:
        return c.compile(body, scope).match if scope.element is None else c.operator(body, scope).match
    return mql.clause(c, scope, body)


def as_operator(c: Compiler, scope: Scope, body: dict) -> Row:
    """vectorSearch among other operators: matches are its own hits, which come to the rows by a join of ids."""
    check(body)
    d = spec(c, body["path"])
    need(not scope.root, "vectorSearch is for documents")
    query_vector(c, body, d, None)
    if c.dry:
        return Row(F.lit(True), F.lit(0.0))
    key = ("vector", repr(sorted(body.items(), key=repr)))
    hits = c.expanded(key, lambda: [vector_search(Compiler(c.index), {k: v for k, v in body.items() if k != "score"}).select(c.index.id_col, "__score")])[0]
    value = c.joined(repr(key), hits, "__score", body["limit"] <= 10_000)
    return apply_score(c, scope, Row(value.isNotNull(), value), body.get("score"))


def knn_beta(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! vector! k! filter score", "knnBeta")
    need(not scope.root, "knnBeta must be at the top")
    limit_error(body["k"], 1, 10_000, "k")
    return as_operator(c, scope, {"path": body["path"], "queryVector": body["vector"], "limit": body["k"], "exact": True} | {k: body[k] for k in ("filter", "score") if k in body})


def trace(c: Compiler, body: dict, ids: list, embedder: Callable | None = None) -> DataFrame:
    """For each traced id its exact score and rank (null without a vector), and whether it is among the results."""
    d = spec(c, body["path"])
    q = query_vector(c, body, d, embedder)
    ident = c.index.id_col
    own = c.index.docs.where(F.col(ident).isin(ids)).select(ident, score_column(F.col(body["path"]), q, d["similarity"]).alias("score"))
    hits = vector_search(c, body, embedder).select(F.col(ident).alias("__id"), F.lit(True).alias("__in"))
    every = c.index.docs.select(F.col(ident).alias("__o"), score_column(F.col(body["path"]), q, d["similarity"]).alias("__os")).where(F.col("__os").isNotNull())
    # The traced ids are literals of the query, few: one aggregation counts the better ones of each.
    traced = [(r[ident], r["score"]) for r in own.where("score IS NOT NULL").collect()]
    better = [F.count_if((F.col("__os") > F.lit(s)) | ((F.col("__os") == F.lit(s)) & (F.col("__o") < F.lit(i)))).alias(f"n{k}") for k, (i, s) in enumerate(traced)]
    above = list(every.agg(*better).first()) if traced else []
    ranks = c.spark.createDataFrame([(i, n) for (i, _), n in zip(traced, above, strict=True)], T.StructType([T.StructField(ident, c.index.schema[ident].dataType), T.StructField("__above", T.LongType())]))
    found = own.join(ranks, ident, "left").join(hits, F.col(ident) == F.col("__id"), "left")
    return found.select(ident, "score", F.when(F.col("score").isNotNull(), F.coalesce("__above", F.lit(0)) + 1).alias("rank"), F.coalesce("__in", F.lit(False)).alias("in_results"))

"""Queries over several indexes of one collection (shards): each is searched as it is, results are merged.

Statistics are those of each shard. Partial results are bounded (limit or numBuckets rows of each shard), so a merge
reads little; within one index Spark's own partial aggregation and top-k do the same.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.plans import query as q
from fathom.plans import sorting
from fathom.plans.compiler import Compiler
from fathom.plans.errors import need
from fathom.plans.index import SearchIndex


def plan(index: SearchIndex, query: dict) -> dict:
    """How shards' results are merged: sort keys with their directions, and for facets what is summed and how it is cut."""
    _, facet = q.parse(query)
    if facet is not None:
        return {"merge": "sum", "by": ["facet", "label"], "facets": {n: {"order": "count, label", "limit": f.get("numBuckets", 10)} if f["type"] == "string" else {"order": "boundaries"} for n, f in facet["facets"].items()}}
    keys = _keys(index, query)
    return {"merge": "sort", "sortSpec": {("$searchScore" if k.name == "__score" else k.name): 1 if k.ascending else -1 for k in keys}, "limit": query.get("limit", 10)}


def _keys(index: SearchIndex, query: dict) -> list[sorting.Key]:
    legacy = "sortBetaV1" in query
    return sorting.keys_of(Compiler(index), query.get("sortBetaV1") if legacy else query.get("sort"), legacy)


def search(indexes: list[SearchIndex], query: dict) -> DataFrame:
    """Hits of all shards in one order, `limit` of them; columns as of a search of one index."""
    need(indexes, "no index to search")
    need("returnScope" not in query and "highlight" not in query or len(indexes) == 1, "returnScope and highlight are for one index at a time")
    found = reduce(DataFrame.unionByName, [q.search(i, query) for i in indexes])
    keys = [k if k.name == "__score" else replace(k, value=F.col("__sort_values")[f"key{n}"]) for n, k in enumerate(_keys(indexes[0], query))]
    ident = indexes[0].id_col if indexes[0].id_col in found.columns else "__token"
    found = sorting.ordered(found, keys, ident, "searchBefore" in query)
    limit = query.get("limit", 10)
    found = found if limit is None else found.limit(limit)
    return sorting.ordered(found, keys, ident) if "searchBefore" in query else found


def search_meta(indexes: list[SearchIndex], query: dict) -> DataFrame:
    """(facet, label, count, rank): counts of all shards summed, string facets ordered and cut again.

    As between real shards, a label is counted in those shards only where it is among the first numBuckets.
    """
    need(indexes, "no index to search")
    facets = query["facet"]["facets"]
    parts = reduce(DataFrame.unionByName, [q.search_meta(i, query) for i in indexes])
    total = parts.groupBy("facet", "label").agg(F.sum("count").alias("count"), F.min("rank").alias("rank"))
    strings = [n for n, f in facets.items() if f["type"] == "string"]
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("count").desc(), F.col("label").asc())) - 1  # numBuckets rows of each shard
    most = F.coalesce(*[F.when(F.col("facet") == n, F.lit(facets[n].get("numBuckets", 10))) for n in strings]) if strings else F.lit(0)
    ranked = total.withColumn("rank", F.when(F.col("facet").isin(strings), place).otherwise(F.col("rank")).cast("int"))
    return ranked.where(~F.col("facet").isin(strings) | (F.col("rank") < most)).select("facet", "label", "count", "rank")

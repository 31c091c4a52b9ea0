"""Queries: search, its meta results, vector search; explain and cursors are in their own modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators import OPERATORS
from fathom.operators.embedded import elements
from fathom.operators.vector import vector_search
from fathom.plans import facets, highlighting, sorting
from fathom.plans.compiler import Compiler, Scope
from fathom.plans.definition import leaf_paths, type_at
from fathom.plans.errors import need, only
from fathom.plans.index import SearchIndex

OPTIONS = "index count highlight concurrent sort sortBetaV1 returnStoredSource returnScope scoreDetails searchAfter searchBefore tracking searchNodePreference limit facet"


def parse(query: dict) -> tuple[str | None, dict | None]:
    """The query's operator (name and body are its own), and its facet collector; one of the two."""
    names = [k for k in query if k in OPERATORS and not k.startswith("__")]
    only({k: v for k, v in query.items() if k not in names}, OPTIONS, "query")
    need(len(names) <= 1 and not (names and "facet" in query), "a query has exactly one operator or collector")
    need(names or "facet" in query, "a query needs an operator or a collector")
    need(not ("sort" in query and "sortBetaV1" in query), "a query has either sort or sortBetaV1")
    need(not ("searchAfter" in query and "searchBefore" in query), "a query has either searchAfter or searchBefore")
    name = names[0] if names else None
    if "facet" in query:
        only(query["facet"], "operator facets!", "facet")
        facets.check_facets(query["facet"]["facets"])
        inner = query["facet"].get("operator")
        need(not (inner and "vectorSearch" in inner), "vectorSearch can't be faceted")
    if name == "vectorSearch":
        for k in ("sort", "sortBetaV1", "searchAfter", "searchBefore", "highlight", "tracking"):
            need(k not in query, f"vectorSearch takes no {k}")
    if name == "knnBeta":
        need("sortBetaV1" not in query, "knnBeta takes no sortBetaV1")
    if "returnScope" in query:
        only(query["returnScope"], "path!", "returnScope")
        need(query.get("returnStoredSource") is True, "returnScope needs returnStoredSource")
    if "count" in query:
        only(query["count"], "type threshold", "count")
        need(query["count"].get("type", "lowerBound") in ("lowerBound", "total"), "count type is lowerBound or total")
        need(query["count"].get("threshold", 1000) >= 0, "threshold must not be negative")
    if "searchNodePreference" in query:
        only(query["searchNodePreference"], "key!", "searchNodePreference")
    if "tracking" in query:
        only(query["tracking"], "searchTerms!", "tracking")
    return name, query.get("facet")


def operator_of(query: dict) -> dict | None:
    name, facet = parse(query)
    if facet is not None:
        return facet.get("operator") or {"allDocuments": {}}
    return {name: query[name]}


def stored(index: SearchIndex) -> list:
    """The columns that the index stores, nested fields pruned."""
    spec = index.definition.stored_source
    if spec is True:
        return [F.col(f.name) for f in index.schema]
    if isinstance(spec, dict) and "include" in spec:
        kept = set(spec["include"])
        return [x for f in index.schema if (x := _kept(F.col(f.name), f.name, f.dataType, lambda p: any(p == k or p.startswith(k + ".") for k in kept), lambda p: any(k.startswith(p + ".") for k in kept))) is not None]
    dropped = set(spec["exclude"]) if isinstance(spec, dict) else set()
    return [x for f in index.schema if (x := _without(F.col(f.name), f.name, dropped)) is not None]


def _kept(col, path: str, kind: T.DataType, whole: Callable, part: Callable):
    name = path.rpartition(".")[2]
    if whole(path):
        return col.alias(name)
    if not part(path) or not isinstance(kind, T.StructType):
        return None
    inner = [x for f in kind if (x := _kept(col[f.name], f"{path}.{f.name}", f.dataType, whole, part)) is not None]
    return F.struct(*inner).alias(name) if inner else None


def _without(col, path: str, dropped: set[str]):
    if path in dropped:
        return None
    inner = [d[len(path) + 1 :] for d in dropped if d.startswith(path + ".")]
    return (col.dropFields(*inner) if inner else col).alias(path)


def scoped(c: Compiler, path: str) -> tuple[Callable[[DataFrame], DataFrame], Scope, int]:
    """Embedded documents as rows: what adds __e (the element) and __pos to documents for each level, the innermost scope, and the number of levels."""
    index = c.index
    need(index.kind(path, "embeddedDocuments"), f"returnScope path {path} must be indexed as embeddedDocuments")
    roots = [r for r in index.definition.embedded_roots() if path == r or path.startswith(r + ".")]
    scope, steps = Scope(), []
    for k, root in enumerate(roots):
        steps.append(F.posexplode(elements(c, scope, root)).alias(f"__pos{k}", f"__e{k}"))
        scope = Scope(root, F.col(f"__e{k}"), None, scope)
    return (lambda df: reduce(lambda d, s: d.select("*", s), steps, df)), scope, len(steps)


def search(index: SearchIndex, query: dict, in_order: bool = True) -> DataFrame:
    """Hits: the stored columns, __score, and as asked for __highlights, __details, __token, __root_id; ordered, `limit` (10) of them.

    Without a limit and not in_order they come as the scan has them: a sort of all would find them twice, first for its ranges.
    Ties are in the order of ids. A result is one scan, a filter and a top-k in each task; columns that neither the
    query nor the result needs aren't read.
    """
    op = operator_of(query)
    c = Compiler(index)
    ident = index.id_col
    if "returnScope" in query:
        need(index.definition.stored_source, "the index stores no source")
        path = query["returnScope"]["path"]
        unfold, scope, levels = scoped(c, path)
        row = c.compile(op, scope)
        df = unfold(c.docs())
        e = scope.element
        kind = type_at(index.schema, path)
        places = [F.col(f"__pos{k}") for k in range(levels)]
        out = df.where(row.match).select(F.col(ident).alias("__root_id"), *[e[f].alias(f) for f in kind.elementType.names], row.score.cast("double").alias("__score"), F.array(*places).alias("__place"))
        out, limit = out.orderBy(F.col("__score").desc(), "__root_id", "__place"), query.get("limit", 10)
        return (out if limit is None else out.limit(limit)).drop("__place")
    if query.get("returnStoredSource"):
        need(index.definition.stored_source, "the index stores no source")
    row = c.compile(op)
    df = c.docs().where(row.match).withColumn("__score", row.score.cast("double"))
    if query.get("scoreDetails"):
        df = df.withColumn("__details", F.struct(F.col("__score").alias("value"), F.lit(next(iter(op))).alias("description"), score_parts(row.details).alias("details")))
    legacy = "sortBetaV1" in query
    keys = sorting.keys_of(c, query.get("sortBetaV1") if legacy else query.get("sort"), legacy)
    inverted = "searchBefore" in query
    token = query.get("searchBefore", query.get("searchAfter"))
    if token is not None:
        df = sorting.after(df, keys, ident, token, inverted)
    limit = query.get("limit", 10)
    in_order = in_order or limit is not None
    df = sorting.ordered(df, keys, ident, inverted) if in_order else df
    df = df.limit(limit) if limit is not None else df
    extra = ["__score", *(["__details"] if query.get("scoreDetails") else [])]
    if inverted and in_order:
        df = sorting.ordered(df, keys, ident)
    columns = [F.col(x) for x in extra]
    columns.append(sorting.token_column(keys, ident).alias("__token"))
    if query.get("sort") or query.get("sortBetaV1"):
        columns.append(F.struct(*[k.value.alias(f"key{n}") for n, k in enumerate(keys)]).alias("__sort_values"))
    if "highlight" in query:
        df, found = highlighting.highlight(c, df, op, query["highlight"])
        columns.append(found.alias("__highlights"))
    kept = stored(index) if query.get("returnStoredSource") else [F.col(f.name) for f in index.schema]
    return df.select(*kept, *columns)


PARTS = "array<struct<description:string,value:double>>"


def score_parts(details: list[tuple]) -> Column:
    """The parts of a score that count: array<struct<description, value, details>>, of BM25 with idf, tf, freq, dl and avgdl."""
    made = []
    for name, value, *inner in details:
        parts = [F.struct(F.lit(k).alias("description"), v.cast("double").alias("value")) for k, v in (inner[0]() if inner else {}).items()]
        made.append(F.struct(F.lit(name).alias("description"), value.cast("double").alias("value"), (F.array(*parts) if parts else F.expr("array()")).cast(PARTS).alias("details")))
    if not made:
        return F.expr("array()").cast(f"array<struct<description:string,value:double,details:{PARTS}>>")
    return F.filter(F.array(*made), lambda d: d["value"] > 0)


def count(index: SearchIndex, query: dict) -> DataFrame:
    """One row: `total`, or `lowerBound`, which is exact up to the threshold and counts no further."""
    op = operator_of(query)
    c = Compiler(index)
    row = c.compile(op)
    df = c.docs().where(row.match)
    spec = query.get("count", {})
    if spec.get("type", "lowerBound") == "total":
        return df.agg(F.count("*").alias("total"))
    return df.select(F.lit(1)).limit(spec.get("threshold", 1000) + 1).agg(F.count("*").alias("lowerBound"))


def search_meta(index: SearchIndex, query: dict) -> DataFrame:
    """(facet, label, count, rank) of a facet query."""
    _, facet = parse(query)
    need(facet is not None, "the query has no facet collector")
    return facets.facet_counts(Compiler(index), facet.get("operator"), facet["facets"])


def vector(index: SearchIndex, body: dict, embedder: Callable | None = None) -> DataFrame:
    """Hits of a $vectorSearch: columns and __score, best first."""
    need(not body.get("returnStoredSource") or index.definition.stored_source, "the index stores no source")
    found = vector_search(Compiler(index), body, embedder)
    kept = stored(index) if body.get("returnStoredSource") else [F.col(f.name) for f in index.schema]
    return found.select(*kept, "__score").orderBy(F.col("__score").desc(), F.col(index.id_col).asc())


def operators_in(op: dict, at: str = "") -> list[tuple[str, dict]]:
    """(place, operator) of the operator and of those in its clauses: compound, compound.must[0].range, ..."""
    kind, body = next(iter(op.items()))
    place = f"{at}.{kind}" if at else kind
    found = [(place, op)]
    for clause in ("must", "mustNot", "should", "filter") if kind == "compound" else ():
        inner = body.get(clause, [])
        found += [x for k, o in enumerate(inner if isinstance(inner, list) else [inner]) for x in operators_in(o, f"{place}.{clause}[{k}]")]
    return found


def operator_stats(index: SearchIndex, op: dict) -> DataFrame:
    """(operator, matches): how many documents each operator of a tree matches by itself; all in one scan."""
    c = Compiler(index)
    every = [(place, c.compile(o).match) for place, o in operators_in(op)]
    counts = c.docs().agg(*[F.count_if(match).alias(f"n{k}") for k, (_, match) in enumerate(every)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(place).alias("operator"), F.col(f"n{k}").alias("matches")) for k, (place, _) in enumerate(every)])))


def explain(index: SearchIndex, query: dict, verbosity: str = "queryPlanner") -> dict:
    """The operator tree, the physical plan, and with executionStats the number of matches, of the query and of each operator in it."""
    need(verbosity in ("queryPlanner", "executionStats", "allPlansExecution"), "unknown verbosity")
    op = operator_of(query)
    df = search(index, query)
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    out = {"operator": op, "plan": plan, "fields": [p for p in leaf_paths(index.schema) if p in plan]}
    if verbosity != "queryPlanner":
        out["operators"] = {r["operator"]: r["matches"] for r in operator_stats(index, op).collect()}
        out["matches"] = out["operators"][next(iter(op))]
    return out

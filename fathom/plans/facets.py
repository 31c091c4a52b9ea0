"""Facets and drill-sideways: counts by group over the matched documents."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.plans.compiler import Compiler, limit_error
from fathom.plans.errors import need, only

TAGGED = ("equals", "in", "range", "embeddedDocument", "compound")


def check_facets(facets: dict) -> None:
    need(isinstance(facets, dict) and facets, "facets must not be empty")
    for name, f in facets.items():
        only(f, "type! path! numBuckets boundaries default", f"facet {name}")
        need(f["type"] in ("string", "number", "date"), f"facet {name}: unknown type")
        if f["type"] == "string":
            limit_error(f.get("numBuckets", 10), 1, 1000, "numBuckets")
            need("boundaries" not in f and "default" not in f, f"facet {name}: string facets have no boundaries")
        else:
            b = f.get("boundaries")
            need(isinstance(b, list) and 2 <= len(b) <= 1000, f"facet {name}: 2 to 1000 boundaries")
            kinds = (int, float) if f["type"] == "number" else (dt.datetime, dt.date)
            need(all(isinstance(x, kinds) and not isinstance(x, bool) for x in b), f"facet {name}: boundaries must be of its type")
            need(all(x < y for x, y in zip(b, b[1:], strict=False)), f"facet {name}: boundaries must ascend")


def tags_of(body: dict) -> set[str]:
    t = body.get("doesNotAffect", []) if isinstance(body, dict) else []
    return {t} if isinstance(t, str) else set(t)


def without(op: dict | None, facet: str) -> dict | None:
    """The operator as a facet sees it: clauses tagged doesNotAffect with its name are left out, at any depth; None if nothing is left."""
    if op is None:
        return None
    kind, body = next(iter(op.items()))
    if kind in TAGGED and facet in tags_of(body):
        return None
    if kind == "embeddedDocument":
        inner = without(body["operator"], facet)
        return {kind: body | {"operator": inner}} if inner else None
    if kind != "compound":
        return op
    out = {k: v for k, v in body.items() if k not in ("must", "mustNot", "should", "filter")}
    for k in ("must", "mustNot", "should", "filter"):
        if k in body:
            kept = [x for o in (body[k] if isinstance(body[k], list) else [body[k]]) if (x := without(o, facet))]
            if kept:
                out[k] = kept
    if not any(k in out for k in ("must", "mustNot", "should", "filter")):
        return None
    if "minimumShouldMatch" in out:
        out["minimumShouldMatch"] = min(out["minimumShouldMatch"], len(out.get("should", [])))
    return {kind: out}


def drills(op: dict | None) -> bool:
    if op is None:
        return False
    kind, body = next(iter(op.items()))
    if kind in TAGGED and tags_of(body):
        return True
    if kind == "embeddedDocument":
        return drills(body["operator"])
    if kind == "compound":
        return any(drills(o) for k in ("must", "mustNot", "should", "filter") if k in body for o in (body[k] if isinstance(body[k], list) else [body[k]]))
    return False


NOTHING = "array<struct<facet:int,label:string,at:int>>"


def string_labels(c: Compiler, number: int, f: dict) -> Column:
    """What a row counts for: an array's values once each; empty labels don't count."""
    path = f["path"]
    d = c.index.kind(path, "stringFacet", "token")
    need(d, f"{path} must be indexed as stringFacet or token")
    v = F.col(path)
    labels = F.array_distinct(v.cast("array<string>")) if c.index.is_array(path) else F.array(v.cast("string"))
    lower = (lambda x: F.lower(x)) if d.get("normalizer") == "lowercase" else lambda x: x
    return F.transform(F.filter(labels, lambda x: x.isNotNull() & (x != "")), lambda x: F.struct(F.lit(number).alias("facet"), lower(x).alias("label"), F.lit(None).cast("int").alias("at"))).cast(NOTHING)


def bucket_of(v: Column, boundaries: list, date: bool) -> Column:
    """Number of the half-open bucket, or null; a search over sorted literals."""
    at = F.array(*[F.lit(b).cast("timestamp") if date else F.lit(float(b)) for b in boundaries])
    value = v.cast("timestamp") if date else v.cast("double")
    below = F.size(F.filter(at, lambda b: b <= value)) - 1
    inside = value.isNotNull() & (below >= 0) & (below < len(boundaries) - 1)
    return F.when(inside & ~F.isnan(value) if not date else inside, below)


def boundary_bucket(c: Compiler, number: int, f: dict) -> Column:
    """The bucket that a row counts for, -1 for none; values of an array are in none."""
    path, date = f["path"], f["type"] == "date"
    need(c.index.kind(path, *(("date", "dateFacet") if date else ("number", "numberFacet"))), f"{path} must be indexed as {f['type']}")
    bucket = F.lit(None).cast("int") if c.index.is_array(path) else bucket_of(F.col(path), f["boundaries"], date)
    return F.array(F.struct(F.lit(number).alias("facet"), F.lit(None).cast("string").alias("label"), F.coalesce(bucket, F.lit(-1)).cast("int").alias("at"))).cast(NOTHING)


def boundary_labels(f: dict) -> list[tuple[int, str]]:
    """(bucket, label) of each boundary but the last, and of the default."""
    day = lambda b: (b if isinstance(b, dt.datetime) else dt.datetime(b.year, b.month, b.day)).isoformat()
    labels = [(k, day(b) if f["type"] == "date" else str(float(b))) for k, b in enumerate(f["boundaries"][:-1])]
    return [*labels, (-1, str(f["default"]))] if "default" in f else labels


def facet_counts(c: Compiler, operator: dict | None, facets: dict) -> DataFrame:
    """(facet, label, count, rank) of all facets.

    All facets are counted in one scan: a row gives what it counts for in each facet whose operator it matches, which is
    summed in each task before it is shuffled; of string facets each task hands on its first numBuckets only. With
    drill-sideways a facet's rows are those of the operator without its own clauses, and boundary facets leave out empty buckets.
    """
    check_facets(facets)
    sideways = drills(operator)
    every, matches = [], {}
    for k, (name, f) in enumerate(facets.items()):
        op = without(operator, name) if sideways else operator
        match = matches.setdefault(repr(op), c.compile(op).match if op else F.lit(True))
        counted = string_labels(c, k, f) if f["type"] == "string" else boundary_bucket(c, k, f)
        every.append(F.coalesce(F.when(match, counted), F.expr("array()").cast(NOTHING)))  # an array that is null has no labels
    rows = c.docs().where(reduce(or_, matches.values())) if matches else c.docs()
    counts = rows.select(F.inline(F.flatten(F.array(*every)))).groupBy("facet", "label", "at").agg(F.count("*").alias("count"))
    names = F.array(*[F.lit(n) for n in facets])
    out = []
    strings = {k: f.get("numBuckets", 10) for k, f in enumerate(facets.values()) if f["type"] == "string"}
    if strings:
        place = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("count").desc(), F.col("label").asc()))
        ranked = counts.where(F.col("facet").isin(list(strings))).withColumn("place", place).where(F.col("place") <= max(strings.values()))
        most = F.coalesce(*[F.when(F.col("facet") == k, n) for k, n in strings.items()])
        out.append(ranked.where(F.col("place") <= most).select("facet", "label", "count", (F.col("place") - 1).alias("rank")))
    labels = [(k, at, label, n if at < 0 else at) for k, f in enumerate(facets.values()) if k not in strings for own in [boundary_labels(f)] for n in [len(own)] for at, label in own]
    if labels:
        made = c.spark.createDataFrame(labels, "facet int, at int, label string, rank int")
        found = F.broadcast(made).join(counts.where("at IS NOT NULL").select("facet", "at", "count"), ["facet", "at"], "inner") if sideways else made.join(counts.where("at IS NOT NULL").select("facet", "at", "count"), ["facet", "at"], "left")
        out.append(found.select("facet", "label", F.coalesce("count", F.lit(0)).alias("count"), "rank"))
    return reduce(DataFrame.unionByName, out).select(F.element_at(names, F.col("facet") + 1).alias("facet"), "label", "count", F.col("rank").cast("int").alias("rank"))

"""Block joins without a join: embedded documents are elements of the document's own array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators.scoring import apply_score
from fathom.plans.compiler import Compiler, Row, Scope
from fathom.plans.definition import type_at
from fathom.plans.errors import need, only


def elements(c: Compiler, scope: Scope, path: str) -> Column:
    """The array at a path; of a path through several arrays, one flat array."""
    inner = scope.inner(path)
    at, value, several = scope.root, scope.element, False
    for part in inner.split("."):
        at = f"{at}.{part}" if at else part
        kind = type_at(c.index.schema, at)
        need(kind is not None, f"no field {path}")
        value = F.col(part) if value is None else value[part]
        if isinstance(kind, T.ArrayType):
            value = F.flatten(value) if several else value
            several = True
    need(isinstance(type_at(c.index.schema, path), T.ArrayType), f"{path} must be an array")
    return value


def embedded_document(c: Compiler, scope: Scope, body: dict) -> Row:
    """A document matches if one element fulfils the operator as a whole; the elements' scores are aggregated."""
    only(body, "path! operator! doesNotAffect score", "embeddedDocument")
    path = body["path"]
    need(isinstance(path, str) and c.index.kind(path, "embeddedDocuments"), f"{path} must be indexed as embeddedDocuments")
    if scope.root == path:
        return c.operator(body["operator"], scope)
    held: dict[str, Row] = {}

    def child(e: Column, k: Column) -> Column:
        held["row"] = c.operator(body["operator"], Scope(path, e, k, scope))
        return F.when(held["row"].match, held["row"].score.cast("double"))

    values = F.transform(elements(c, Scope(scope.root, scope.element, scope.number, scope.outer), path), child)
    matched = F.filter(F.coalesce(values, F.expr("array()").cast("array<double>")), F.isnotnull)
    score = body.get("score") or {}
    how = score.get("embedded", {}).get("aggregate", "sum") if score else "sum"
    need(how in ("sum", "maximum", "minimum", "mean"), "aggregate is sum, maximum, minimum or mean")
    total = F.aggregate(matched, F.lit(0.0), lambda a, x: a + x)
    value = {"sum": lambda: total, "maximum": lambda: F.array_max(matched), "minimum": lambda: F.array_min(matched), "mean": lambda: total / F.size(matched)}[how]()
    row = Row(F.size(matched) > 0, value, [(f"{path}:{how}", value)])
    outer = score["embedded"].get("outerScore") if "embedded" in score else None
    if "embedded" in score:
        only(score["embedded"], "aggregate outerScore", "embedded")
        return apply_score(c, scope, row, outer)
    return apply_score(c, scope, row, score or None)


def has_root(c: Compiler, scope: Scope, body: dict) -> Row:
    """For embedded documents as result rows: those of which the document matches."""
    only(body, "operator! score", "hasRoot")
    need(scope.root, "hasRoot is for queries with a returnScope")
    top = scope
    while top.outer is not None:
        top = top.outer
    row = c.operator(body["operator"], Scope() if top is scope else top)
    return apply_score(c, scope, row, body.get("score"))


def has_ancestor(c: Compiler, scope: Scope, body: dict) -> Row:
    """As hasRoot, for the embedded document around it at a path."""
    only(body, "ancestorPath! operator! score", "hasAncestor")
    need(scope.root, "hasAncestor is for queries with a returnScope")
    at: Scope | None = scope.outer
    while at is not None and at.root != body["ancestorPath"]:
        at = at.outer
    need(at is not None, f"{body['ancestorPath']} is no ancestor of {scope.root}")
    return apply_score(c, scope, c.operator(body["operator"], at), body.get("score"))

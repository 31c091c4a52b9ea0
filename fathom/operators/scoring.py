"""The score option of operators, and its expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.plans.compiler import Compiler, Row, Scope
from fathom.plans.errors import need, only


def number(c: Compiler, scope: Scope, path: str, missing: float) -> Column:
    """A numeric field's value; the first of several."""
    need(c.index.kind(path, "number") or c.index.kind(path, "numberFacet"), f"{path} isn't indexed as number")
    if c.type_of(path) is None:
        return F.lit(float(missing))
    v = c.value(path, scope)
    v = F.get(v, F.lit(0)) if c.several(path, scope) else v
    return F.coalesce(v.cast("double"), F.lit(float(missing)))


def apply_score(c: Compiler, scope: Scope, row: Row, score: dict | None, allowed: tuple[str, ...] = ("boost", "constant", "function")) -> Row:
    if score is None:
        return row
    only(score, "boost constant function dismax embedded", "score")
    need(len(score) == 1, "score has exactly one of boost, constant, function, dismax and embedded")
    kind, body = next(iter(score.items()))
    need(kind in allowed or kind in ("dismax", "embedded"), f"score {kind} isn't allowed here")
    if kind in ("dismax", "embedded"):
        need(kind in allowed, f"score {kind} isn't allowed here")
        return row
    if kind == "boost":
        only(body, "value path undefined", "boost")
        need(("value" in body) != ("path" in body), "boost has either value or path")
        if "value" in body:
            need(body["value"] > 0, "boost value must be positive")
            return Row(row.match, row.score * F.lit(float(body["value"])), row.details)
        return Row(row.match, row.score * number(c, scope, body["path"], body.get("undefined", 0)), row.details)
    if kind == "constant":
        only(body, "value!", "constant")
        need(body["value"] >= 0, "constant value must not be negative")
        return Row(row.match, F.lit(float(body["value"])))
    return Row(row.match, expression(c, scope, body, row.score), row.details)


def expression(c: Compiler, scope: Scope, body: dict, relevance: Column) -> Column:
    need(isinstance(body, dict) and len(body) == 1, "an expression has exactly one field")
    kind, x = next(iter(body.items()))
    if kind in ("add", "multiply"):
        need(isinstance(x, list) and len(x) >= 2, f"{kind} takes two expressions or more")
        parts = [expression(c, scope, e, relevance) for e in x]
        out = parts[0]
        for p in parts[1:]:
            out = out + p if kind == "add" else out * p
        return out
    if kind == "constant":
        return F.lit(float(x))
    if kind == "gauss":
        only(x, "path! origin! scale! offset decay", "gauss")
        path = x["path"] if isinstance(x["path"], dict) else {"value": x["path"]}
        offset, decay = x.get("offset", 0), x.get("decay", 0.5)
        need(x["scale"] > 0 and offset >= 0 and 0 < decay < 1, "gauss: scale is positive, offset not negative, decay between 0 and 1")
        far = F.greatest(F.lit(0.0), F.abs(number(c, scope, path["value"], path.get("undefined", 0)) - F.lit(float(x["origin"]))) - F.lit(float(offset)))
        return F.exp(far * far / F.lit(x["scale"] ** 2 / math.log(decay)))
    if kind == "log":
        return F.log10(expression(c, scope, x, relevance))
    if kind == "log1p":
        return F.log10(F.lit(1.0) + expression(c, scope, x, relevance))
    if kind == "path":
        x = {"value": x} if isinstance(x, str) else only(x, "value! undefined", "path")
        return number(c, scope, x["value"], x.get("undefined", 0))
    if kind == "score":
        need(x == "relevance", 'score must be "relevance"')
        return relevance
    need(False, f"unknown expression {kind}")
    return relevance


def is_numeric(kind: T.DataType | None) -> bool:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return isinstance(kind, T.NumericType)

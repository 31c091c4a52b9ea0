"""Structured predicates: equals, in, range, exists, near; all of constant score but near."""

from __future__ import annotations

import datetime as dt
import math
import uuid
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import geo
from fathom.operators.scoring import apply_score, is_numeric
from fathom.plans.compiler import nothing, Compiler, Row, Scope
from fathom.plans.errors import QueryError, need, only

MOST_LONG = 2**63 - 1


def kind_of(v: object) -> str:
    """boolean, number, date, string, uuid, objectId or null."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, (dt.datetime, dt.date)):
        return "date"
    if isinstance(v, str):
        return "string"
    if isinstance(v, uuid.UUID):
        return "uuid"
    if isinstance(v, (bytes, bytearray)):
        return "objectId"
    raise QueryError(f"unsupported value {v!r}")


def fits(c: Compiler, path: str, kind: str) -> bool:
    """Whether the path's column holds values of this kind."""
    t = c.type_of(path)
    while isinstance(t, T.ArrayType):
        t = t.elementType
    if kind == "number":
        return is_numeric(t)
    return isinstance(t, {"boolean": T.BooleanType, "date": (T.TimestampType, T.TimestampNTZType, T.DateType), "string": T.StringType, "uuid": T.StringType, "objectId": (T.BinaryType, T.StringType)}[kind])


def literal(c: Compiler, path: str, v: object) -> Column:
    kind = kind_of(v)
    if kind == "uuid":
        return F.lit(str(v))
    if kind == "objectId":
        return F.lit(bytes(v)) if isinstance(c.type_of(path), T.BinaryType) else F.lit(bytes(v).hex())
    return F.lit(v)


def normal(c: Compiler, path: str, kind: str) -> tuple[str, bool]:
    """The index type that serves a kind of value at a path, and whether strings are compared in lower case."""
    wanted = {"string": ("token",), "number": ("number",), "date": ("date",), "boolean": ("boolean",), "objectId": ("objectId",), "uuid": ("uuid",)}[kind]
    d = c.index.kind(path, *wanted) or c.index.kind(path, "filter") or (c.index.kind(path, {"number": "numberFacet", "date": "dateFacet"}.get(kind, wanted[0])))
    if d is None and kind == "string" and c.type_of(path) is not None:
        raise QueryError(f"{path} must be indexed as token")
    return (d or {"type": ""})["type"], bool(d) and d.get("normalizer") == "lowercase"


def is_value(c: Compiler, scope: Scope, path: str, v: object) -> Column:
    """Whether a path has a value (one of several)."""
    kind = kind_of(v)
    if kind == "null":
        return is_null(c, scope, path)
    indexed, lower = normal(c, path, kind)
    if not indexed or not fits(c, path, kind):
        return F.lit(False)
    if kind == "number" and isinstance(v, float) and math.isnan(v):
        return c.any(path, scope, F.isnan)
    if lower:
        return c.any(path, scope, lambda x: F.lower(x) == F.lit(v.lower()))
    return c.any(path, scope, lambda x: x == literal(c, path, v))


def is_null(c: Compiler, scope: Scope, path: str) -> Column:
    """An explicit null. Without a column of field names a fixed schema doesn't tell it from a missing field: then null is null."""
    if c.type_of(path) is None:
        return F.lit(False)
    v = c.value(path, scope)
    null = F.coalesce(F.exists(v, F.isnull), F.lit(False)) if c.several(path, scope) else v.isNull()
    if c.index.field_names_col and not scope.root:
        return null & F.coalesce(F.array_contains(c.index.field_names_col, path), F.lit(False))
    return null


def one_path(path) -> str:
    need(isinstance(path, str), "path must be a string")
    return path


def tags(body: dict) -> None:
    need("doesNotAffect" not in body or isinstance(body["doesNotAffect"], (str, list)), "doesNotAffect is a facet name or a list of them")


def equals(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! value! doesNotAffect score", "equals")
    tags(body)
    return apply_score(c, scope, Row(is_value(c, scope, one_path(body["path"]), body["value"]), F.lit(1.0)), body.get("score"))


def in_(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! value! doesNotAffect score", "in")
    tags(body)
    values = body["value"] if isinstance(body["value"], list) else [body["value"]]
    need(values and len({kind_of(v) for v in values}) == 1 and values[0] is not None, "in takes values of one type, and no null")
    matches = []
    for path, _ in c.paths(body["path"], multi=False):
        kind = kind_of(values[0])
        indexed, lower = normal(c, path, kind)
        if indexed and fits(c, path, kind):
            wanted = [v.lower() for v in values] if lower else values
            if kind in ("uuid", "objectId"):
                matches.append(reduce(or_, [is_value(c, scope, path, v) for v in wanted]))
            else:
                matches.append(is_one_of(c, scope, path, wanted, lower))
    return apply_score(c, scope, Row(reduce(or_, matches), F.lit(1.0)) if matches else nothing(), body.get("score"))


def is_one_of(c: Compiler, scope: Scope, path: str, values: list, lower: bool) -> Column:
    return c.any(path, scope, lambda x: (F.lower(x) if lower else x).isin(values))


def bounds(body: dict, types: tuple[str, ...]) -> list[tuple[str, object]]:
    found = [(k, body[k]) for k in ("gt", "gte", "lt", "lte") if k in body]
    need(found, "range needs a bound")
    need(not ("gt" in body and "gte" in body) and not ("lt" in body and "lte" in body), "range has at most one lower and one upper bound")
    need(len({kind_of(v) for _, v in found}) == 1, "bounds must be of one type")
    need(kind_of(found[0][1]) in types, f"bounds must be one of {types}")
    return found


def within(c: Compiler, scope: Scope, path: str, found: list[tuple[str, object]]) -> Column:
    kind = kind_of(found[0][1])
    indexed, lower = normal(c, path, kind)
    if not indexed or not fits(c, path, kind):
        return F.lit(False)
    low = next((v for k, v in found if k[0] == "g"), None)
    high = next((v for k, v in found if k[0] == "l"), None)
    if low is not None and high is not None and kind in ("number", "date", "string") and (low > high or low == high and not {"gte", "lte"} <= {k for k, _ in found}):
        return F.lit(False)

    def holds(x: Column) -> Column:
        x = F.lower(x) if lower else x
        tests = []
        for k, v in found:
            bound = literal(c, path, v.lower() if lower else v)
            tests.append({"gt": x > bound, "gte": x >= bound, "lt": x < bound, "lte": x <= bound}[k])
        if kind == "number" and not is_integer(c, path):
            tests.append(~F.isnan(x.cast("double")))  # NaN is the least number here, and in no range
        return reduce(and_, tests)

    return c.any(path, scope, holds)


def is_integer(c: Compiler, path: str) -> bool:
    t = c.type_of(path)
    while isinstance(t, T.ArrayType):
        t = t.elementType
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def range_(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! gt gte lt lte doesNotAffect score", "range")
    tags(body)
    found = bounds(body, ("number", "date", "string", "objectId", "uuid"))
    matches = [within(c, scope, p, found) for p, _ in c.paths(body["path"], multi=False)]
    return apply_score(c, scope, Row(reduce(or_, matches), F.lit(1.0)), body.get("score"))


def present(c: Compiler, scope: Scope, path: str) -> Column:
    if c.index.field_names_col and not scope.root:
        names = F.col(c.index.field_names_col)
        return F.coalesce(F.exists(names, lambda n: (n == path) | n.startswith(path + ".")), F.lit(False))
    if c.type_of(path) is None:
        return F.lit(False)
    v = c.value(path, scope)
    if isinstance(c.type_of(path), T.ArrayType):
        return v.isNotNull()
    return F.coalesce(F.exists(v, F.isnotnull), F.lit(False)) if c.several(path, scope) else v.isNotNull()


def exists(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! score", "exists")
    return apply_score(c, scope, Row(present(c, scope, one_path(body["path"])), F.lit(1.0)), body.get("score"))


def near(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! origin! pivot! score", "near")
    origin, pivot = body["origin"], body["pivot"]
    need(isinstance(pivot, (int, float)) and not isinstance(pivot, bool) and pivot > 0, "pivot must be positive")
    rows = []
    for path, _ in c.paths(body["path"], multi=False):
        if isinstance(origin, dict):
            lon, lat = geo.point(origin)
            need(c.index.kind(path, "geo"), f"{path} must be indexed as geo")
            v = c.value(path, scope)
            far = geo.distance(*geo.point_columns(v), F.lit(lon), F.lit(lat))
            rows.append(Row(far.isNotNull(), F.lit(float(pivot)) / (F.lit(float(pivot)) + far)))
            continue
        kind = kind_of(origin)
        need(kind in ("number", "date"), "origin is a number, a date or a point")
        indexed, _ = normal(c, path, kind)
        if not indexed or not fits(c, path, kind):
            continue
        if kind == "number" and is_integer(c, path) and (pivot < 1 or abs(origin) > MOST_LONG) and (c.index.kind(path, "number") or {}).get("representation") == "int64":
            continue  # whole numbers know no smaller pivot
        rows.append(nearness(c, scope, path, kind, origin, float(pivot)))
    return apply_score(c, scope, c.either(rows), body.get("score"))


def nearness(c: Compiler, scope: Scope, path: str, kind: str, origin, pivot: float) -> Row:
    """pivot / (pivot + distance); the nearest of several values. Dates are apart in milliseconds."""
    at = F.lit(float(origin)) if kind == "number" else F.unix_millis(F.lit(origin).cast("timestamp")).cast("double")
    plain = (lambda x: x.cast("double")) if kind == "number" else (lambda x: F.unix_millis(x.cast("timestamp")).cast("double"))
    v = c.value(path, scope)
    far = F.array_min(F.transform(v, lambda x: F.abs(plain(x) - at))) if c.several(path, scope) else F.abs(plain(v) - at)
    score = F.lit(pivot) / (F.lit(pivot) + far)
    return Row(far.isNotNull(), F.when(F.isnan(score), 0.0).otherwise(score))  # NaN is infinitely far


def geo_within(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! circle box geometry score", "geoWithin")
    shapes = [k for k in ("circle", "box", "geometry") if k in body]
    need(len(shapes) == 1, "geoWithin has exactly one of circle, box and geometry")
    test = geo.contains_point(shapes[0], body[shapes[0]])
    matches = []
    for path, _ in c.paths(body["path"], multi=False):
        need(c.index.kind(path, "geo"), f"{path} must be indexed as geo")
        matches.append(F.coalesce(test(*geo.point_columns(c.value(path, scope))), F.lit(False)))
    return apply_score(c, scope, Row(reduce(or_, matches), F.lit(1.0)), body.get("score"))


def geo_shape(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! relation! geometry! score", "geoShape")
    need(body["relation"] in ("contains", "disjoint", "intersects", "within"), "unknown relation")
    matches = []
    for path, _ in c.paths(body["path"], multi=False):
        d = c.index.kind(path, "geo")
        need(d and d.get("indexShapes"), f"{path} must be indexed as geo with indexShapes")
        matches.append(F.coalesce(geo.relate(c.value(path, scope), body["geometry"], body["relation"]), F.lit(False)))
    return apply_score(c, scope, Row(reduce(or_, matches), F.lit(1.0)), body.get("score"))

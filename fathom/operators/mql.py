"""The filter language of vector search. A missing field fulfils $ne, $nin and $not."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.operators.predicates import bounds, is_null, is_value, kind_of, present, within
from fathom.plans.compiler import Compiler, Scope
from fathom.plans.errors import need

RANGES = {"$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte"}


def clause(c: Compiler, scope: Scope, body: dict) -> Column:
    """True or false for every row; {} is true."""
    need(isinstance(body, dict), "a filter is a document")
    tests = []
    for key, x in body.items():
        if key in ("$and", "$or", "$nor"):
            need(isinstance(x, list) and x, f"{key} takes a list of filters")
            parts = [clause(c, scope, p) for p in x]
            tests.append(reduce(and_, parts) if key == "$and" else reduce(or_, parts) if key == "$or" else ~reduce(or_, parts))
        else:
            need(not key.startswith("$"), f"unknown filter operator {key}")
            tests.append(field(c, scope, key, x))
    return reduce(and_, tests) if tests else F.lit(True)


def field(c: Compiler, scope: Scope, path: str, x: object) -> Column:
    need(c.index.kind(path, "filter", "token", "number", "date", "boolean", "objectId", "uuid"), f"{path} needs to be indexed as filter")
    if not (isinstance(x, dict) and any(k.startswith("$") for k in x)):
        return one(c, scope, path, "$eq", x)
    return reduce(and_, [one(c, scope, path, k, v) for k, v in x.items()])


def one(c: Compiler, scope: Scope, path: str, op: str, v: object) -> Column:
    if op in RANGES:
        if kind_of(v) == "boolean":
            return c.any(path, scope, lambda x: {"$gt": x > v, "$gte": x >= v, "$lt": x < v, "$lte": x <= v}[op])
        return within(c, scope, path, bounds({RANGES[op]: v}, ("number", "date", "string", "objectId", "uuid")))
    if op == "$eq":
        return is_null(c, scope, path) if v is None else is_value(c, scope, path, v)
    if op == "$ne":
        return ~one(c, scope, path, "$eq", v)
    if op in ("$in", "$nin"):
        need(isinstance(v, list) and v, f"{op} takes a list of values")
        found = reduce(or_, [one(c, scope, path, "$eq", x) for x in v])
        return found if op == "$in" else ~found
    if op == "$not":
        need(isinstance(v, dict) and v, "$not takes a document of operators")
        return ~reduce(and_, [one(c, scope, path, k, x) for k, x in v.items()])
    if op == "$exists":
        need(isinstance(v, bool), "$exists takes a boolean")
        there = present(c, scope, path)
        return there if v else ~there
    need(False, f"unknown filter operator {op}")
    raise AssertionError

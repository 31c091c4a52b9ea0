"""View pipelines: $addFields, $set and $match before a collection is indexed."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.plans.errors import QueryError, need

COMPARE = {"$eq": lambda a, b: a.eqNullSafe(b), "$ne": lambda a, b: ~a.eqNullSafe(b), "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
N_ARY = {
    "$add": lambda x: reduce(lambda a, b: a + b, x), "$multiply": lambda x: reduce(lambda a, b: a * b, x), "$subtract": lambda x: x[0] - x[1], "$divide": lambda x: x[0] / x[1],
    "$concat": lambda x: F.concat(*x), "$ifNull": lambda x: F.coalesce(*x), "$and": lambda x: reduce(and_, x), "$or": lambda x: reduce(or_, x), "$size": lambda x: F.size(x[0]), "$not": lambda x: ~x[0],
    "$toLower": lambda x: F.lower(x[0]), "$toUpper": lambda x: F.upper(x[0]), "$toString": lambda x: x[0].cast("string"), "$toDouble": lambda x: x[0].cast("double"), "$toInt": lambda x: x[0].cast("int"), "$abs": lambda x: F.abs(x[0]),
}


def expression(x: object) -> Column:
    """An aggregation expression: "$path", a literal, or {operator: arguments}."""
    if isinstance(x, str) and x.startswith("$"):
        return F.col(x[1:])
    if isinstance(x, dict) and len(x) == 1 and next(iter(x)).startswith("$"):
        op, args = next(iter(x.items()))
        if op == "$literal":
            return F.lit(args)
        if op == "$cond":
            a = [args["if"], args["then"], args["else"]] if isinstance(args, dict) else args
            return F.when(expression(a[0]), expression(a[1])).otherwise(expression(a[2]))
        parts = [expression(a) for a in (args if isinstance(args, list) else [args])]
        if op in COMPARE:
            return COMPARE[op](*parts)
        need(op in N_ARY, f"unknown expression {op}")
        return N_ARY[op](parts)
    return F.lit(x)


def condition(body: dict) -> Column:
    """A $match: {path: value}, {path: {operator: value}}, $and, $or, $nor, $expr; never null."""
    tests = []
    for key, x in body.items():
        if key == "$expr":
            tests.append(expression(x))
        elif key in ("$and", "$or", "$nor"):
            parts = [condition(p) for p in x]
            tests.append(reduce(and_, parts) if key == "$and" else reduce(or_, parts) if key == "$or" else ~reduce(or_, parts))
        elif isinstance(x, dict) and any(k.startswith("$") for k in x):
            tests += [compare(F.col(key), k, v) for k, v in x.items()]
        else:
            tests.append(F.col(key).eqNullSafe(F.lit(x)))
    return F.coalesce(reduce(and_, tests), F.lit(False)) if tests else F.lit(True)


def compare(col: Column, op: str, v: object) -> Column:
    if op in COMPARE:
        return COMPARE[op](col, F.lit(v))
    if op in ("$in", "$nin"):
        found = F.coalesce(col.isin(v), F.lit(False))
        return found if op == "$in" else ~found
    if op == "$exists":
        return col.isNotNull() if v else col.isNull()
    if op == "$not":
        return ~reduce(and_, [F.coalesce(compare(col, k, x), F.lit(False)) for k, x in v.items()])
    raise QueryError(f"unknown operator {op}")


def check(pipeline: list[dict]) -> None:
    for stage in pipeline:
        need(isinstance(stage, dict) and len(stage) == 1 and next(iter(stage)) in ("$addFields", "$set", "$match"), "views have $addFields, $set and $match only")


def apply_view(docs: DataFrame, pipeline: list[dict]) -> DataFrame:
    check(pipeline)
    for stage in pipeline:
        kind, body = next(iter(stage.items()))
        if kind == "$match":
            docs = docs.where(condition(body))
        else:
            docs = add_fields(docs, body)
    return docs


def add_fields(docs: DataFrame, body: dict) -> DataFrame:
    new = {}
    for path, x in body.items():
        head, _, rest = path.partition(".")
        new[head] = F.col(head).withField(rest, expression(x)) if rest else expression(x)
    return docs.withColumns(new)


def rewrite_events(events: DataFrame, pipeline: list[dict]) -> DataFrame:
    """A view on a micro-batch of change events: computed fields, and `deleted` for documents that the view leaves out."""
    check(pipeline)
    events = events.withColumn("deleted", F.lit(False))
    for stage in pipeline:
        kind, body = next(iter(stage.items()))
        if kind == "$match":
            events = events.withColumn("deleted", F.col("deleted") | ~condition(body))
        else:
            events = add_fields(events, body)
    return events

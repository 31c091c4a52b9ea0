"""Sort keys, result order and sequence tokens for paging."""

from __future__ import annotations

import base64
import datetime as dt
import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.plans.compiler import Compiler
from fathom.plans.definition import SORTABLE, type_at
from fathom.plans.errors import need, only


@dataclass(frozen=True)
class Key:
    """One sort field: its value column, direction, and whether rows without a value come first in that direction."""

    name: str
    value: Column
    ascending: bool
    nulls_first: bool
    floating: bool = False
    computed: bool = False

    def orders(self, inverted: bool = False) -> list[Column]:
        up, first = self.ascending != inverted, self.nulls_first != inverted
        parts = []
        if self.floating:
            # NaN is the least number; Spark has it as the largest.
            nan = F.when(self.value.isNotNull(), ~F.isnan(self.value))
            parts.append((nan.asc_nulls_first if first else nan.asc_nulls_last)() if up else (nan.desc_nulls_first if first else nan.desc_nulls_last)())
        v = self.value
        parts.append((v.asc_nulls_first() if first else v.asc_nulls_last()) if up else (v.desc_nulls_first() if first else v.desc_nulls_last()))
        return parts

    def after(self, token: object, inverted: bool) -> tuple[Column, Column]:
        """(strictly after the token's value, equal to it), in this key's order."""
        up, first = self.ascending != inverted, self.nulls_first != inverted
        v = self.value
        if token is None:
            return (v.isNotNull() if first else F.lit(False)), v.isNull()
        if isinstance(token, float) and token != token:
            real = v.isNotNull() & ~F.isnan(v)
            past = real if up else F.lit(False)
            return past | (v.isNull() if not first else F.lit(False)), v.isNotNull() & F.isnan(v)
        t = F.lit(token)
        past = (v > t) if up else (v < t)
        if self.floating:
            past = (past & ~F.isnan(v)) if up else (past | F.isnan(v))
        past = F.coalesce(past, F.lit(not first))
        return past, F.coalesce(v == t, F.lit(False))


#: Ranks of a VARIANT's types among each other: null, numbers, strings, objects, arrays, binary, booleans, dates and times.
NULL, NUMBER, STRING, OBJECT, ARRAY, BINARY, OBJECT_ID, BOOLEAN, DATE = range(9)


def bracket(v: Column) -> Column:
    """Sort key of a VARIANT: the rank of its type, and its value as a number (dates in microseconds, false before true) or a text.

    An object of the one field $oid or $uuid is an object id or a UUID; a UUID ranks as binary.
    """
    kind = F.schema_of_variant(v)
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    oid, uid = F.try_variant_get(v, "$['$oid']", "string"), F.try_variant_get(v, "$['$uuid']", "string")
    is_number, is_date = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), kind.rlike("^(DATE|TIMESTAMP)")
    rank = (
        F.when(v.isNull() | (kind == "VOID"), NULL).when(is_number, NUMBER).when(kind == "STRING", STRING).when(oid.isNotNull(), OBJECT_ID).when(uid.isNotNull(), BINARY)
        .when(kind.startswith("OBJECT"), OBJECT).when(kind.startswith("ARRAY"), ARRAY).when(kind == "BINARY", BINARY).when(kind == "BOOLEAN", BOOLEAN).otherwise(DATE)
    )
    # Casts of values of another type are an error, so each branch has its own.
    value = F.when(is_number, number).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(is_date, F.unix_micros(F.try_variant_get(v, "$", "timestamp")).cast("double"))
    binary = F.when(kind == "BINARY", F.hex(F.try_variant_get(v, "$", "binary")))
    return F.struct(rank.alias("rank"), value.alias("number"), F.coalesce(oid, F.upper(F.replace(uid, F.lit("-"))), binary, F.when(~is_number & ~is_date & (kind != "BOOLEAN"), text)).alias("text"))


def keys_of(c: Compiler, sort: dict | None, legacy: bool = False) -> list[Key]:
    """The keys of a sort option; none: score, best first."""
    keys = []
    for path, order in (sort or {}).items():
        no_data = "lowest"
        if isinstance(order, dict):
            only(order, "$meta order noData", "sort")
            if "$meta" in order:
                need(order["$meta"] == "searchScore" and not legacy, "$meta must be searchScore")
                keys.append(Key("__score", F.col("__score"), direction(order.get("order", -1)) > 0, False))
                continue
            need("order" in order, "sort: order is required")
            no_data, order = order.get("noData", "lowest"), order["order"]
            need(no_data in ("lowest", "highest"), "noData is lowest or highest")
        up = direction(order) > 0
        need(c.index.kind(path, *SORTABLE), f"{path} isn't sortable")
        kind = type_at(c.index.schema, path)
        need(kind is not None, f"no field {path}")
        v = plain = F.col(path)
        if c.index.is_array(path):
            v = F.array_min(v) if up else F.array_max(v)
        if isinstance(kind, T.VariantType):
            v = bracket(v)
        d = c.index.kind(path, "token")
        if d and d.get("normalizer") == "lowercase":
            v = F.lower(v)
        base = kind
        while isinstance(base, T.ArrayType):
            base = base.elementType
        keys.append(Key(path, v, up, (no_data == "lowest") == up, isinstance(base, (T.DoubleType, T.FloatType)), v is not plain))
    return keys or [Key("__score", F.col("__score"), False, False)]


def direction(order: object) -> int:
    need(not isinstance(order, bool) and order in (1, -1), "sort order must be 1 or -1")
    return int(order)


def ordered(df: DataFrame, keys: list[Key], id_col: str, inverted: bool = False) -> DataFrame:
    """In the keys' order, ties by id: with a limit this is a top-k in each task, not a sort of all.

    Computed keys are columns while rows are sorted: a sort evaluates its expressions anew for each comparison.
    """
    ident = F.col(id_col)
    made = {f"__sort_key{n}": k.value for n, k in enumerate(keys) if k.computed}
    keys = [replace(k, value=F.col(f"__sort_key{n}")) if k.computed else k for n, k in enumerate(keys)]
    return df.withColumns(made).orderBy(*[o for k in keys for o in k.orders(inverted)], ident.desc() if inverted else ident.asc()).drop(*made)


def token_column(keys: list[Key], id_col: str) -> Column:
    """The row's sequence token: its sort values and id."""
    parts = [F.to_json(F.struct(k.value.alias("v"), F.typeof(k.value).alias("t"))) for k in keys]
    return F.base64(F.to_json(F.struct(F.array(*parts).alias("k"), F.to_json(F.struct(F.col(id_col).alias("v"))).alias("i"))).cast("binary"))


def read_token(token: str, keys: list[Key]) -> tuple[list, object]:
    body = json.loads(base64.b64decode(token))
    need(len(body["k"]) == len(keys), "the sequence token doesn't fit the sort")
    values = []
    for raw in body["k"]:
        one = json.loads(raw)
        v = one.get("v")
        if v is not None and one["t"].startswith("timestamp"):
            v = dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
            v = v if one["t"] == "timestamp" else v.replace(tzinfo=None)
        elif v is not None and one["t"] == "date":
            v = dt.date.fromisoformat(v)
        elif v == "NaN":
            v = float("nan")
        values.append(v)
    return values, json.loads(body["i"])["v"]


def after(df: DataFrame, keys: list[Key], id_col: str, token: str, inverted: bool) -> DataFrame:
    """Rows strictly after a token in the (inverted) order: a filter, so it runs before the top-k."""
    values, ident = read_token(token, keys)
    found = (F.col(id_col) < F.lit(ident)) if inverted else (F.col(id_col) > F.lit(ident))
    for k, v in reversed(list(zip(keys, values, strict=True))):
        past, same = k.after(v, inverted)
        found = past | (same & found)
    return df.where(found)

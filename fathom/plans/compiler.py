"""From operator trees to Columns.

An operator becomes a Row: whether a row matches, and its score where it does. Everything about a document is in its
row, embedded documents too, so a whole tree is one filter and one projection over one scan; Catalyst prunes columns
and pushes what it can into the scan. A scope says where paths are looked up: the document, or an embedded one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import analysis
from fathom.plans.definition import type_at
from fathom.plans.errors import QueryError, need, only
from fathom.plans.index import SearchIndex, analysed, hits_column, length_column, token_column, tokens_of

if TYPE_CHECKING:
    from collections.abc import Iterable


@dataclass
class Row:
    """match: boolean, never null. score: a double where match holds, anything elsewhere. details: parts of the score: name, value, and for some a function that gives what the value is made of."""

    match: Column
    score: Column
    details: list = field(default_factory=list)

    def scored(self) -> Column:
        return F.when(self.match, self.score).otherwise(F.lit(0.0))


def nothing() -> Row:
    return Row(F.lit(False), F.lit(0.0))


def everything() -> Row:
    return Row(F.lit(True), F.lit(1.0))


@dataclass(frozen=True)
class Scope:
    """root: path of the embedded documents, "" for documents. element: the struct that stands for one; number: its place in the array; outer: the scope around it."""

    root: str = ""
    element: Column | None = None
    number: Column | None = None
    outer: Scope | None = None

    def inner(self, path: str) -> str:
        need(not self.root or path == self.root or path.startswith(self.root + "."), f"path {path} isn't below {self.root}")
        return path[len(self.root) + 1 :] if self.root else path


class Compiler:
    def __init__(self, index: SearchIndex) -> None:
        self.index, self.spark, self.d = index, index.spark, index.definition
        self.wanted: set[tuple[str, str, str]] = set()
        self.columns: dict[tuple[str, str], Column] = {}
        self.bases: dict[tuple[str, str], str] = {}
        self.used: dict[str, tuple[Column, bool, analysis.Analyzer]] = {}
        self.sought: dict[str, set[str]] = {}
        self.joins: dict[str, tuple[DataFrame, str, bool]] = {}
        self.dry = False
        self._expanded: dict = {}

    def compile(self, op: dict, scope: Scope | None = None) -> Row:
        """Twice: first to learn which statistics are needed, which then come from one scan for each root."""
        scope = scope or Scope()
        self.dry, self.wanted = True, set()
        self.operator(op, scope)
        self.dry = False
        for root in sorted({self.bases[w[:2]] for w in self.wanted}):
            own = {w for w in self.wanted if self.bases[w[:2]] == root}
            self.index.load_stats(own, self.columns, self.base(root))
        return self.operator(op, scope)

    def operator(self, op: dict, scope: Scope) -> Row:
        from fathom.operators import OPERATORS

        need(isinstance(op, dict), "operator must be a document")
        names = [k for k in op if k in OPERATORS]
        need(len(op) == 1 and names, f"need exactly one operator, not {sorted(op)}")
        return OPERATORS[names[0]](self, scope, op[names[0]])

    def docs(self, hits: bool = True) -> DataFrame:
        """The index's rows with the token arrays that what was compiled so far needs and the index doesn't store.

        Native steps of all of them share a generator, in which each row is analysed once. With hits, the places of the
        terms sought come with each row: few of them from a written index's postings by a broadcast, which Catalyst makes
        an inner join where no other row can match; else another generator goes once through each array. Operators look at those few places only.
        """
        df = analysed(self.index.docs, self.used)
        for rows, name, small in self.joins.values() if hits else ():
            df = df.join(F.broadcast(rows) if small else rows, F.col(self.index.id_col) == F.col(f"{name}_id"), "left").drop(f"{name}_id")
        sought = self.sought if hits else {}
        posted = {stored: terms for stored, terms in sought.items() if self.index.posted(stored)}
        if posted and not self.index.few(posted):
            posted = {stored: terms for stored, terms in posted.items() if not any(terms)}
        found = []
        for stored in sought:
            if stored not in posted:
                found.append(_places(F.col(stored), sorted(sought[stored])).alias(hits_column(stored)))
                if length_column(stored) not in df.columns:
                    found.append(F.size(stored).alias(length_column(stored)))
        if found:
            df = df.select("*", F.inline(F.array(F.struct(*found))))
        if not posted:
            return df
        places = self.index.hits(posted)
        if places is not None:
            df = df.join(F.broadcast(places), "__docrow", "left")
        none = F.expr("array()").cast("array<struct<term:string,pos:int>>")
        made = {hits_column(c): F.coalesce(F.col(hits_column(c)), none) if any(posted[c]) else none for c in posted}
        return df.withColumns(made)

    def joined(self, key: str, rows: DataFrame, value: str, small: bool) -> Column:
        """A value that comes to the index's rows from others of the same id (null where there is none); small rows are broadcast."""
        name = f"__join{list(self.joins).index(key) if key in self.joins else len(self.joins)}"
        self.joins[key] = (rows.select(F.col(self.index.id_col).alias(f"{name}_id"), F.col(value).alias(name)), name, small)
        return F.col(name)

    def seek(self, path: str, analyzer: analysis.Analyzer, scope: Scope, terms: Iterable[str]) -> None:
        """Says which terms of a document's field operators look for."""
        if not scope.root:
            self.sought.setdefault(token_column(path, analyzer.name), set()).update(terms)

    def hits(self, path: str, analyzer: analysis.Analyzer, scope: Scope) -> tuple[Column, Column]:
        """(the places of the terms sought, the number of all tokens) of a field; of an embedded one all tokens."""
        if scope.root:
            tokens = self.tokens(path, analyzer, scope)
            return tokens, F.size(tokens)
        stored = token_column(path, analyzer.name)
        return F.col(hits_column(stored)), F.col(length_column(stored))

    def base(self, root: str) -> DataFrame:
        """The rows that statistics count: documents, or one row per embedded document of a root, as __e."""
        if not root:
            return self.docs(hits=False)
        df, at, kind = self.index.docs, "", self.index.schema
        for part in root.split("."):
            at = f"{at}.{part}" if at else part
            kind = type_at(self.index.schema, at)
            source = F.col("__e")[part] if "__e" in df.columns else F.col(part)
            df = df.select(F.explode(source).alias("__e")) if isinstance(kind, T.ArrayType) else df.select(source.alias("__e"))
        return df

    # Paths

    def paths(self, path, kinds: Iterable[str] = ("string",), multi: bool = True) -> list[tuple[str, str | None]]:
        """(path, multi) of a path parameter: a string, {value, multi}, {wildcard}, or a list of these."""
        if isinstance(path, list):
            need(path, "path must not be empty")
            return list(dict.fromkeys(p for one in path for p in self.paths(one, kinds, multi)))
        if isinstance(path, str):
            return [(path, None)]
        need(isinstance(path, dict) and multi, "path must be a string")
        if "wildcard" in path:
            import re

            only(path, "wildcard!", "path")
            need("**" not in path["wildcard"], "wildcard path must not have ** in it")
            pattern = re.compile("".join(".*" if c == "*" else re.escape(c) for c in path["wildcard"]))
            return [(p, None) for p in self.index.paths() if pattern.fullmatch(p) and self.index.kind(p, *kinds)]
        only(path, "value! multi", "path")
        return [(path["value"], path.get("multi"))]

    def strings(self, body: dict, name: str = "query") -> list[str]:
        q = body[name]
        q = q if isinstance(q, list) else [q]
        need(q and all(isinstance(x, str) for x in q), f"{name} must be a string or a list of strings")
        return q

    def value(self, path: str, scope: Scope) -> Column:
        inner = scope.inner(path)
        if scope.element is None:
            return self.index.value(path)
        out = scope.element
        for part in inner.split("."):
            out = out[part]
        return out

    def several(self, path: str, scope: Scope) -> bool:
        inner = scope.inner(path)
        kind = type_at(self.index.schema, scope.root) if scope.root else self.index.schema
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        return self.index.is_array(inner, kind)

    def type_of(self, path: str) -> T.DataType | None:
        return type_at(self.index.schema, path)

    def any(self, path: str, scope: Scope, condition: Callable[[Column], Column]) -> Column:
        """Whether some value at the path fulfils the condition; both bounds of a range thus hold for one value.

        Null is false, said in a way that scans understand: a missing value fails a test of its own.
        """
        if self.type_of(path) is None:
            return F.lit(False)
        v = self.value(path, scope)
        return F.coalesce(F.exists(v, condition), F.lit(False)) if self.several(path, scope) else v.isNotNull() & condition(v)

    # Text

    def text_field(self, path: str, multi: str | None) -> tuple[str, analysis.Analyzer, analysis.Analyzer, str] | None:
        """Path, index and query analyzer and similarity of a string field; None for a path that isn't indexed as one."""
        d = self.index.string_field(path, multi)
        if d is None or self.type_of(path) is None:
            return None
        return path, self.d.index_analyzer(d), self.d.query_analyzer(d), d.get("similarity", {}).get("type", "bm25")

    def tokens(self, path: str, analyzer: analysis.Analyzer, scope: Scope) -> Column:
        key = (path, analyzer.name)
        self.bases[key] = scope.root
        if scope.root:
            # For statistics embedded documents are rows; in a tree they are elements.
            inner = scope.inner(path)
            row = reduce(lambda c, part: c[part], inner.split("."), F.col("__e"))
            self.columns[key] = tokens_of(row, self.several(path, scope), analyzer)
            need(analyzer.native or not _in_lambda(scope), f"analyzer {analyzer.name} has steps in Python: text of embedded documents needs one without")
            return tokens_of(self.value(path, scope), self.several(path, scope), analyzer)
        stored = token_column(path, analyzer.name)
        if stored not in self.index.ready:
            self.used[stored] = (self.index.value(path), self.index.is_array(path), analyzer)
        self.columns[key] = F.col(stored)
        return self.columns[key]

    def stored(self, path: str, analyzer: str) -> str | None:
        """The stored token array of a document's field; none of an embedded one."""
        return None if self.bases[path, analyzer] else token_column(path, analyzer)

    def terms_of(self, analyzer: analysis.Analyzer, text: str) -> list[tuple[str, int]]:
        return analyzer.analyze(self.spark, text)

    def counts(self, path: str, analyzer: str, terms: Iterable[str]) -> tuple[int, float, dict[str, int]]:
        """Documents with the field, mean length, document frequencies."""
        terms = list(terms)
        self.wanted |= {(path, analyzer, t) for t in ["", *terms]}
        if self.dry:
            return 1, 1.0, dict.fromkeys(terms, 1)
        n, mean = self.index.field_stats(path, analyzer)
        return n, mean, {t: self.index.df(path, analyzer, t) for t in terms}

    def expanded(self, key: tuple, make: Callable[[], list]) -> list:
        """Terms that a pattern stands for: looked up once for both passes."""
        if key not in self._expanded:
            self._expanded[key] = make()
        return self._expanded[key]

    def either(self, rows: list[Row]) -> Row:
        """SHOULD: some row matches; scores of those that do are summed."""
        if not rows:
            return nothing()
        if len(rows) == 1:
            return rows[0]
        return Row(reduce(or_, [r.match for r in rows]), sum_of([r.scored() for r in rows]), [x for r in rows for x in r.details])


def _places(tokens: Column, terms: list[str]) -> Column:
    return F.filter(tokens, lambda t: t["term"].isin(terms))


def _in_lambda(scope: Scope) -> bool:
    return scope.number is not None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, however often body names it: lambdas in body would compute it anew for each element."""
    return F.transform(F.array(value), body)[0]


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) if columns else F.lit(0.0)


def limit_error(value: object, low: float, high: float, name: str) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
        raise QueryError(f"{name} must be from {low} to {high}")

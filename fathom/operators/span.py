"""Positional algebra: spans are array<struct<s, e, n>> of a field (start, end, matched length), row by row."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.operators.scoring import apply_score
from fathom.operators.text import Field, fields, matching_terms, term_options
from fathom.plans.compiler import Compiler, Row, Scope, let
from fathom.plans.errors import need, only

SPANS = "array<struct<s:int,e:int,n:int>>"
#: Up to this slop single terms in order are found by sets of places, (slop + 1) * (slop + 2) / 2 of them for each clause; above it pair by pair.
SMALL_SLOP = 8
#: Up to so many unordered clauses are tried in every order; more are swept over, by where their spans begin.
TRIED_CLAUSES = 4


class Spans:
    """starts: where the spans begin (array<int>), if all are of one term."""

    def __init__(self, field: Field, spans: Column, terms: list[str], starts: Column | None = None) -> None:
        self.field, self.spans, self.terms, self.starts = field, spans, terms, starts


def none() -> Column:
    return F.expr("array()").cast(SPANS)


def spans_of(c: Compiler, scope: Scope, body: dict) -> Spans:
    need(isinstance(body, dict) and len(body) == 1, "a span operator has exactly one kind")
    kind, x = next(iter(body.items()))
    if kind == "term":
        return of_term(c, scope, x)
    if kind == "or":
        only(x, "clauses! score", "or")
        parts = [spans_of(c, scope, p) for p in x["clauses"]]
        same(parts)
        return Spans(parts[0].field, F.array_distinct(F.concat(*[p.spans for p in parts])), [t for p in parts for t in p.terms])
    if kind == "first":
        only(x, "operator! endPositionLte score", "first")
        inner, last = spans_of(c, scope, x["operator"]), x.get("endPositionLte", 3)
        need(isinstance(last, int) and last > 0, "endPositionLte must be positive")
        return Spans(inner.field, F.filter(inner.spans, lambda p: p["e"] <= last), inner.terms)
    if kind == "near":
        only(x, "clauses! inOrder slop score", "near")
        parts = [spans_of(c, scope, p) for p in x["clauses"]]
        need(x.get("slop", 0) >= 0, "slop must not be negative")
        same(parts)
        terms = [t for p in parts for t in p.terms]
        if x.get("inOrder", False):
            return Spans(parts[0].field, in_order(parts, x.get("slop", 0)), terms)
        if len(parts) > TRIED_CLAUSES:
            return Spans(parts[0].field, swept(parts, x.get("slop", 0)), terms)
        return Spans(parts[0].field, F.array_distinct(F.concat(*[in_order(list(p), x.get("slop", 0)) for p in permutations(parts)])), terms)
    if kind == "contains":
        only(x, "big! little! spanToReturn! score", "contains")
        need(x["spanToReturn"] in ("outer", "inner"), "spanToReturn is outer or inner")
        big, little = spans_of(c, scope, x["big"]), spans_of(c, scope, x["little"])
        same([big, little])
        holds = lambda b, s: (b["s"] <= s["s"]) & (s["e"] <= b["e"])
        if x["spanToReturn"] == "outer":
            found = let(little.spans, lambda inner: F.filter(big.spans, lambda b: F.exists(inner, lambda s: holds(b, s))))
        else:
            found = let(big.spans, lambda outer: F.filter(little.spans, lambda s: F.exists(outer, lambda b: holds(b, s))))
        return Spans(big.field, found, big.terms + little.terms)
    if kind == "subtract":
        only(x, "include! exclude! score", "subtract")
        inc, exc = spans_of(c, scope, x["include"]), spans_of(c, scope, x["exclude"])
        same([inc, exc])
        found = let(exc.spans, lambda out: F.filter(inc.spans, lambda p: ~F.exists(out, lambda q: (q["s"] < p["e"]) & (p["s"] < q["e"]))))
        return Spans(inc.field, found, inc.terms)
    need(False, f"unknown span operator {kind}")
    raise AssertionError


def same(parts: list[Spans]) -> None:
    need(parts, "clauses must not be empty")
    need(len({(p.field.path, p.field.analyzer.name) for p in parts}) == 1, "span clauses must be of one field")


def in_order(parts: list[Spans], slop: int) -> Column:
    """Each clause after the one before; the gaps sum up to slop at most. Gaps are checked as they grow, so few combinations are kept."""
    if slop <= SMALL_SLOP and len(parts) > 1 and all(p.starts is not None for p in parts):
        return _terms_in_order([p.starts for p in parts], slop)
    found = parts[0].spans
    for p in parts[1:]:
        found = _joined(found, p.spans, slop)
    return found


def _terms_in_order(starts: list[Column], slop: int) -> Column:
    """The same of single terms, in time that grows with their number and not with its square: for each sum of gaps where the spans end, by intersections of sets of places."""

    def after(ends: Column, own: Column) -> Column:
        """ends[w]: where spans of gaps w end, the place after the last; the same with one clause more."""
        met = lambda w, gap: F.array_intersect(F.transform(ends[w], lambda e: e + gap), own)
        return F.array(*[F.transform(F.array_distinct(F.concat(*[met(w, total - w) for w in range(total + 1)])), lambda p: p + 1) for total in range(slop + 1)])

    empty = F.expr("array()").cast("array<int>")
    ends = F.array(F.transform(starts[0], lambda p: p + 1), *[empty] * slop)
    for own in starts[1:]:
        ends = let(F.struct(ends.alias("ends"), own.alias("own")), lambda both: after(both["ends"], both["own"]))
    n = len(starts)
    return F.flatten(F.transform(ends, lambda places, w: F.transform(F.array_distinct(places), lambda e: F.struct((e - n - w).alias("s"), e.alias("e"), F.lit(n).alias("n")))))


def swept(parts: list[Spans], slop: int) -> Column:
    """Of any order: from each place where a span begins, the nearest span of every clause that begins there or later; one place is one clause's only."""
    every = F.array(*[p.spans for p in parts])
    free = F.struct(F.lit(0).alias("e"), F.lit(0).alias("n"), F.expr("array()").cast("array<int>").alias("taken"))

    def from_place(all_spans: Column, v: Column) -> Column:
        def take(acc: Column, own: Column) -> Column:
            left = F.array_sort(F.filter(own, lambda p: (p["s"] >= v) & ~F.array_contains(acc["taken"], p["s"])))
            return let(F.get(left, F.lit(0)), lambda p: F.struct(F.greatest(acc["e"], p["e"]).alias("e"), (acc["n"] + p["n"]).alias("n"), F.concat(acc["taken"], F.array(p["s"])).alias("taken")))

        return F.aggregate(all_spans, free, take, lambda acc: F.struct(v.alias("s"), acc["e"].alias("e"), acc["n"].alias("n")))

    def tried(own: Column) -> Column:
        found = F.transform(F.array_distinct(F.transform(F.flatten(own), lambda p: p["s"])), lambda v: from_place(own, v))
        return F.filter(found, lambda p: p["n"].isNotNull() & (p["e"] - p["s"] - p["n"] <= slop))

    def passed(flat: Column) -> Column:
        """The same in one pass from the last place to the first, where no two spans begin at one place: the nearest span of each clause is the last one seen."""

        def step(acc: Column, x: Column) -> Column:
            last = F.transform(acc["last"], lambda y, k: F.when(k == x["k"], F.struct(x["s"].alias("s"), x["e"].alias("e"), x["n"].alias("n"))).otherwise(y))

            def added(last: Column) -> Column:
                each = [last[k] for k in range(len(parts))]
                e, n = F.greatest(*[p["e"] for p in each]), reduce(add, [p["n"] for p in each])  # no sum where a clause has no span yet
                return F.struct(last.alias("last"), F.when(e - x["s"] - n <= slop, F.concat(acc["found"], F.array(F.struct(x["s"].alias("s"), e.alias("e"), n.alias("n"))))).otherwise(acc["found"]).alias("found"))

            return let(last, added)

        start = F.struct(F.array_repeat(F.lit(None).cast("struct<s:int,e:int,n:int>"), len(parts)).alias("last"), none().alias("found"))
        return F.aggregate(F.reverse(F.array_sort(flat)), start, step, lambda acc: acc["found"])

    flat = F.flatten(F.transform(every, lambda own, k: F.transform(own, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), p["n"].alias("n"), k.alias("k")))))
    apart = lambda flat: F.size(F.array_distinct(F.transform(flat, lambda p: p["s"]))) == F.size(flat)
    return F.when(F.exists(every, lambda own: F.size(own) == 0), none()).otherwise(let(flat, lambda flat: F.when(apart(flat), passed(flat)).otherwise(tried(every))))


def _joined(left: Column, right: Column, slop: int) -> Column:
    pair = lambda a, right: F.transform(F.filter(right, lambda b: (b["s"] >= a["e"]) & (b["e"] - a["s"] - a["n"] - b["n"] <= slop)), lambda b: F.struct(a["s"].alias("s"), b["e"].alias("e"), (a["n"] + b["n"]).alias("n")))
    both = F.struct(left.alias("left"), right.alias("right"))
    return let(both, lambda s: F.array_distinct(F.flatten(F.transform(s["left"], lambda a: pair(a, s["right"])))))


def of_term(c: Compiler, scope: Scope, body: dict) -> Spans:
    only(body, "path! query! fuzzy prefix regex wildcard score", "term")
    term_options(body)
    found = fields(c, scope, body["path"], True)
    need(len(found) == 1, "a span term has one string path")
    f = found[0][0]
    parts, terms = [], []
    for q in c.strings(body):
        kind, x = matching_terms(c, f, body, q)
        if kind == "terms":
            names = [t for t, _ in x]
            terms += names
            parts.append(_where(f, kind, names))
        else:
            parts.append(_where(f, kind, x))
    starts = F.concat(*parts) if len(parts) > 1 else parts[0]
    return Spans(f, F.transform(starts, lambda p: F.struct(p.alias("s"), (p + 1).alias("e"), F.lit(1).alias("n"))), terms, starts)


def _where(f: Field, kind: str, x) -> Column:
    if kind == "terms" and not x:
        return F.expr("array()").cast("array<int>")
    test = (lambda t: t["term"].rlike(x)) if kind == "pattern" else (lambda t: t["term"].startswith(x))
    return (f.places(x) if kind == "terms" else F.filter(f.tokens, test))["pos"]


def span(c: Compiler, scope: Scope, body: dict) -> Row:
    """A match for every document with a span; a span counts the less, the wider it is than what it matched."""
    inner = next(iter(body.values()), {}) if isinstance(body, dict) else {}
    score = inner.get("score") if isinstance(inner, dict) else None
    found = spans_of(c, scope, body)
    freq = F.aggregate(found.spans, F.lit(0.0), lambda acc, p: acc + F.lit(1.0) / (F.lit(1.0) + F.greatest(p["e"] - p["s"] - p["n"], F.lit(0))))
    terms = list(dict.fromkeys(found.terms))
    value = found.field.weighed(terms, freq) if terms else F.lit(1.0)
    return apply_score(c, scope, Row(F.size(found.spans) > 0, value, [(f"{found.field.path}:span", value)]), score, ("boost",))


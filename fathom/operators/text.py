"""Analysed text: text, phrase, autocomplete, term, and the legacy search; terms by pattern: regex, wildcard; moreLikeThis."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions import scores
from fathom.functions.analysis import Analyzer, icu_fold
from fathom.functions.distance import glob, whole_regex
from fathom.operators.scoring import apply_score
from fathom.plans.compiler import Compiler, Row, Scope, let, limit_error, nothing, sum_of
from fathom.plans.errors import QueryError, need, only

#: What a synonym's scores other than the best add to a group; the factor of an exact match.
SYNONYM_TIE, EXACT = 0.1, 2.0
#: Terms that moreLikeThis keeps of an example.
LIKE_TERMS = 25


class Field:
    """A string field in a scope: its tokens, and the score of terms in it."""

    def __init__(self, c: Compiler, scope: Scope, path: str, analyzer: Analyzer, similarity: str) -> None:
        self.c, self.path, self.analyzer, self.similarity, self.scope = c, path, analyzer, similarity, scope
        self.tokens = c.tokens(path, analyzer, scope)

    def places(self, terms: list[str]) -> Column:
        """Where some terms stand: array<struct<term, pos>>."""
        self.c.seek(self.path, self.analyzer, self.scope, terms)
        return F.filter(self.c.hits(self.path, self.analyzer, self.scope)[0], lambda t: t["term"].isin(terms) if len(terms) != 1 else t["term"] == terms[0])

    @property
    def length(self) -> Column:
        self.c.seek(self.path, self.analyzer, self.scope, ())
        return self.c.hits(self.path, self.analyzer, self.scope)[1]

    def weighed(self, terms: list[str], freq: Column, df: int | None = None) -> Column:
        """The score of `freq` occurrences of what these terms make up."""
        n, mean, dfs = self.c.counts(self.path, self.analyzer.name, terms)
        if self.similarity == "boolean":
            return F.lit(float(len(terms)))
        if self.similarity == "stableTfl":
            return sum_of([scores.stable_tfl(t, freq, self.length) for t in terms])
        return scores.bm25(math.fsum(scores.idf(n, dfs[t] if df is None else df) for t in terms), freq, self.length, mean)

    def parts(self, terms: list[str], freq: Column, df: int | None = None) -> dict[str, Column]:
        """What the score of `freq` occurrences is made of."""
        n, mean, dfs = self.c.counts(self.path, self.analyzer.name, terms)
        if self.similarity != "bm25":
            return {"freq": freq}
        idf = math.fsum(scores.idf(n, dfs[t] if df is None else df) for t in terms)
        return {"idf": F.lit(idf), "tf": scores.bm25(1.0, freq, self.length, mean), "freq": freq, "dl": self.length, "avgdl": F.lit(mean)}

    def term(self, term: str, boost: float = 1.0, df: int | None = None) -> Row:
        freq = F.size(self.places([term]))
        score = self.weighed([term], freq, df)
        return Row(freq > 0, score * boost if boost != 1 else score, [(f"{self.path}:{term}", score, lambda: self.parts([term], freq, df))])

    def terms(self, found: list[tuple[str, float]]) -> Row:
        """Any of some terms, each with its factor; rare ones don't outweigh common ones: all have the largest document frequency."""
        _, _, dfs = self.c.counts(self.path, self.analyzer.name, [t for t, _ in found])
        return self.c.either([self.term(t, b, max(dfs.values())) for t, b in found])

    def fuzzy(self, term: str, option: dict, most: int = 50, prefix_default: int = 0) -> Row:
        edits, prefix, most = option.get("maxEdits", 2), option.get("prefixLength", prefix_default), option.get("maxExpansions", most)
        base = self.c.base(self.c.bases[self.path, self.analyzer.name])
        tokens = self.c.columns[self.path, self.analyzer.name]
        found = self.c.expanded(("fuzzy", self.path, self.analyzer.name, term, edits, prefix, most), lambda: self.c.index.fuzzy_terms(tokens, term, edits, prefix, most, base, self.c.stored(self.path, self.analyzer.name)))
        return self.terms([(t, 1 - d / max(1, min(len(t), len(term)))) for t, d in found]) if found else nothing()

    def phrase(self, parts: list[tuple[list[str], int]], slop: int) -> Row:
        """Alternatives of terms at relative positions. With a slop, positions less their place in the phrase spread over at most slop."""
        if not parts:
            return nothing()
        first = min(p for _, p in parts)
        shifted = [self._shift(terms, place - first) for terms, place in parts]
        if slop == 0:
            starts = F.array_distinct(shifted[0])
            for other in shifted[1:]:
                starts = F.array_intersect(starts, other)
            freq = F.size(starts)
        else:
            freq = _sloppy(shifted, slop, same_terms(parts))
        terms = [t for ts, _ in parts for t in ts]
        score = self.weighed(terms, freq)
        return Row(freq > 0, score, [(f'{self.path}:"{" ".join(terms)}"', score, lambda: self.parts(terms, freq))])

    def _shift(self, terms: list[str], by: int) -> Column:
        return F.transform(self.places(terms), lambda t: t["pos"] - by)


def same_terms(parts: list[tuple[list[str], int]]) -> list[tuple[int, int]] | None:
    """For each part its place in the phrase and the number of the first part with a term in common; None if no term is repeated."""
    first = min(p for _, p in parts)
    groups = [(p - first, next(k for k, (other, _) in enumerate(parts) if set(terms) & set(other))) for terms, p in parts]
    return None if len({g for _, g in groups}) == len(groups) else groups


def _sloppy(places: list[Column], slop: int, groups: list[tuple[int, int]] | None) -> Column:
    """Sum of 1 / (1 + width) over the first places of matches: width is how far the nearest following places of all parts reach.

    One place of the text stands for one of the parts with the same term only: each takes the nearest that is left.
    Places of all parts are sorted as numbers (the place, then the part), so what a first place can reach are the next few of them.
    """
    bits, far, most = (len(places) - 1).bit_length(), F.lit(1 << 60), min((slop + 1) * len(places), 1 << 30)
    place, part = lambda x: F.shiftright(x, bits), lambda x: x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    coded = F.flatten(F.transform(F.array(*places), lambda own, k: F.transform(own, lambda p: F.shiftleft(p.cast("long") + F.lit(1 << 31), bits).bitwiseOR(k.cast("long")))))

    def plain(near: Column, v: Column) -> Column:
        nearest = lambda k: F.coalesce(place(F.get(F.filter(near, lambda x: part(x) == k), F.lit(0))), far)
        return F.array_max(F.array(*map(nearest, range(len(places))))) - v

    def grouped(near: Column, v: Column) -> Column:
        shape = F.array(*[F.struct(F.lit(k).cast("long").alias("part"), F.lit(at).alias("at"), F.lit(g).alias("group")) for k, (at, g) in enumerate(groups or [])])
        none = F.struct(F.lit(0).cast("long").alias("reach"), F.expr("array()").cast("array<struct<group:int,pos:bigint>>").alias("taken"))

        def take(acc: Column, own: Column) -> Column:
            stands = lambda p: F.struct(own["group"].alias("group"), (p + own["at"]).alias("pos"))
            nearest = F.coalesce(place(F.get(F.filter(near, lambda x: (part(x) == own["part"]) & ~F.array_contains(acc["taken"], stands(place(x)))), F.lit(0))), far)
            return let(nearest, lambda p: F.struct(F.greatest(acc["reach"], p - v).alias("reach"), F.concat(acc["taken"], F.array(stands(p))).alias("taken")))

        return F.aggregate(shape, none, take, lambda acc: acc["reach"])

    def widths(every: Column) -> Column:
        def width(x: Column, k: Column) -> Column:
            fresh = F.coalesce(place(F.get(every, k - 1)) < place(x), F.lit(True))
            return F.when(fresh, let(F.slice(every, k + 1, F.lit(most)), lambda near: (plain if groups is None else grouped)(near, place(x)))).otherwise(far)

        return F.transform(every, width)

    found = let(F.sort_array(F.array_distinct(coded)), widths)
    return F.aggregate(F.filter(found, lambda w: w <= slop), F.lit(0.0), lambda acc, w: acc + F.lit(1.0) / (F.lit(1.0) + w))


def fields(c: Compiler, scope: Scope, path, positions: bool = False) -> list[tuple[Field, Analyzer]]:
    out = []
    for p, multi in c.paths(path):
        found = c.text_field(p, multi)
        if found is not None:
            if positions:
                d = c.index.string_field(p, multi)
                need(d.get("indexOptions", "offsets") in ("positions", "offsets"), f"{p} is indexed without positions")
            out.append((Field(c, scope, found[0], found[1], found[3]), found[2]))
    return out


def check_fuzzy(option: dict, edits=(1, 2), expansions: int = 1000) -> dict:
    only(option, "maxEdits maxExpansions prefixLength", "fuzzy")
    need(option.get("maxEdits", 2) in edits, f"maxEdits is one of {edits}")
    limit_error(option.get("maxExpansions", 50), 1, expansions, "maxExpansions")
    need(option.get("prefixLength", 0) >= 0, "prefixLength must not be negative")
    return option


def combine(c: Compiler, rows: list[Row], every: bool) -> Row:
    if not rows:
        return nothing()
    if every:
        return Row(reduce(and_, [r.match for r in rows]), sum_of([r.score for r in rows]), [x for r in rows for x in r.details])
    return c.either(rows)


def text(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! query! fuzzy matchCriteria synonyms score", "text")
    need(not ("fuzzy" in body and "synonyms" in body), "text has either fuzzy or synonyms")
    criteria = body.get("matchCriteria", "any")
    need(criteria in ("any", "all"), "matchCriteria is any or all")
    if "fuzzy" in body:
        check_fuzzy(body["fuzzy"])
    rows = []
    for f, analyzer in fields(c, scope, body["path"]):
        for q in c.strings(body):
            terms = [t for t, _ in c.terms_of(analyzer, q)]
            if "synonyms" in body:
                rows.append(with_synonyms(c, f, body["synonyms"], terms, criteria == "all"))
            else:
                rows.append(combine(c, [f.fuzzy(t, body["fuzzy"]) if "fuzzy" in body else f.term(t) for t in terms], criteria == "all"))
    return apply_score(c, scope, c.either(rows), body.get("score"))


def synonym_groups(c: Compiler, name: str, terms: list[str]) -> list[list[list[str]]]:
    """The terms cut, longest first, into runs that have synonyms; for each the alternatives, itself first."""
    table = {tuple(i): outs for i, outs in c.index.synonyms(name)}
    longest, groups, at = max((len(k) for k in table), default=1), [], 0
    while at < len(terms):
        for n in range(min(longest, len(terms) - at), 0, -1):
            run = terms[at : at + n]
            if tuple(run) in table:
                groups.append([*[x for x in [run] if run in table[tuple(run)]], *[x for x in table[tuple(run)] if x != run]])
                at += n
                break
        else:
            groups.append([[terms[at]]])
            at += 1
    return groups


def with_synonyms(c: Compiler, f: Field, name: str, terms: list[str], every: bool) -> Row:
    """Per run of terms the best alternative, and a part of the others; or the terms as they are, which count twice more.

    A term that has no synonyms is looked up as it is.
    """
    rows, groups = [], synonym_groups(c, name, terms)
    if groups == [[[t]] for t in terms] and len(terms) == 1:
        return f.term(terms[0])
    for group in groups:
        options = [f.term(g[0]) if len(g) == 1 else f.phrase([([t], k) for k, t in enumerate(g)], 0) for g in group]
        scored = [o.scored() for o in options]
        best = F.greatest(*scored) if len(scored) > 1 else scored[0]
        rows.append(Row(reduce(or_, [o.match for o in options]), best + SYNONYM_TIE * (sum_of(scored) - best), [x for o in options for x in o.details]))
    found = combine(c, rows, every)
    exact = combine(c, [f.term(t) for t in terms], every)
    return Row(found.match | exact.match, found.scored() + EXACT * exact.scored(), found.details)


def phrase(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! query! slop synonyms score", "phrase")
    slop = body.get("slop", 0)
    need(isinstance(slop, int) and slop >= 0, "slop must not be negative")
    rows = []
    for f, analyzer in fields(c, scope, body["path"], True):
        for q in c.strings(body):
            terms = c.terms_of(analyzer, q)
            exact = as_phrase(f, terms, slop)
            if "synonyms" not in body:
                rows.append(exact)
                continue
            options = [[]]
            for group in synonym_groups(c, body["synonyms"], [t for t, _ in terms]):
                need(len(options) * len(group) <= 1024, "too many synonym phrases")
                options = [o + g for o in options for g in group]
            spelled = c.either([as_phrase(f, [(t, k) for k, t in enumerate(o)], slop) for o in options])
            rows.append(Row(spelled.match | exact.match, spelled.scored() + EXACT * exact.scored(), spelled.details))
    return apply_score(c, scope, c.either(rows), body.get("score"))


def as_phrase(f: Field, terms: list[tuple[str, int]], slop: int) -> Row:
    if len(terms) == 1:
        return f.term(terms[0][0])
    places: dict[int, list[str]] = {}
    for t, p in terms:
        places.setdefault(p, []).append(t)
    return f.phrase([(ts, p) for p, ts in sorted(places.items())], slop)


def autocomplete(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! query! fuzzy tokenOrder score", "autocomplete")
    need(isinstance(body["path"], str), "autocomplete takes one path")
    path, order = body["path"], body.get("tokenOrder", "any")
    need(order in ("any", "sequential"), "tokenOrder is any or sequential")
    d = c.index.kind(path, "autocomplete")
    need(d, f"{path} isn't indexed as autocomplete")
    most = d.get("maxGrams", 15)
    base, grams = c.d.analyzer_named(d.get("analyzer", c.d.analyzer)), c.d.index_analyzer(d)
    if "fuzzy" in body:
        check_fuzzy(body["fuzzy"])
        need(body["fuzzy"].get("prefixLength", 0) <= most, "prefixLength must not be over maxGrams")
    queries, words = c.strings(body), []
    for q in queries:
        if order == "any":
            words += [t for t, _ in c.terms_of(base, q)]
    fold = (lambda w: icu_fold(w)) if d.get("foldDiacritics", True) else (lambda w: w)
    lower = any(x["type"] == "lowercase" for x in base.token_filters)
    cut = (lambda w: w[-most:]) if d.get("tokenization") == "rightEdgeGram" else (lambda w: w[:most])
    tokens = list(dict.fromkeys(t for w in [*words, *queries] if (t := cut(fold(w.lower() if lower else w)).strip())))
    need(tokens, "autocomplete: no tokens after analysis")
    f = Field(c, scope, path, grams, "bm25")
    rows = []
    for t in tokens:
        if "fuzzy" not in body or len(t) <= body["fuzzy"].get("prefixLength", 0):
            rows.append(f.term(t))
        else:
            rows.append(f.fuzzy(t, {k: v for k, v in body["fuzzy"].items() if k != "maxExpansions"}, most=None))
    found = c.either(rows)
    if c.index.kind(path, "string"):
        exact = c.either([s.term(t) for s, a in fields(c, scope, path) for q in queries for t, _ in c.terms_of(a, q)])
        found = Row(found.match, found.score + exact.scored(), found.details)
    return apply_score(c, scope, found, body.get("score"))


def by_pattern(kind: str):
    """regex and wildcard: a whole term, constant score."""

    def run(c: Compiler, scope: Scope, body: dict) -> Row:
        only(body, "path! query! allowAnalyzedField score", kind)
        rows = []
        for p, multi in c.paths(body["path"]):
            found = c.text_field(p, multi)
            if found is None:
                if c.index.kind(p, "token"):
                    for q in c.strings(body):
                        rows.append(Row(token_like(c, scope, p, kind, q), F.lit(1.0)))
                continue
            path, analyzer, _, _ = found
            keyword = analyzer.tokenizer["type"] == "keyword"
            need(keyword or body.get("allowAnalyzedField", False), f"{p} is analysed: {kind} needs allowAnalyzedField or a keyword analyzer")
            tokens = c.tokens(path, analyzer, scope)
            for q in c.strings(body):
                pattern = java(kind, q)
                rows.append(Row(exists_like(tokens, pattern), F.lit(1.0)))
        row = c.either(rows) if rows else nothing()
        return apply_score(c, scope, row, body.get("score"))

    return run


def java(kind: str, q: str) -> str:
    try:
        return glob(q) if kind == "wildcard" else whole_regex(q)
    except ValueError as e:
        raise QueryError(str(e)) from None


def exists_like(tokens: Column, pattern: str) -> Column:
    return F.exists(tokens, lambda t: t["term"].rlike(pattern))


def token_like(c: Compiler, scope: Scope, path: str, kind: str, q: str) -> Column:
    pattern = java(kind, q)
    lower = (c.index.kind(path, "token") or {}).get("normalizer") == "lowercase"
    return c.any(path, scope, lambda v: (F.lower(v) if lower else v).rlike(pattern))


def term_options(body: dict) -> str | None:
    on = [k for k in ("fuzzy", "prefix", "regex", "wildcard") if body.get(k) not in (None, False)]
    need(len(on) <= 1, "term has at most one of fuzzy, prefix, regex and wildcard")
    return on[0] if on else None


def normal_term(c: Compiler, analyzer: Analyzer, q: str) -> str:
    """The query as one term: the analyzer's filters, without its tokenizer."""
    key = ("normal", analyzer.name, q)
    return c.expanded(key, lambda: [analyzer.normal(c.spark, q)])[0]


def matching_terms(c: Compiler, f: Field, body: dict, q: str) -> tuple[str, object]:
    """What a term query stands for: ('terms', [(term, factor)]) or ('pattern', Java regular expression)."""
    mode = term_options(body)
    if mode in ("regex", "wildcard"):
        return "pattern", java(mode, q)
    term = normal_term(c, f.analyzer, q)
    if mode == "prefix":
        return "prefix", term
    if mode == "fuzzy":
        o = check_fuzzy(body["fuzzy"] if isinstance(body["fuzzy"], dict) else {}, (0, 1, 2))
        edits, prefix, most = o.get("maxEdits", 2), o.get("prefixLength", 0), o.get("maxExpansions", 256)
        key = (f.path, f.analyzer.name)
        found = c.expanded(("fuzzy", *key, term, edits, prefix, most), lambda: c.index.fuzzy_terms(c.columns[key], term, edits, prefix, most, c.base(c.bases[key]), c.stored(*key)))
        return "terms", [(t, 1 - d / max(1, min(len(t), len(term)))) for t, d in found]
    return "terms", [(term, 1.0)]


def term(c: Compiler, scope: Scope, body: dict) -> Row:
    only(body, "path! query! fuzzy prefix regex wildcard score", "term")
    term_options(body)
    rows = []
    for f, _ in fields(c, scope, body["path"]):
        for q in c.strings(body):
            kind, found = matching_terms(c, f, body, q)
            if kind == "terms":
                rows.append(f.term(found[0][0]) if found and term_options(body) is None else f.terms(found) if found else nothing())
            else:
                rows.append(Row(exists_like(f.tokens, found) if kind == "pattern" else starts_with(f.tokens, found), F.lit(1.0)))
    return apply_score(c, scope, c.either(rows), body.get("score"))


def starts_with(tokens: Column, head: str) -> Column:
    return F.exists(tokens, lambda t: t["term"].startswith(head))


def search(c: Compiler, scope: Scope, body: dict) -> Row:
    """The legacy operator: any term of the query, or a phrase, of which the last term may be a prefix."""
    only(body, "path! query! phrase score", "search")
    if "phrase" not in body:
        rows = [combine(c, [f.term(t) for t, _ in c.terms_of(a, q)], False) for f, a in fields(c, scope, body["path"]) for q in c.strings(body)]
        return apply_score(c, scope, c.either(rows), body.get("score"))
    o = only(body["phrase"], "slop prefix maxExpansions", "phrase")
    limit_error(o.get("slop", 0), 0, 100, "slop")
    limit_error(o.get("maxExpansions", 50), 0, 1000, "maxExpansions")
    rows = []
    for f, a in fields(c, scope, body["path"], True):
        for q in c.strings(body):
            terms = c.terms_of(a, q)
            if not terms:
                continue
            if not o.get("prefix"):
                rows.append(as_phrase(f, terms, o.get("slop", 0)))
                continue
            head, most = terms[-1][0], o.get("maxExpansions", 50)
            key = (f.path, f.analyzer.name)
            ends = c.expanded(("prefix", *key, head, most), lambda: c.index.expand_terms(c.columns[key], lambda t: t.startswith(head), most, c.base(c.bases[key]), c.stored(*key)) if most else [])
            rows.append(f.phrase([*[([t], p) for t, p in terms[:-1]], (ends, terms[-1][1])], o.get("slop", 0)) if ends else nothing())
    return apply_score(c, scope, c.either(rows), body.get("score"))


def strings_in(value: object, path: str = "") -> list[tuple[str, str]]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in strings_in(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for v in value for x in strings_in(v, path)]
    return [(path, value)] if isinstance(value, str) else []


def more_like_this(c: Compiler, scope: Scope, body: dict) -> Row:
    """The terms of example documents with the largest tf times idf (of those in two documents at least), any of them."""
    only(body, "like! score", "moreLikeThis")
    likes = body["like"] if isinstance(body["like"], list) else [body["like"]]
    need(likes and all(isinstance(x, dict) for x in likes), "like is a document or a list of documents")
    rows = []
    for like in likes:
        freqs: Counter = Counter()
        held: dict[tuple, Field] = {}
        for path, value in strings_in(like):
            d = c.index.kind(path, "string")
            for multi in [None, *(d or {}).get("multi", {})]:
                found = c.text_field(path, multi)
                if found is None:
                    continue
                f = held.setdefault((path, found[1].name), Field(c, scope, found[0], found[1], found[3]))
                for t, _ in c.terms_of(found[2], value):
                    freqs[path, f.analyzer.name, t] += 1
        ranked = []
        for (path, a), f in held.items():
            own = {t: n for (p, b, t), n in freqs.items() if (p, b) == (path, a)}
            n, _, dfs = c.counts(path, a, own)
            ranked += [(tf * scores.idf(n, dfs[t]), path, a, t) for t, tf in own.items() if c.dry or dfs[t] >= 2]
        best = sorted(ranked, key=lambda r: (-r[0], r[1:]))[:LIKE_TERMS]
        rows.append(c.either([held[p, a].term(t) for _, p, a, t in best]))
    return apply_score(c, scope, c.either(rows), body.get("score"))

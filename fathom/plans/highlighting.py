"""Highlights: the best passages of a field, cut into hits and the text between them.

It runs over result rows only (a top-k), as one Arrow UDF for each path.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.analysis import STANDARD, Analyzer, generated
from fathom.functions.distance import glob
from fathom.plans.compiler import Compiler, Scope
from fathom.plans.errors import need, only

KIND = "array<struct<path:string,texts:array<struct<value:string,type:string>>,score:double>>"
ARROW = pa.list_(pa.struct([("path", pa.string()), ("texts", pa.list_(pa.struct([("value", pa.string()), ("type", pa.string())]))), ("score", pa.float64())]))
SENTENCE = re.compile(r".*?(?:[.!?…。！？]+(?:\s+|\Z)|\n+|\Z)", re.S)
WORD = re.compile(r"\w+(?:[.'’]\w+)*")


def pieces(text: str, hits: list[tuple[int, int]]) -> list[dict]:
    """Overlapping and adjoining hits are one; what is between them is text."""
    merged: list[list[int]] = []
    for a, z in sorted(h for h in hits if h[0] < h[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    out, at = [], 0
    for a, z in merged:
        if at < a:
            out.append({"value": text[at:a], "type": "text"})
        out.append({"value": text[a:z], "type": "hit"})
        at = z
    if at < len(text):
        out.append({"value": text[at:], "type": "text"})
    return out


def passages(path: str, text: str, wanted: dict[str, str], patterns: list[str], normal: dict[str, str], most: int, chars: int) -> list[dict]:
    """Sentences with hits: scored by the rarity of what they hit and their length, best `most`, in page order."""
    found, text = [], text[:chars]
    rules = [re.compile(p) for p in patterns]
    for m in SENTENCE.finditer(text):
        sentence = m[0]
        if not sentence:
            continue
        hits, terms = [], {}
        for w in WORD.finditer(sentence):
            term = normal.get(w[0], w[0].lower())
            if term in wanted or any(r.match(term) for r in rules):
                hits.append(w.span())
                terms[term] = terms.get(term, 0) + 1
        if hits:
            score = math.fsum((1 + math.log(1 / 3 + n)) * (2.2 * n / (n + 1.2 * (0.25 + 0.75 * len(sentence) / 87))) for n in terms.values())
            found.append((score, m.start(), {"path": path, "texts": pieces(sentence, hits), "score": score}))
    best = sorted(found, key=lambda f: (-f[0], f[1]))[:most]
    return [f[2] for f in sorted(best, key=lambda f: f[1])]


def wanted_terms(c: Compiler, op: dict, path: str, analyzer: Analyzer) -> tuple[set[str], list[str]]:
    """Terms and term patterns that an operator looks for in a path; other operators have none."""
    terms: set[str] = set()
    patterns: list[str] = []

    def visit(o: dict) -> None:
        kind, body = next(iter(o.items()))
        if kind == "compound":
            for k in ("must", "should", "filter"):
                for x in body.get(k, []) if isinstance(body.get(k, []), list) else [body[k]]:
                    visit(x)
        elif kind == "span":
            spans(body)
        elif kind in ("text", "phrase", "search", "term", "autocomplete", "wildcard", "regex") and any(p == path for p, _ in c.paths(body["path"])):
            for q in c.strings(body):
                if kind == "wildcard" or body.get("wildcard") is True:
                    patterns.append(glob(q))
                elif kind == "regex" or body.get("regex") is True:
                    patterns.append(f"^(?:{q})$")
                elif kind == "autocomplete" or body.get("prefix") is True:
                    patterns.extend("^" + re.escape(t) for t, _ in c.terms_of(analyzer, q))
                elif "fuzzy" in body:
                    key = (path, analyzer.name)
                    option = body["fuzzy"] if isinstance(body["fuzzy"], dict) else {}
                    tokens = c.tokens(path, analyzer, Scope())
                    for t, _ in c.terms_of(analyzer, q):
                        args = (t, option.get("maxEdits", 2), option.get("prefixLength", 0), option.get("maxExpansions", 50))
                        terms.update(x for x, _ in c.expanded(("fuzzy", *key, *args), lambda a=args, s=tokens: c.index.fuzzy_terms(s, *a, base=c.docs())))
                else:
                    terms.update(t for t, _ in c.terms_of(analyzer, q))

    def spans(s: dict) -> None:
        kind, body = next(iter(s.items()))
        if kind == "term":
            visit({"term": body})
        else:
            for k in ("clauses", "operator", "big", "little", "include"):
                for x in body[k] if isinstance(body.get(k), list) else [body[k]] if k in body else []:
                    spans(x)

    visit(op)
    return terms, patterns


def highlight(c: Compiler, rows: DataFrame, op: dict, body: dict) -> tuple[DataFrame, Column]:
    """The result rows, with what the highlights need, and the column of highlights, by path."""
    only(body, "path! maxNumPassages maxCharsToExamine", "highlight")
    most, chars = body.get("maxNumPassages", 5), body.get("maxCharsToExamine", 500_000)
    need(most > 0 and chars > 0, "maxNumPassages and maxCharsToExamine must be positive")
    parts = []
    for path, multi in sorted(c.paths(body["path"], ("string", "autocomplete")), key=lambda p: p[0]):
        found = c.text_field(path, multi)
        if found is None:
            need(c.index.kind(path, "autocomplete"), f"{path} can't be highlighted")
            analyzer = c.d.analyzer_named((c.index.kind(path, "autocomplete") or {}).get("analyzer", c.d.analyzer))
        else:
            analyzer = found[1]
        terms, patterns = wanted_terms(c, op, path, analyzer)
        wanted = {t: t for t in terms}
        value = F.col(path).cast("array<string>") if c.index.is_array(path) else F.array(F.col(path).cast("string"))
        # A word is hit by what the analyzer makes of it: words and their terms come with the row.
        words = F.array_distinct(F.flatten(F.transform(F.filter(value, F.isnotnull), lambda v: F.regexp_extract_all(v, F.lit(STANDARD), F.lit(0)))))
        if analyzer.native:
            normal = F.transform(words, lambda w: F.struct(w.alias("w"), F.get(analyzer.tokens(w), F.lit(0))["term"].alias("t")))
        else:
            # Words as one text: positions say which term is whose.
            held = f"__hl_{len(parts)}"
            rows = generated(rows, f"{held}_w", words)
            rows = analyzer.added(rows, F.array_join(f"{held}_w", " "), f"{held}_t")
            normal = F.transform(f"{held}_w", _term_of(f"{held}_t"))
        parts.append((_udf(path, wanted, patterns, most, chars), value, normal))
    names = [f"__hl_{k}" for k in range(len(parts))]
    for name, (call, *given) in zip(names, parts, strict=True):
        for k, x in enumerate(given):
            rows = generated(rows, f"{name}_{k}", x)
        rows = rows.withColumn(name, call(*[F.col(f"{name}_{k}") for k in range(len(given))]))
    return rows, F.concat(*names) if len(names) > 1 else F.col(names[0])


def _term_of(tokens: str):
    return lambda w, k: F.struct(w.alias("w"), F.get(F.filter(F.col(tokens), lambda t: t["pos"] == k), F.lit(0))["term"].alias("t"))


def _udf(path: str, wanted: dict, patterns: list[str], most: int, chars: int):
    def run(values: pa.Array, normals: pa.Array) -> pa.Array:
        out = []
        for texts, pairs in zip(values.to_pylist(), normals.to_pylist(), strict=True):
            normal = {p["w"]: p["t"] or "" for p in pairs or ()}
            out.append([h for t in texts or () if t for h in passages(path, t, wanted, patterns, normal, most, chars)][:most])
        return pa.array(out, ARROW)

    return F.arrow_udf(run, KIND)

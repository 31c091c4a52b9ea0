"""Synonym collections: rows {mappingType, synonyms, input}."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from fathom.plans.errors import need

#: A synonym collection is a dictionary that people keep; one with more rows is refused, not cut.
MOST_ROWS = 100_000


def load(rows: DataFrame, analyze: Callable[[str], list[str]]) -> list[tuple[list[str], list[list[str]]]]:
    """(input terms, alternatives). Equivalent words stand for each other, explicit inputs for their synonyms only (which may name the input)."""
    names = [c for c in ("mappingType", "synonyms", "input") if c in rows.columns]
    held = rows.select(*names).limit(MOST_ROWS + 1).collect()
    need(len(held) <= MOST_ROWS, f"more than {MOST_ROWS} synonym rows")
    table: dict[tuple, list[list[str]]] = {}
    for r in held:
        kind = r["mappingType"]
        need(kind in ("equivalent", "explicit"), "mappingType is equivalent or explicit")
        need(r["synonyms"], "synonyms must not be empty")
        outs = [t for s in r["synonyms"] if (t := analyze(s))]
        if kind == "explicit":
            need("input" in names and r["input"], "explicit mappings need input")
            ins = [t for s in r["input"] if (t := analyze(s))]
        else:
            ins = outs
        for i in ins:
            own = table.setdefault(tuple(i), [])
            own.extend(o for o in outs if o not in own)
    return [(list(k), v) for k, v in sorted(table.items())]

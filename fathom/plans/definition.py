"""Index definitions: which field is indexed as what, by which analyzer."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from fathom.functions import analysis
from fathom.plans.errors import QueryError, need, only

TYPES = frozenset("autocomplete autoEmbedVector boolean date dateFacet document embeddedDocuments geo vector knnVector number numberFacet objectId sortableDateBetaV1 sortableNumberBetaV1 sortableStringBetaV1 string stringFacet token uuid".split())
DYNAMIC = ("boolean", "date", "number", "string", "document")
SORTABLE = frozenset("token number date uuid objectId boolean sortableDateBetaV1 sortableNumberBetaV1 sortableStringBetaV1".split())


def natural_types(kind: T.DataType) -> list[str]:
    """What dynamic mapping makes of a column's type; arrays are of their elements' type."""
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if isinstance(kind, T.StringType):
        return ["string"]
    if isinstance(kind, T.BooleanType):
        return ["boolean"]
    if isinstance(kind, T.NumericType):
        return ["number"]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return ["date"]
    if isinstance(kind, T.BinaryType):
        return ["objectId"]
    return ["document"] if isinstance(kind, T.StructType) else []


@dataclass
class IndexDefinition:
    """mappings {dynamic, fields}, analyzers, synonyms, storedSource, typeSets and index-wide options, as in the JSON form."""

    name: str = "default"
    fields: dict[str, list[dict]] = field(default_factory=dict)
    dynamic: Any = False
    analyzer: str = "lucene.standard"
    search_analyzer: str | None = None
    analyzers: dict[str, analysis.Analyzer] = field(default_factory=dict)
    synonyms: dict[str, dict] = field(default_factory=dict)
    stored_source: Any = False
    type_sets: dict[str, list[dict]] = field(default_factory=dict)
    partitions: int = 1
    sort: dict | None = None
    nested_root: str | None = None
    view: list[dict] = field(default_factory=list)
    type: str = "search"

    @classmethod
    def parse(cls, body: dict) -> IndexDefinition:
        only(body, "name type mappings! analyzer searchAnalyzer analyzers synonyms storedSource typeSets numPartitions sort view", "index")
        mappings = only(body["mappings"], "dynamic fields", "mappings")
        made = cls(
            body.get("name", "default"), {}, mappings.get("dynamic", False), body.get("analyzer", "lucene.standard"), body.get("searchAnalyzer"),
            {a["name"]: analysis.custom(a) for a in body.get("analyzers", ())}, {}, body.get("storedSource", False),
            {t["name"]: t["types"] for t in body.get("typeSets", ())}, body.get("numPartitions", 1), body.get("sort"), view=body.get("view", []),
        )
        need(made.partitions in (1, 2, 4, 8, 16, 32, 64), "numPartitions must be a power of 2 up to 64")
        for s in body.get("synonyms", ()):
            only(s, "name! source! analyzer!", "synonyms")
            made.synonyms[s["name"]] = s
        made._add(mappings.get("fields", {}), "")
        if made.stored_source not in (True, False):
            need(isinstance(made.stored_source, dict) and len(made.stored_source) == 1 and set(made.stored_source) <= {"include", "exclude"}, "storedSource is a boolean or has include or exclude")
        return made

    @classmethod
    def vector(cls, fields: list[dict], name: str = "default", nested_root: str | None = None, stored_source: Any = False) -> IndexDefinition:
        """The form of vector indexes: a list of fields of type vector, filter, text or autoEmbed."""
        made = cls(name, stored_source=stored_source, nested_root=nested_root, type="vectorSearch")
        for f in fields:
            need(f.get("type") in ("vector", "filter", "text", "autoEmbed", "embeddedDocuments"), "vector index fields are vector, filter, text, autoEmbed or embeddedDocuments")
            kind = {"filter": "filter", "autoEmbed": "autoEmbedVector"}.get(f["type"], f["type"])
            made.fields.setdefault(f["path"], []).append(check_field(f | {"type": kind} if kind != "filter" else f, f["path"]))
        return made

    def _add(self, fields: dict, prefix: str) -> None:
        for name, defs in fields.items():
            path = prefix + name
            for d in defs if isinstance(defs, list) else [defs]:
                self.fields.setdefault(path, []).append(check_field(d, path))
                if d["type"] in ("document", "embeddedDocuments"):
                    self._add(d.get("fields", {}), path + ".")

    def types_of(self, path: str, schema: T.StructType) -> list[dict]:
        """Definitions of a path: its own, else what the nearest configured ancestor or the root makes of it dynamically."""
        if path in self.fields:
            return self.fields[path]
        parts = path.split(".")
        dynamic = self.dynamic
        for k in range(len(parts) - 1, 0, -1):
            if (defs := self.fields.get(".".join(parts[:k]))) is not None:
                dynamic = next((d.get("dynamic", False) for d in defs if d["type"] in ("document", "embeddedDocuments")), False)
                break
        if not dynamic:
            return []
        kind = type_at(schema, path)
        if kind is None:
            return []
        natural = natural_types(kind)
        if isinstance(dynamic, dict):
            return [t for t in self.type_sets[dynamic["typeSet"]] if t["type"] in natural or t["type"] in ("token", "autocomplete", "stringFacet") and "string" in natural or t["type"] == "numberFacet" and "number" in natural]
        return [{"type": t} for t in natural]

    def get(self, path: str, kind: str, schema: T.StructType) -> dict | None:
        return next((d for d in self.types_of(path, schema) if d["type"] == kind), None)

    def analyzer_named(self, name: str) -> analysis.Analyzer:
        found = self.analyzers.get(name) or analysis.STOCK.get(name)
        if found is None:
            raise QueryError(f"unknown analyzer {name}")
        return found

    def index_analyzer(self, d: dict) -> analysis.Analyzer:
        base = self.analyzer_named(d.get("analyzer", self.analyzer))
        if d["type"] == "autocomplete":
            return analysis.autocomplete(base, d.get("tokenization", "edgeGram"), d.get("minGrams", 2), d.get("maxGrams", 15), d.get("foldDiacritics", True))
        return base

    def query_analyzer(self, d: dict) -> analysis.Analyzer:
        return self.analyzer_named(d.get("searchAnalyzer") or d.get("analyzer") or self.search_analyzer or self.analyzer)

    def embedded_roots(self) -> list[str]:
        return sorted((p for p, ds in self.fields.items() if any(d["type"] == "embeddedDocuments" for d in ds)), key=lambda p: (p.count("."), p))


def check_field(d: dict, path: str) -> dict:
    """A field definition with its values checked; multi analyzers become definitions of their own kind at query time."""
    need(isinstance(d, dict) and ("type" in d), f"{path}: type is required")
    kind = d["type"]
    need(kind in TYPES or kind in ("filter", "text", "autoEmbed"), f"{path}: unknown type {kind}")
    if kind == "number":
        need(d.get("representation", "double") in ("double", "int64"), f"{path}: representation is double or int64")
        need(d.get("indexDoubles", True) or d.get("indexIntegers", True), f"{path}: indexes neither integers nor doubles")
    if kind == "token":
        need(d.get("normalizer", "none") in ("none", "lowercase"), f"{path}: normalizer is none or lowercase")
    if kind == "string":
        need(d.get("similarity", {}).get("type", "bm25") in ("bm25", "stableTfl", "boolean"), f"{path}: unknown similarity")
        need(d.get("indexOptions", "offsets") in ("docs", "freqs", "positions", "offsets"), f"{path}: unknown indexOptions")
    if kind == "autocomplete":
        need(d.get("tokenization", "edgeGram") in ("edgeGram", "rightEdgeGram", "nGram"), f"{path}: unknown tokenization")
        need(1 <= d.get("minGrams", 2) <= d.get("maxGrams", 15), f"{path}: minGrams is at most maxGrams")
    if kind in ("vector", "knnVector"):
        n = d.get("numDimensions", d.get("dimensions"))
        need(isinstance(n, int) and 1 <= n <= 8192, f"{path}: numDimensions is 1 to 8192")
        need(d.get("similarity") in ("euclidean", "cosine", "dotProduct"), f"{path}: similarity is euclidean, cosine or dotProduct")
        need(d.get("quantization", "none") in ("none", "scalar", "binary"), f"{path}: unknown quantization")
        need(d.get("indexingMethod", "hnsw") in ("hnsw", "flat"), f"{path}: unknown indexingMethod")
    return d


def type_at(schema: T.DataType, path: str) -> T.DataType | None:
    """The type of a dotted path, through arrays of structs; None if there is no such field."""
    kind: T.DataType = schema
    for part in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def leaf_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Dotted paths of all fields that hold values."""
    while isinstance(schema, T.ArrayType):
        schema = schema.elementType
    if not isinstance(schema, T.StructType):
        return [prefix.rstrip(".")]
    return [p for f in schema for p in leaf_paths(f.dataType, f"{prefix}{f.name}.")]

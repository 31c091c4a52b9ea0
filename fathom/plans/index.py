"""A search index: a DataFrame of documents, its definition, analysed columns and corpus statistics.

Analysed text is an array column beside its field, so positions, frequencies and lengths are row-local: operators
need neither a join nor a shuffle. Statistics (document counts, lengths, document frequencies of a query's terms)
come from one aggregation with a partial result in each task; vocabularies only where a query expands terms.
A written index keeps the arrays in Parquet and prunes columns that a query doesn't name. Beside them it has postings
(blocks of a term's places in some documents, sorted by field and term in each file), a table of terms with their counts,
and the fields' totals: a query for terms that aren't too frequent reads only their postings, and its statistics are
look-ups. Frequent terms are looked for in the arrays: most documents have them, and a join would cost more than the scan.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import analysis
from fathom.functions.distance import osa
from fathom.plans.definition import IndexDefinition, leaf_paths, type_at
from fathom.plans.errors import need
from fathom.plans.lists import LEAST_LISTS, Lists, fitted, list_of


#: Columns that an index adds to its documents.
OWN = ("__tok_", "__len_", "__docrow", "__list")
#: A block: where a term stands in some documents, their rows less a base; the numbers of these documents and of places.
POSTINGS = "term string, df long, n long, base long, rows array<int>, places array<int>, field string"
#: Tokens of a block at most, and the rows that its base reaches.
BLOCK_TOKENS, BLOCK_ROWS = 1 << 21, 1 << 31
LISTS = "field string, number int, centroid array<double>, n long, cosine boolean"
#: Parquet options of postings: whole numbers as differences, not from a dictionary.
DELTAS = {"parquet.writer.version": "PARQUET_2_0"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("rows.list.element", "places.list.element", "df", "n", "base")}
#: Hits of a query that are broadcast: at most so many bytes, by the term table's counts and HIT_BYTES for each.
BROADCAST_HITS, HIT_BYTES = 64 << 20, 64


def token_column(path: str, analyzer: str) -> str:
    return "__tok_" + "".join(c if c.isalnum() else "_" for c in f"{path}__{analyzer}")


def hits_column(stored: str) -> str:
    return stored.replace("__tok_", "__hit_", 1)


def length_column(stored: str) -> str:
    return stored.replace("__tok_", "__len_", 1)


class SearchIndex:
    """documents by id_col, indexed by a definition. field_names_col, if there is one, is an array of the paths that are
    present in each document: it tells explicit nulls from missing fields, which fixed schemas don't."""

    def __init__(self, docs: DataFrame, definition: IndexDefinition | dict | None = None, id_col: str = "_id", field_names_col: str | None = None, synonyms: dict[str, DataFrame] | None = None) -> None:
        self.definition = definition if isinstance(definition, IndexDefinition) else IndexDefinition.parse(definition or {"mappings": {"dynamic": True}})
        if self.definition.view:
            from fathom.sources.views import apply_view

            docs = apply_view(docs, self.definition.view)
        need(id_col in docs.columns, f"no column {id_col}")
        self.docs, self.id_col, self.field_names_col = docs, id_col, field_names_col
        self.schema: T.StructType = docs.schema
        self.spark: SparkSession = docs.sparkSession
        self.synonym_rows = synonyms or {}
        self.path: str | None = None
        self.postings: DataFrame | None = None
        self.terms: DataFrame | None = None
        self.totals: DataFrame | None = None
        self.lists: dict[str, Lists] = {}
        self._stats: dict = {}
        self._occurrences: dict[tuple[str, str], int] = {}
        self._frequencies: dict[tuple[str, str], int] = {}
        self._synonyms: dict[str, list] = {}
        self.ready = {c for c in docs.columns if c.startswith("__tok_")}

    # Fields

    def kind(self, path: str, *kinds: str) -> dict | None:
        return next((d for k in kinds if (d := self.definition.get(path, k, self.schema))), None)

    def string_field(self, path: str, multi: str | None = None) -> dict | None:
        d = self.kind(path, "string")
        if d and multi:
            need(multi in d.get("multi", {}), f"{path} has no multi {multi}")
            return d | d["multi"][multi] | {"type": "string"}
        return d

    def paths(self) -> list[str]:
        every = dict.fromkeys([*self.definition.fields, *leaf_paths(self.schema)])
        return [p for p in every if not p.startswith(OWN)]

    def value(self, path: str) -> Column:
        need(type_at(self.schema, path) is not None, f"no field {path}")
        return F.col(path)

    def is_array(self, path: str, base: T.DataType | None = None) -> bool:
        """Whether a path has several values in a row: it or a part of it is an array."""
        kind: T.DataType = base or self.schema
        for part in path.split("."):
            if isinstance(kind, T.ArrayType):
                return True
            kind = kind[part].dataType if isinstance(kind, T.StructType) and part in kind.names else T.NullType()
        return isinstance(kind, T.ArrayType)

    def fields_analysed(self) -> dict[str, tuple[Column, bool, analysis.Analyzer]]:
        """What the array columns are made of (value, whether it is an array, analyzer), of all string and autocomplete fields of a fixed path outside of embedded documents."""
        roots = self.definition.embedded_roots()
        out = {}
        for path in self.paths():
            if any(path.startswith(r + ".") for r in roots) or type_at(self.schema, path) is None:
                continue
            for d in self.definition.types_of(path, self.schema):
                if d["type"] in ("string", "autocomplete"):
                    for one in [d, *[d | m | {"type": "string"} for m in d.get("multi", {}).values()]]:
                        a = self.definition.index_analyzer(one)
                        out[token_column(path, a.name)] = (self.value(path), self.is_array(path), a)
        return out

    def materialized(self) -> SearchIndex:
        """The same index with its analysed arrays as columns (lazily, in the plan)."""
        new = {c: x for c, x in self.fields_analysed().items() if c not in self.ready}
        made = SearchIndex(analysed(self.docs, new), self._plain(), self.id_col, self.field_names_col, self.synonym_rows)
        made.schema = T.StructType([f for f in made.schema if not f.name.startswith("__tok_")])
        return made

    def _plain(self) -> IndexDefinition:
        """The definition without its view, which self.docs has been through."""
        return replace(self.definition, view=[])

    def write(self, path: str, mode: str = "overwrite") -> SearchIndex:
        """Writes documents and analysed arrays, hash-partitioned by id if there are several partitions, with an index sort sorted within files.

        A table of fewer input splits than the session has cores is dealt out before its texts are analysed.
        """
        docs, cores = self.docs, self.spark.sparkContext.defaultParallelism
        # What a shuffle made is dealt out already; asking for its partitions would run it once more.
        dealt = "Exchange" in docs._jdf.queryExecution().executedPlan().toString()
        n = self.definition.partitions if self.definition.partitions > 1 else cores if not dealt and docs.rdd.getNumPartitions() < cores else 0
        listed = self._listed()
        if listed:
            field, centroids, cosine = listed
            docs = docs.withColumn("__list", list_of(F.col(field), centroids, cosine))
            docs = docs.repartitionByRange(n or docs.rdd.getNumPartitions(), "__list", self.id_col).sortWithinPartitions("__list")
        elif n:
            docs = docs.repartition(n, self.id_col)
        df = SearchIndex(docs, self._plain(), self.id_col, self.field_names_col, self.synonym_rows).materialized().docs
        if self.definition.sort:
            df = df.sortWithinPartitions(*[F.col(p).asc_nulls_first() if (o if isinstance(o, int) else o.get("order", 1)) == 1 else F.col(p).desc_nulls_last() for p, o in self.definition.sort.items()])
        df = df.select("*", *[F.size(c).alias(length_column(c)) for c in df.columns if c.startswith("__tok_")], F.monotonically_increasing_id().alias("__docrow"))
        # Places are all different: looking them up in a dictionary takes longer, to write and to read, than their bytes.
        spelled = {f"parquet.enable.dictionary#{c}.list.element.pos": "false" for c in df.columns if c.startswith("__tok_")}
        df.write.mode(mode).options(**spelled).parquet(path)
        self._write_postings(path)
        if listed:
            sizes = {r["__list"]: r["n"] for r in self.spark.read.parquet(path).where("__list IS NOT NULL").groupBy("__list").agg(F.count("*").alias("n")).collect()}  # a row for each list
            rows = [(field, k, x.tolist(), sizes.get(k, 0), cosine) for k, x in enumerate(centroids)]
            self.spark.createDataFrame(rows, LISTS).coalesce(1).write.parquet(f"{path}/_lists")
        return SearchIndex.open(self.spark, path, self._plain(), self.id_col, self.field_names_col, self.synonym_rows)

    def _listed(self) -> tuple[str, np.ndarray, bool] | None:
        """The field, centroids and whether they are of unit vectors, of a vector index of one plain field without quantisation and sort; others have no lists."""
        found = [(p, d) for p, ds in self.definition.fields.items() for d in ds if d["type"] == "vector" and isinstance(type_at(self.schema, p), T.ArrayType)]
        if self.definition.type != "vectorSearch" or self.definition.sort or self.definition.nested_root or len(found) != 1 or "." in found[0][0] or found[0][1].get("indexingMethod") == "flat":
            return None
        (path, d), n = found[0], self.docs.count()
        cosine = d["similarity"] == "cosine"
        centroids = fitted(self.docs, path, d["numDimensions"], cosine, n)
        return (path, centroids, cosine) if len(centroids) > LEAST_LISTS else None

    def _write_postings(self, path: str) -> None:
        """Below the documents, in a folder that scans of these pass over: each task sorts blocks of postings by term, and no token is shuffled."""
        docs = self.spark.read.parquet(path)
        stored = [c for c in docs.columns if c.startswith("__tok_")]
        if not stored or len(docs.inputFiles()) == 0:
            return
        counted = {c for c, (_, several, analyzer) in self.fields_analysed().items() if analyzer.counted and not several}
        for c in stored:
            # Terms and places as two plain arrays: Arrow writes these faster than structs, and a sort by the term alone compares its first bytes.
            own = docs.select("__docrow", F.col(c)["term"].alias("term"), *([] if c in counted else [F.col(c)["pos"].alias("pos")]))
            blocks = own.mapInArrow(_inverted(c), POSTINGS).drop("field")
            blocks.sortWithinPartitions("term").write.options(**DELTAS).parquet(f"{path}/_postings/field={c}")
        terms = self.spark.read.schema(POSTINGS).parquet(f"{path}/_postings").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
        # Sorted as the aggregation deals them out: each file has a hash's share of the terms, and its statistics say where a term is.
        terms.sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{path}/_terms")
        lengths = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(length_column(c)).cast("long").alias("length")) for c in stored]))
        docs.select(lengths).where("length > 0").groupBy("field").agg(F.count("*").alias("n"), F.sum("length").alias("length")).coalesce(1).write.parquet(f"{path}/_totals")

    @classmethod
    def open(cls, spark: SparkSession, path: str, definition: IndexDefinition | dict, id_col: str = "_id", field_names_col: str | None = None, synonyms: dict[str, DataFrame] | None = None) -> SearchIndex:
        made = cls(spark.read.parquet(path), definition, id_col, field_names_col, synonyms)
        made.path = path
        made.schema = T.StructType([f for f in made.schema if not f.name.startswith(OWN)])
        at = spark._jvm.org.apache.hadoop.fs.Path
        there = lambda name: at(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at(f"{path}/{name}/_SUCCESS"))
        if "__list" in made.docs.columns and there("_lists"):
            rows = sorted(spark.read.schema(LISTS).parquet(f"{path}/_lists").collect(), key=lambda r: r["number"])  # MOST_LISTS at most
            made.lists = {rows[0]["field"]: Lists("__list", np.array([r["centroid"] for r in rows]), np.array([r["n"] for r in rows]), rows[0]["cosine"])} if rows else {}
        if there("_totals"):
            made.postings = spark.read.schema(POSTINGS).parquet(f"{path}/_postings")
            made.terms = spark.read.schema("term string, df long, n long, field string").parquet(f"{path}/_terms")
            made.totals = spark.read.schema("field string, n long, length long").parquet(f"{path}/_totals")
        return made

    # Postings

    def posted(self, stored: str) -> bool:
        return self.postings is not None and stored in self.ready

    def few(self, sought: dict[str, set[str]]) -> bool:
        """Whether the hits of some terms, by the table of terms, are few enough to be broadcast."""
        self.load_terms({(c, t) for c, terms in sought.items() for t in terms if t})
        return sum(self._occurrences[c, t] for c, terms in sought.items() for t in terms if t) * HIT_BYTES <= BROADCAST_HITS

    def hits(self, sought: dict[str, set[str]]) -> DataFrame | None:
        """(__docrow, a column of hits for each field) of the documents that have some of the terms.

        Only the terms' ranges of the postings are read; each field's hits are sorted by position, as they are in the document.
        """
        named = {c: sorted(t for t in terms if t) for c, terms in sought.items() if any(terms)}
        if not named:
            return None
        some = self.postings.where(reduce(or_, [(F.col("field") == c) & F.col("term").isin(terms) for c, terms in named.items()]))
        some = some.select("field", "term", "base", F.inline(F.arrays_zip("rows", "places"))).select("field", "term", (F.col("base") + F.col("rows")).alias("__docrow"), F.col("places").alias("pos"))
        place = F.struct("pos", "term")
        sorted_hits = [F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == c, place) if len(named) > 1 else place)), lambda t: F.struct(t["term"].alias("term"), t["pos"].alias("pos"))).alias(hits_column(c)) for c in named]
        return some.groupBy("__docrow").agg(*sorted_hits)

    def load_terms(self, wanted: set[tuple[str, str]]) -> None:
        """Document frequency and occurrences of (field, term): a look-up in the sorted table of terms."""
        missing = {w for w in wanted if w not in self._occurrences}
        if missing:
            by_field: dict[str, list[str]] = defaultdict(list)
            for c, t in sorted(missing):
                by_field[c].append(t)
            rows = self.terms.where(reduce(or_, [(F.col("field") == c) & F.col("term").isin(ts) for c, ts in by_field.items()])).collect()
            held = {(r["field"], r["term"]): (r["df"], r["n"]) for r in rows}
            for w in missing:
                self._frequencies[w], self._occurrences[w] = held.get(w, (0, 0))

    # Statistics

    def load_stats(self, wanted: set[tuple[str, str, str]], columns: dict[tuple[str, str], Column], base: DataFrame) -> None:
        """Counts for the (path, analyzer, term) wanted: one scan, a row back for each. Term "" asks for the field's counts only.

        Of each row come the wanted terms that it has (found by one pass over its tokens, however many are wanted) and
        its length; each task sums them before anything is shuffled.
        """
        missing = {w for w in wanted if w not in self._stats}
        posted = {w for w in missing if self.posted(token_column(*w[:2]))}
        if posted:
            self.load_terms({(token_column(p, a), t) for p, a, t in posted if t})
            totals = {r["field"]: (r["n"], r["length"]) for r in self.totals.collect()}  # a row for each field of the definition
            for p, a, t in posted:
                self._stats[p, a, t] = self._frequencies[token_column(p, a), t] if t else totals.get(token_column(p, a), (0, 0))
        missing -= posted
        if not missing:
            return
        by_field: dict[tuple[str, str], list[str]] = defaultdict(list)
        for path, analyzer, term in sorted(missing):
            by_field[path, analyzer].append(term)
        counts = []
        for n, (key, terms) in enumerate(by_field.items()):
            own, named = columns[key], [t for t in terms if t]
            found = F.array(_counted(n, F.lit(""), F.size(own)))
            if named:
                there = F.array_intersect(F.transform(own, lambda t: t["term"]), F.array(*map(F.lit, named)))
                found = F.concat(found, _each_counted(n, there))
            counts.append(F.when(F.size(own) > 0, found))
        none = F.expr("array()").cast("array<struct<f:int,term:string,length:bigint>>")
        every = F.concat(*[F.coalesce(c, none) for c in counts])
        rows = base.select(F.inline(every)).groupBy("f", "term").agg(F.count("*").alias("n"), F.sum("length").alias("length")).collect()
        held = {(r["f"], r["term"]): (r["n"], r["length"]) for r in rows}
        for n, (key, terms) in enumerate(by_field.items()):
            self._stats[key[0], key[1], ""] = held.get((n, ""), (0, 0))
            for term in terms:
                if term:
                    self._stats[key[0], key[1], term] = held.get((n, term), (0, 0))[0]

    def field_stats(self, path: str, analyzer: str) -> tuple[int, float]:
        """Documents that have the field, and the mean number of its terms."""
        n, total = self._stats[path, analyzer, ""]
        return n, (total / n if n else 1.0)

    def df(self, path: str, analyzer: str, term: str) -> int:
        return self._stats[path, analyzer, term]

    def vocabulary(self, tokens: Column, condition, base: DataFrame, stored: str | None = None) -> DataFrame:
        """(term, df) of the distinct terms that fulfil condition(Column): from the table of terms, else pruned within the rows and counted with a partial aggregation."""
        if stored and self.posted(stored):
            return self.terms.where((F.col("field") == stored) & condition(F.col("term"))).select("term", "df")
        distinct = F.array_distinct(F.transform(F.filter(tokens, lambda t: condition(t["term"])), lambda t: t["term"]))
        return base.select(F.explode(distinct).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def fuzzy_terms(self, tokens: Column, term: str, edits: int, prefix: int, most: int | None, base: DataFrame, stored: str | None = None) -> list[tuple[str, int]]:
        """Terms of the vocabulary within `edits` of a term, with their distance: nearest first, then in order, at most `most` (a limit of the query).

        A swap of neighbours counts once, which plain edit distance counts twice: twice the edits is the filter in
        the JVM; what passes is a few terms, of which the exact distance decides.
        """
        head = term[:prefix]
        near = lambda t: F.length(t).between(len(term) - edits, len(term) + edits) & (F.levenshtein(t, F.lit(term), 2 * edits) >= 0)
        condition = (lambda t: t.startswith(head) & near(t)) if head else near
        exact = F.arrow_udf(lambda ts: pa.array([osa(t, term, edits) for t in ts.to_pylist()], pa.int32()), "int")
        found = self.vocabulary(tokens, condition, base, stored).withColumn("d", exact("term")).where(F.col("d") <= edits).orderBy("d", "term")
        return [(r["term"], r["d"]) for r in (found.limit(most) if most is not None else found).collect()]

    def expand_terms(self, tokens: Column, condition, most: int | None, base: DataFrame, stored: str | None = None) -> list[str]:
        """Terms that fulfil a condition, in order, at most `most`."""
        found = self.vocabulary(tokens, condition, base, stored).select("term").orderBy("term")
        return [r["term"] for r in (found.limit(most) if most is not None else found).collect()]

    # Synonyms

    def refresh_synonyms(self, name: str, rows: DataFrame) -> None:
        """Takes a mapping's rows anew; queries that are compiled later have them."""
        need(name in self.definition.synonyms, f"no synonym mapping {name}")
        from fathom.sources.synonyms import load

        a = self.definition.analyzer_named(self.definition.synonyms[name]["analyzer"])
        self._synonyms[name] = load(rows, lambda text: [t for t, _ in a.analyze(self.spark, text)])

    def synonyms(self, name: str) -> list[tuple[list[str], list[str]]]:
        """(input, synonyms) pairs, analysed by the mapping's analyzer; a synonym collection is a small table."""
        from fathom.sources.synonyms import load

        need(name in self.definition.synonyms, f"no synonym mapping {name}")
        if name not in self._synonyms:
            spec = self.definition.synonyms[name]
            need(name in self.synonym_rows or spec["source"].get("collection") in self.synonym_rows, f"no rows for synonym mapping {name}")
            rows = self.synonym_rows.get(name, self.synonym_rows.get(spec["source"].get("collection")))
            a = self.definition.analyzer_named(spec["analyzer"])
            self._synonyms[name] = load(rows, lambda text: [t for t, _ in a.analyze(self.spark, text)])
        return self._synonyms[name]


def _inverted(field: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks of a field, of rows (__docrow, terms, places); without places terms are counted."""

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, terms, *places = batch.columns
        lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        pos = places[0].flatten() if places else pa.array(np.arange(starts[-1]) - np.repeat(starts[:-1], lengths), pa.int32())
        both = pa.StructArray.from_arrays([terms.flatten(), pos], ["term", "pos"])
        return pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), both)], ["__docrow", field])

    return lambda batches: _blocks(map(tokens, batches))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (__docrow, token arrays) inverted: a block for each term of a run of documents."""
    for batch in batches:
        rows = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for name in batch.schema.names[1:]:
            tokens = batch.column(name)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(rows):
                before = int(ends[at - 1]) if at else 0
                far = np.flatnonzero(np.abs(rows[at:] - rows[at]) >= BLOCK_ROWS)  # files of a scan come in any order
                end = min(max(int(np.searchsorted(ends, before + BLOCK_TOKENS, "right")), at + 1), at + int(far[0]) if len(far) else len(rows))
                if ends[end - 1] > before:
                    yield _block(name, rows[at:end], tokens.slice(at, end - at))
                at = end


def _block(field: str, rows: np.ndarray, tokens: pa.Array) -> pa.RecordBatch:
    flat = tokens.flatten()
    terms = pc.struct_field(flat, "term").dictionary_encode(null_encoding="encode")
    codes, n = terms.indices.to_numpy(), len(terms.dictionary)
    order = _by_code(codes, n)
    at = np.repeat((rows - rows[0]).astype(np.int32), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))[order]
    codes = codes[order]
    counts = np.bincount(codes, minlength=n)
    starts = np.concatenate([[0], np.cumsum(counts)])
    fresh = np.ones(len(codes), np.int64)  # the first place of a term in a document
    fresh[1:] = (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])
    lists = lambda x: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int32()))
    made = {
        "term": terms.dictionary, "df": pa.array(np.add.reduceat(fresh, starts[:-1]), pa.int64()), "n": pa.array(counts, pa.int64()), "base": pa.array(np.full(n, rows[0]), pa.int64()),
        "rows": lists(at), "places": lists(pc.struct_field(flat, "pos").to_numpy(zero_copy_only=False)[order]), "field": pa.array([field] * n, pa.string()),
    }
    return pa.RecordBatch.from_pydict(made)


def _by_code(codes: np.ndarray, n: int) -> np.ndarray:
    """A stable order by codes below n: numpy sorts 16 bits by their digits, so larger codes go in two steps."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    return order if n <= 1 << 16 else order[np.argsort((codes >> 16).astype(np.uint16)[order], kind="stable")]


def _counted(field: int, term: Column, length: Column) -> Column:
    return F.struct(F.lit(field).alias("f"), term.alias("term"), length.cast("long").alias("length"))


def _each_counted(field: int, terms: Column) -> Column:
    return F.transform(terms, lambda t: _counted(field, t, F.lit(0)))


def analysed(df: DataFrame, columns: dict[str, tuple[Column, bool, analysis.Analyzer]]) -> DataFrame:
    """df with token arrays as columns: those without steps in Python from one generator, the others after it. Plain words get their places in a second one."""
    words = {c: w for c, (value, several, analyzer) in columns.items() if not several and (w := analyzer.words(value)) is not None}
    native = [words.get(c, tokens_of(*x)).alias(c) for c, x in columns.items() if x[2].native]
    if native:
        df = df.select("*", F.inline(F.array(F.struct(*native))))
    if words:
        kept = [c for c in df.columns if c not in words]
        df = df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[analysis.placed(F.col(c)).alias(c) for c in words]))))
    for c, (value, several, analyzer) in columns.items():
        if not analyzer.native:
            df = analyzer.added(df, joined(value) if several else value, c)
    return df


def joined(values: Column) -> Column:
    """Python steps can't stand in a lambda: the values of an array are analysed as one text, apart from each other by line breaks."""
    return F.array_join(values.cast("array<string>"), "\n\n")


def tokens_of(value: Column, several: bool, analyzer: analysis.Analyzer) -> Column:
    if not several:
        return analyzer.tokens(value)
    if analyzer.native:
        each = F.transform(F.coalesce(value.cast("array<string>"), F.expr("array()").cast("array<string>")), lambda v, k: F.transform(analyzer.tokens(v), lambda t: F.struct(t["term"].alias("term"), (t["pos"] + k * 100_000).alias("pos"))))
        return F.flatten(each)
    return analyzer.tokens(joined(value))

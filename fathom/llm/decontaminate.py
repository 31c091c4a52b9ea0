"""Benchmark decontamination: a BM25 index of test items with block-max WAND, queried by every training passage.

The index holds the test items, in blocks: of each term, the largest impact in each block. A passage (a window of
words that overlaps the next by half) is a query of all its words; an item is retrieved when its BM25 score reaches a
part of the score that the item gets from itself. Impacts are divided by that self-score, so one threshold serves
all items, whatever slice of the benchmark they are in: document frequencies and the mean length are those of the
whole benchmark. Whole batches of passages are first held against the block maxima: rare words add what they can add at
most, frequent words what all of them together add to any item of a block. Only passages and blocks that may reach
the threshold are scored, by block-max WAND. What is retrieved is verified: words of the question and of the answer
must occur in the passage in the item's order, as runs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Part of an item's self-score from which it is retrieved; parts of question and answer words that must be met.
RETRIEVED, OVERLAP = 0.55, 0.8
#: Words that count as met stand in a run of RUN words, as in the item; an answer of fewer words, within NEAR words of what is met of the question.
RUN, NEAR = 3, 16
#: Items of a block; terms in more than FREQUENT of the items are frequent; a passage has this many words at least.
BLOCK, FREQUENT, LEAST_WINDOW = 8, 0.03, 64
#: Items of one index: larger benchmarks are taken in slices of so many, one after another; slices are bounded in memory. Results don't hang on it.
SLICE_ITEMS = 20_000
#: Words held against the index at a time.
BATCH_WORDS = 1 << 18
WORD = re.compile(r"\w+")
ANSWER_MARK = re.compile(r"(?i)\b(?:answer|antwort|respuesta|réponse)\s*:")
#: What ends before a colon and is a label, in lower case; no label with its spaces is longer than LABEL_MOST.
LABEL, LABEL_MOST = re.compile(r"(?<!\w)(?:question|answer|frage|antwort|pregunta|respuesta|réponse|solution|q|a)\s*\Z"), 24


def words_of(text: str | None) -> list[str]:
    """Words in lower case, without labels: what stands before the colon of "Answer:" is none."""
    text = (text or "").lower()
    if ":" in text:
        parts = text.split(":")
        for k, p in enumerate(parts[:-1]):
            if m := LABEL.search(p, max(0, len(p) - LABEL_MOST)):
                parts[k] = p[: m.start()]
        text = ":".join(parts)
    return WORD.findall(text)


def parts_of(text: str) -> tuple[list[str], int]:
    """The item's words without labels, and how many of them are the question's."""
    words, at = words_of(text), cut_of(text)
    k = len(words_of(text[:at]))
    return words, k if 0 < k < len(words) else -(-2 * len(words) // 3)


def cut_of(text: str) -> int:
    """Where the question ends and the answer begins, labels included; 0 if nothing shows it."""
    mark = ANSWER_MARK.search(text)
    cut = mark.start() if mark else text.rfind("?", 0, len(text.rstrip()) - 1) + 1
    if cut <= 0:
        ends = [m.end() for m in re.finditer(r"[.!?…](?=\s+\S)", text)]
        cut = ends[-1] if ends else 0
    return cut


def question_answer(text: str) -> tuple[int, int]:
    """How many words, labels included, the question has, and the whole item: the question ends at an answer mark, else at the last
    question mark that something follows, else before the last sentence; an item of one sentence has two thirds of its words as question."""
    n, k = len(WORD.findall(text.lower())), len(WORD.findall(text[: cut_of(text)].lower()))
    return (k if 0 < k < n else -(-2 * n // 3)), n


@dataclass
class Statistics:
    """What BM25 takes from the whole benchmark: the number of items, their words, and in how many items each word is."""

    n: int = 0
    n_words: int = 0
    df: Counter[str] = field(default_factory=Counter)

    def add(self, text: str) -> Statistics:
        if words := words_of(text):
            self.n, self.n_words = self.n + 1, self.n_words + len(words)
            self.df.update(set(words))
        return self


class Index:
    """Postings of the items' words, with impacts that are parts of each item's self-score."""

    def __init__(self, items: list[tuple[int, str]], k1: float = K1, b: float = B, whole: Statistics | None = None) -> None:
        kept = [(i, *parts_of(t), t) for i, t in items]
        kept = [x for x in kept if x[1]]
        self.ids, self.words, self.cuts = ([x[k] for x in kept] for k in range(3))
        if whole is None:
            whole = Statistics()
            for *_, t in kept:
                whole.add(t)
        n, average = len(kept), whole.n_words / max(1, whole.n)
        df = {w for ws in self.words for w in ws}
        idf = {w: math.log(1 + (whole.n - whole.df[w] + 0.5) / (whole.df[w] + 0.5)) for w in df}
        self.term = {w: k for k, w in enumerate(sorted(df))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for i, ws in enumerate(self.words):
            tf = Counter(ws)
            own = {w: idf[w] * f * (k1 + 1) / (f + k1 * (1 - b + b * len(ws) / average)) for w, f in tf.items()}
            own_score = math.fsum(own.values())
            for w, x in own.items():
                postings[self.term[w]].append((i, x / own_score))
        self.lists = [([p[0] for p in ps], [p[1] for p in ps]) for ps in postings]
        self.top = [max(p[1] for p in ps) for ps in postings]
        self.block_top = [self._blocks(ps) for ps in postings]
        self.n, self.n_blocks = n, -(-n // BLOCK)
        self.window = max(LEAST_WINDOW, max(map(len, self.words), default=0))
        # For the bounds of whole batches: rare terms as (block, largest impact) rows, frequent ones summed for each item.
        many = max(4.0, FREQUENT * n)
        self.rare = np.array([len(ps) <= many for ps in postings], bool)
        frequent = np.zeros(n)
        for t, ps in enumerate(postings):
            if not self.rare[t]:
                for i, x in ps:
                    frequent[i] += x
        self.frequent = np.array([frequent[k : k + BLOCK].max() for k in range(0, n, BLOCK)])
        self.first = np.zeros(len(postings) + 1, np.int64)
        blocks, tops = [], []
        for t in range(len(postings)):
            rows = sorted(self.block_top[t].items()) if self.rare[t] else []
            blocks += [r[0] for r in rows]
            tops += [r[1] for r in rows]
            self.first[t + 1] = len(blocks)
        self.row_block, self.row_top = np.array(blocks, np.int64), np.array(tops)

    @staticmethod
    def _blocks(postings: list[tuple[int, float]]) -> dict[int, float]:
        tops: dict[int, float] = {}
        for i, x in postings:
            tops[i // BLOCK] = max(x, tops.get(i // BLOCK, 0.0))
        return tops

    def candidates(self, terms: np.ndarray, least: float) -> set[tuple[int, int]]:
        """(passage, block) pairs that may reach `least`, of a stream of term numbers (-1: not in any item) cut every `window` words."""
        at = np.flatnonzero(terms >= 0)
        own = terms[at]
        keep = self.rare[own]
        at, own = at[keep], own[keep]
        passage = at // self.window
        # Passage k is of the windows k and k + 1: what stands in window k also counts for passage k - 1.
        passage = np.concatenate((passage, passage - 1))
        own = np.concatenate((own, own))
        keep = passage >= 0
        pair = np.unique(passage[keep] * len(self.term) + own[keep])
        passage, own = pair // len(self.term), pair % len(self.term)
        counts = self.first[own + 1] - self.first[own]
        rows = np.repeat(self.first[own], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        cell = np.repeat(passage, counts) * self.n_blocks + self.row_block[rows]
        cells, where = np.unique(cell, return_inverse=True)
        bound = np.bincount(where, self.row_top[rows], len(cells)) + self.frequent[cells % self.n_blocks]
        met = {(int(c) // self.n_blocks, int(c) % self.n_blocks) for c in cells[bound >= least - 1e-9]}
        # Blocks that frequent words alone may lift over the threshold are candidates of every passage.
        always = np.flatnonzero(self.frequent >= least - 1e-9).tolist()
        if always and len(terms):
            met |= {(p, k) for p in range(-(-len(terms) // self.window)) for k in always}
        return met

    def search(self, terms: list[int], least: float, blocks: set[int] | None = None) -> list[tuple[int, float]]:
        """(item, score) of all items that reach `least`, by block-max WAND; of the given blocks if there are any given."""
        terms = sorted(set(terms))
        if blocks is None:
            lists = [[*self.lists[t], 0, self.top[t], self.block_top[t]] for t in terms]
        else:
            # The block maxima of the passage's own words leave few of the blocks; of the postings, only those are read.
            tops = [self.block_top[t] for t in terms]
            blocks = {k for k in blocks if sum(x.get(k, 0.0) for x in tops) >= least - 1e-9}
            lists = []
            for t in terms if blocks else ():
                items, impacts = self.lists[t]
                own = [(bisect_left(items, k * BLOCK), bisect_left(items, (k + 1) * BLOCK)) for k in sorted(blocks) if k in self.block_top[t]]
                if own:
                    lists.append([[i for a, z in own for i in items[a:z]], [x for a, z in own for x in impacts[a:z]], 0, self.top[t], self.block_top[t]])
        found: list[tuple[int, float]] = []
        order = sorted(range(len(lists)), key=lambda k: lists[k][0][0])

        def skip(k: int, to: int) -> None:
            items, at = lists[k][0], lists[k][2]
            step = 1
            while at + step < len(items) and items[at + step] < to:
                step *= 2
            low, high = at + step // 2, min(at + step, len(items))
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if items[mid] < to else (low, mid)
            lists[k][2] = low

        while order:
            total, pivot = 0.0, -1
            for p, k in enumerate(order):
                total += lists[k][3]
                if total >= least - 1e-9:
                    pivot = p
                    break
            if pivot < 0:
                break
            item = lists[order[pivot]][0][lists[order[pivot]][2]]
            while pivot + 1 < len(order) and lists[order[pivot + 1]][0][lists[order[pivot + 1]][2]] == item:
                pivot += 1
            block = item // BLOCK
            bound = sum(lists[k][4].get(block, 0.0) for k in order[: pivot + 1])
            if bound < least - 1e-9:
                # No item of this block, up to the next list's, can reach the threshold.
                to = (block + 1) * BLOCK
                if pivot + 1 < len(order):
                    to = min(to, lists[order[pivot + 1]][0][lists[order[pivot + 1]][2]])
                moved = order[: pivot + 1]
                for k in moved:
                    skip(k, max(to, item + 1))
            elif lists[order[0]][0][lists[order[0]][2]] == item:
                score = 0.0
                moved = order[: pivot + 1]
                for k in moved:
                    score += lists[k][1][lists[k][2]]
                    lists[k][2] += 1
                if score >= least - 1e-9:
                    found.append((item, score))
            else:
                moved = [k for k in order[: pivot + 1] if lists[k][0][lists[k][2]] < item]
                for k in moved:
                    skip(k, item)
            order = sorted((k for k in order if lists[k][2] < len(lists[k][0])), key=lambda k: lists[k][0][lists[k][2]])
        return found

    def overlap(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Parts of the item's question and answer words that stand in the passage in a run of RUN words of the item.

        Fewer than RUN words of an answer are met, all of them, if they follow each other within NEAR words of the
        stretch of the passage that has the question's runs.
        """
        ws, cut = self.words[item], self.cuts[item]
        run = min(RUN, len(ws))
        there: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for k in range(len(passage) - run + 1):
            there[tuple(passage[k : k + run])].append(k)
        met = [False] * len(ws)
        places: list[int] = []
        for k in range(len(ws) - run + 1):
            if at := there.get(tuple(ws[k : k + run])):
                met[k : k + run] = [True] * run
                if k < cut:
                    places += at
        answer = ws[cut:]
        if 0 < len(answer) < run and not all(met[cut:]) and places:
            m = len(answer)
            close = set()
            for k in places:
                close.update(range(max(0, k - NEAR - m), min(len(passage), k + run + NEAR) + 1))
            if any(passage[k : k + m] == answer for k in close):
                met[cut:] = [True] * m
        return sum(met[:cut]) / cut, sum(met[cut:]) / len(answer) if answer else 1.0

    def leaks(self, docs: list[list[str]], least: float = RETRIEVED, overlap: float = OVERLAP) -> Iterator[tuple[int, int, float, float, float]]:
        """(document, item, score, question overlap, answer overlap): of each document and item, the passage with the largest score that is verified."""
        # Documents follow each other at multiples of the window, so that no passage has words of two.
        sizes = [-(-len(d) // self.window) for d in docs]
        start = np.concatenate(([0], np.cumsum([s + 1 for s in sizes])))
        terms = np.full(int(start[-1]) * self.window, -1, np.int64)
        get = self.term.get
        for d, s in zip(docs, start.tolist(), strict=False):
            terms[s * self.window : s * self.window + len(d)] = [get(w, -1) for w in d]
        by_passage: dict[int, set[int]] = defaultdict(set)
        for p, k in self.candidates(terms, least):
            by_passage[p].add(k)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p in sorted(by_passage):
            doc = int(np.searchsorted(start, p, "right")) - 1
            at = (p - int(start[doc])) * self.window
            passage = docs[doc][at : at + 2 * self.window] if doc < len(docs) else []
            own = [t for w in passage if (t := get(w, -1)) >= 0]
            for item, score in self.search(own, least, by_passage[p]):
                q, a = self.overlap(item, passage)
                if q >= overlap and a >= overlap and score > best.get((doc, item), (0.0,))[0]:
                    best[doc, item] = (score, q, a)
        for (doc, item), (score, q, a) in sorted(best.items()):
            yield doc, self.ids[item], score, q, a


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The test items (i, t); null ids and texts have no item."""
    return benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")


def slices(benchmark: DataFrame, id_col: str, text_col: str, items: int = SLICE_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The test items in slices of bounded size; a benchmark is a stated query set, of which all is used. Null ids and texts have no item."""
    held: list[tuple[int, str]] = []
    for r in items_of(benchmark, id_col, text_col).orderBy("i", "t").toLocalIterator():
        held.append((r["i"], r["t"]))
        if len(held) == items:
            yield held
            held = []
    if held:
        yield held


def indexes(benchmark: DataFrame, id_col: str, text_col: str, items: int = SLICE_ITEMS) -> Iterator[list[Index]]:
    """For each slice its indexes, one for each power of two of the items' words, so that long items don't widen the passages of short ones.

    The benchmark's vocabulary (about 100 bytes a word) is held by the driver meanwhile.
    """
    whole = Statistics()
    for r in items_of(benchmark, id_col, text_col).select("t").toLocalIterator():
        whole.add(r["t"])
    for some in slices(benchmark, id_col, text_col, items):
        sizes: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for i, t in some:
            sizes[(max(LEAST_WINDOW, len(words_of(t))) - 1).bit_length()].append((i, t))
        yield [Index(own, whole=whole) for _, own in sorted(sizes.items())]


def batches_of_words(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[list[str]]]]:
    """ids and the words of their texts, in batches of about BATCH_WORDS words, of one text at least."""
    held, some, size = [], [], 0
    for i, text in zip(ids, texts, strict=True):
        some.append(words_of(text))
        held.append(i)
        size += len(some[-1])
        if size >= BATCH_WORDS:
            yield held, some
            held, some, size = [], [], 0
    if some:
        yield held, some


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = RETRIEVED, overlap: float = OVERLAP, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), a row for each row of docs and item that it holds.

    Null and empty texts hold nothing. Items without a word, and null ids or texts of items, match nothing; items
    that repeat an id or text are each found. Rows of docs that repeat an id are each looked at. Empty tables give an
    empty result; other columns are ignored. Scores are parts of the item's self-score, rounded to 6 places.
    """
    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    names, kinds = [c.split()[0] for c in schema.split(", ")], [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for held in map(sc.broadcast, indexes(benchmark, item_col, item_text_col, slice_items)):  # slice_items items at most

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, some in batches_of_words(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    out = [(ids[d], i, round(s, 6), round(q, 6), round(a, 6)) for index in held.value for d, i, s, q, a in index.leaks(some, least, overlap)]
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def holder(held, least: float, overlap: float) -> Callable:
    """A column function: does a text hold an item of the broadcast indexes?"""

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        found = np.zeros(len(texts), bool)
        for rows, some in batches_of_words(range(len(texts)), texts.to_pylist()):
            for index in held.value:
                for d, *_ in index.leaks(some, least, overlap):
                    found[rows[d]] = True
        return pa.array(found)

    return holds


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = RETRIEVED, overlap: float = OVERLAP, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """docs, all columns included, without the rows whose text holds an item: a filter over one scan, nothing is shuffled.

    Each row goes or stays by its own text, whatever its id; null and empty texts stay. Otherwise as leaks().
    """
    kept = docs
    for held in map(docs.sparkSession.sparkContext.broadcast, indexes(benchmark, item_col, item_text_col, slice_items)):
        kept = kept.where(~holder(held, least, overlap)(F.col(text_col).cast("string")))
    return kept


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE_SQL: dict[str, str] = {}

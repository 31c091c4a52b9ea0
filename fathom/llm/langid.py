"""Language ID by cross-parsing entropy.

Per language a suffix automaton of labelled text gives the longest match from any position. A text is parsed greedily
into such matches; the language that needs the fewest phrases per character wins. Each automaton becomes one table
from (state, symbol) to the next state, in which a failed step is the restart at the root with a mark in the top bit,
so a parse step is one look-up and many texts are parsed in lockstep, all languages at once. Texts are parsed in
segments of SEGMENT characters, each from the root: a boundary adds a phrase at most, the same for every language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled text to learn from: documents up to this many characters in total for each language; of one longer than LONGEST so many characters in a row.
TRAIN_CHARS, LONGEST = 24_000, 8_000
#: All languages together learn from this many characters, so that tables stay below 100 MB; more languages than MOST_LANGS are an error.
TRAIN_TOTAL, MOST_LANGS = 192_000, 200
SEGMENT = 512
#: Symbols: 0 a letter not seen in training, 1 anything that is no letter, 2 and up the letters seen in training (in lower case), the most frequent
#: first. Steps of symbols below SYMBOLS are in a table, those of the others (there are some where scripts mix, or are large) in a sorted list.
SYMBOLS = 64
UNDETERMINED = "und"
#: Phrases that a text may have beyond its language's limit: about those of an e-mail address or a key, which in a short text are much of it.
SPARE = 7
MARK = np.uint32(1 << 31)
#: Characters parsed in lockstep at a time, which bounds memory.
BATCH_CHARS = 1 << 21


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of the sequence; state 0 is the root."""
    link, length = [-1], [0]
    rows: list[dict[int, int]] = [{}]
    last = 0
    for s in symbols:
        cur = len(rows)
        rows.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and s not in rows[p]:
            rows[p][s] = cur
            p = link[p]
        if p != -1:
            q = rows[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(rows)
                rows.append(dict(rows[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and rows[p].get(s) == q:
                    rows[p][s] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return rows


def dense(rows: list[dict[int, int]], width: int) -> np.ndarray:
    """(states, width) transitions of the symbols below width, 0 (the root) where there is none."""
    nxt = np.zeros((len(rows), width), np.int32)
    for state, row in enumerate(rows):
        for s, t in row.items():
            if s < width:
                nxt[state, s] = t
    return nxt


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    return dense(automaton(symbols), width)


class Model:
    """Tables of all languages in one array; `roots` are the states in which texts begin."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.langs = sorted(samples)
        letters: dict[str, int] = {}
        for texts in samples.values():
            for t in texts:
                for c in t.lower():
                    if c.isalpha():
                        letters[c] = letters.get(c, 0) + 1
        ids = {c: i for i, c in enumerate(sorted(letters, key=lambda c: (-letters[c], c)), 2)}
        self.symbol = np.fromiter((ids.get(c.lower()[0], 0) if (c := chr(i)).isalpha() else 1 for i in range(0x110000)), np.int32, 0x110000)
        tables, roots, base = [], [], 0
        rare: dict[int, int] = {}
        for lang in self.langs:
            joined = np.concatenate([np.concatenate((self.encode(t), np.ones(1, np.int32))) for t in samples[lang]])
            rows = automaton(joined.tolist())
            table = dense(rows, SYMBOLS)
            # A step that fails begins a phrase at the root; a symbol that the language doesn't have is a phrase of its
            # own and leads to one more state, from which every step begins a phrase: there texts begin, too.
            void = base + len(table)
            start = np.where(table[0] > 0, table[0] + base, void).astype(np.uint32) | MARK
            tables += [np.where(table > 0, (table + base).astype(np.uint32), start), start[None, :]]
            if len(ids) + 2 > SYMBOLS:
                # A step that isn't in the list is that of the void state, or leads there.
                rare |= {(base + state) << 21 | s: base + t for state, row in enumerate(rows) for s, t in row.items() if s >= SYMBOLS}
                rare |= {void << 21 | s: (base + t) | int(MARK) for s, t in rows[0].items() if s >= SYMBOLS}
            roots.append(void)
            base = void + 1
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.uint32)
        self.roots = np.array(roots, np.uint32)
        self.rare_keys = np.array(sorted(rare), np.int64)
        self.rare_steps = np.array([rare[k] for k in self.rare_keys.tolist()], np.uint32)

    def rare(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """(languages, n) steps from states by symbols that are not in the table."""
        voids = np.broadcast_to(self.roots[:, None], states.shape)
        out = voids | MARK
        for at in (voids, states):
            keys = at.astype(np.int64) << 21 | symbols
            k = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
            out = np.where(self.rare_keys[k] == keys, self.rare_steps[k], out)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Symbols of the text; runs of what is no letter count as one white space. A letter not seen in training is a phrase in every language."""
        s = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return s[np.concatenate(([True], (s[1:] != 1) | (s[:-1] != 1)))] if len(s) else s

    def phrases(self, encoded: list[np.ndarray]) -> np.ndarray:
        """(texts, languages) phrases of each text, the last of each segment included."""
        return self.parse(encoded)[0]

    def parse(self, encoded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """phrases(), and the phrases of each text if each of its segments is parsed by the language that needs the fewest for it."""
        counts, least = np.zeros((len(encoded), len(self.langs)), np.int64), np.zeros(len(encoded), np.int64)
        sizes = np.array([len(e) for e in encoded], np.int64)
        n_seg = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(encoded)), n_seg)
        if not len(owner):
            return counts, least
        flat = np.zeros(int(n_seg.sum()) * SEGMENT, np.int32)
        at = np.concatenate(([0], np.cumsum(n_seg)[:-1])) * SEGMENT
        for a, e in zip(at.tolist(), encoded, strict=True):
            flat[a : a + len(e)] = e
        lengths = np.full(len(owner), SEGMENT, np.int64)
        ends = np.cumsum(n_seg) - 1
        has = n_seg > 0
        lengths[ends[has]] = sizes[has] - (n_seg[has] - 1) * SEGMENT
        order = np.argsort(-lengths, kind="stable")
        grid = np.ascontiguousarray(flat.reshape(-1, SEGMENT)[order].T)
        listed = grid >= SYMBOLS
        some = listed.any(axis=1)
        inside = np.where(listed, 0, grid).astype(np.uint8)
        alive = np.searchsorted(-lengths[order], -np.arange(SEGMENT), side="left")  # segments longer than k
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        breaks = np.zeros(state.shape, np.int64)
        for k in range(int(lengths.max())):
            n = int(alive[k])
            step = self.table[(state[:, :n] & ~MARK).astype(np.int64) * SYMBOLS + inside[k, :n]]
            if some[k]:
                at = np.flatnonzero(listed[k, :n])
                step[:, at] = self.rare(state[:, at] & ~MARK, grid[k, at])
            breaks[:, :n] += step >> np.uint32(31)
            state[:, :n] = step
        for lang in range(len(self.langs)):
            np.add.at(counts[:, lang], owner[order], breaks[lang])
        np.add.at(least, owner[order], breaks.min(axis=0))
        return counts, least

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, float]]:
        """(language, score, phrases per 100 symbols, those with the best language for each segment) of each text.

        score is the winner's share of exp(-20 * difference in phrases per symbol to the best); ties go to the first
        name in order.
        """
        if not self.langs:
            return [(UNDETERMINED, 0.0, 0.0, 0.0)] * len(texts)
        out: list[tuple[str, float, float, float]] = [(UNDETERMINED, 0.0, 0.0, 0.0)] * len(texts)
        some: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal some, held, size
            if not some:
                return
            counts, least = self.parse(held)
            sizes = np.array([len(e) for e in held])
            rate = counts / sizes[:, None]
            best = rate.argmin(axis=1)
            gap = np.exp(-20 * (rate - rate.min(axis=1, keepdims=True)))
            score = 1 / gap.sum(axis=1)
            for k, at in enumerate(some):
                out[at] = (self.langs[best[k]], round(float(score[k]), 6), round(float(rate[k, best[k]]) * 100, 3), round(float(least[k] / sizes[k]) * 100, 3))
            some, held, size = [], [], 0

        for at, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                e = self.encode(text)
                some.append(at)
                held.append(e)
                size += len(e)
                if size >= BATCH_CHARS:
                    flush()
        flush()
        return out


def in_fold(id_col: Column) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(labelled: DataFrame, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Labelled texts by language, in the order of their hash, up to TRAIN_CHARS characters for each.

    Of a long text LONGEST characters are taken, from a place that its hash names, so that each language is learned
    however long its texts are. The hashes below a limit are about twice as many different texts as are needed, however many rows there are; copies
    of a text are one.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    most = TRAIN_CHARS // 200
    rows = rows.withColumn("h", F.xxhash64("text"))
    place = F.pmod("h", F.greatest(F.length("text") - LONGEST, F.lit(0)) + 1).cast("int") + 1
    rows = rows.withColumn("text", F.when(F.length("text") > LONGEST, F.substr("text", place, F.lit(LONGEST))).otherwise(F.col("text")))
    seen = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(MOST_LANGS + 1).collect()
    if len(seen) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not seen:
        return {}
    chars = min(TRAIN_CHARS, TRAIN_TOTAL // len(seen))
    limits = F.create_map(*[F.lit(x) for r in seen for x in (r["lang"], 2.0 * most / r["n"])])
    chosen = rows.where((F.col("h").cast("double") + 2.0**63) / 2.0**64 <= limits[F.col("lang")]).groupBy("lang", "text").agg(F.min("h").alias("h"))
    out: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for r in chosen.select("lang", "text", "h").orderBy("lang", "h", "text").toLocalIterator():
        if sizes.get(r["lang"], 0) < chars:
            out.setdefault(r["lang"], []).append(r["text"])
            sizes[r["lang"]] = sizes.get(r["lang"], 0) + len(r["text"])
    return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    return Model(sample(labelled, text_col, lang_col))


def limits(samples: dict[str, list[str]], margin: float, least: float) -> dict[str, float]:
    """Per language the phrases per 100 symbols beyond which a text isn't explained by it, from texts held out of its sample.

    Each half of a language's texts is parsed by the other half alone (of a single text, its halves). The rate that nine
    tenths of them have at most (weighted by length; near copies in both halves have next to none) times margin is the
    limit, but at most halfway to 100, where each symbol is a phrase, and not below least. A language without a letter
    in either half has no limit.
    """
    out = {}
    for lang, texts in samples.items():
        halves = (texts[::2], texts[1::2]) if len(texts) > 1 else ([texts[0][: len(texts[0]) // 2]], [texts[0][len(texts[0]) // 2 :]])
        rates = []
        for one, other in (halves, halves[::-1]):
            if any(map(str.isalpha, "".join(one))):
                model = Model({lang: one})
                rates += [(rate, len(t)) for t, (found, _, rate, _) in zip(other, model.predict(other), strict=True) if found != UNDETERMINED]
        total, seen, high = sum(n for _, n in rates), 0, 100.0
        for rate, n in sorted(rates):
            seen += n
            if 10 * seen >= 9 * total:
                high = rate
                break
        out[lang] = max(least, min(high * margin, (high + 100) / 2))
    return out


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, rate (phrases per 100 symbols).

    Nulls, empty texts and texts without a letter are `und` with score 0. Ties go to the first name in order. An
    empty table gives an empty result; other columns are ignored; nothing but the text is an input.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAIN_CHARS: 2 states a character, 256 bytes a state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = held.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score", "rate"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rate double")


def filter_known(docs: DataFrame, model: Model, most_rate: float | dict[str, float], text_col: str = "text") -> DataFrame:
    """docs, all columns and repeated rows included, without texts that are undetermined or have more than most_rate phrases per 100 symbols.

    Each segment of a text counts with the language that explains it best, so texts in several learned languages stay.
    Given by language, most_rate is that of the predicted one, and SPARE phrases more are let through, which only matters to very short texts.
    Rows are judged where they are: no join, no shuffle. A model without languages keeps every text that has a letter.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def known(model: Model, text: str | None, lang: str, rate: float) -> bool:
        if lang == UNDETERMINED:
            return False
        if not isinstance(most_rate, dict):
            return rate <= most_rate
        return rate <= most_rate[lang] or rate <= most_rate[lang] + 100 * SPARE / len(model.encode(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            if held.value.langs:
                keep = [known(held.value, t, f[0], f[3]) for t, f in zip(texts, held.value.predict(texts), strict=True)]
            else:
                keep = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~in_fold(F.col("doc_id"))))
    return detect(docs, model).select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE_SQL: dict[str, str] = {}

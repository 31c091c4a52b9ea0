"""SimHash near-dedup by anchor-point covering.

The 64 bits are cut in two halves of 32. Two fingerprints that differ in at most 4 bits differ in at most 2 bits of
one half. Anchors are the words of a covering code on the half: the Hamming code of 31 bits (every word is within 1
bit of a code word, the covering radius) beside one bit that is kept. Of two halves at distance 2 or less a word in
the middle lies within 1 bit of both, and its nearest anchor within the covering radius more; so each half is
replicated to all anchors within covering radius plus half the threshold (17 of 2**27), and whoever is alike meets at
an anchor. There whole fingerprints are compared, and the links of an anchor are returned as a forest, so that many
near copies give as many links, not their square. An anchor with too many fingerprints for one task is cut into
blocks, each pair of which is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.components import components
from fathom.llm.shared import fresh, lookup, words_of, written

SHINGLE, BITS_APART, SEED = 4, 4, 42
#: Fingerprints of one anchor that a task compares with each other; more are cut into blocks of about this many.
BLOCK = 4096
#: Replicas that a task compares, about; linked fingerprints that it holds before it hands on their links.
TASK_ROWS, HELD_LINKS = 4_000_000, 1 << 18
#: Bytes of Arrow batches are bounded by the session's maxRecordsPerBatch; hashes are voted on in slices of so many.
SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles' XXH64; A-Z in lower case, words split at the six ASCII white-space characters."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
    digest, votes, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n - shingle + 1
    ends = ends[shingle - 1 :].tolist()
    for at in range(0, count, SLICE):
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[at : at + SLICE], ends[at : at + SLICE], strict=True)), np.uint64, min(SLICE, count - at))
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > count).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), b.column(2)], names=["doc_id", "fp", "digest"])


#: Columns of the parity check of the Hamming code: position p (1 to 31) has the bits of p.
_POSITION = np.arange(1, 32, dtype=np.uint32)
_MASK = np.uint32(0x7FFFFFFF)


def anchors(half: np.ndarray) -> np.ndarray:
    """(n, 17) anchors within covering radius plus 1 of 32-bit words: bits 0-30 in the Hamming code, bit 31 kept.

    The nearest anchor of x flips the position that the syndrome names. Flipping one more bit p first leads to the
    anchor at x + p + position(syndrome xor p): 15 more anchors, each met by two of the flips; and the kept bit's flip.
    """
    half = half.astype(np.uint32)
    syndrome = np.zeros(len(half), np.uint32)
    for p in _POSITION:
        syndrome ^= np.where((half >> np.uint32(p - 1)) & np.uint32(1), p, np.uint32(0)).astype(np.uint32)
    flip = lambda at: np.where(at > 0, np.uint32(1) << (np.maximum(at, 1) - 1).astype(np.uint32), np.uint32(0)).astype(np.uint32)
    near = half ^ flip(syndrome)
    every = [near, near ^ np.uint32(1 << 31)]
    others = half[:, None] ^ flip(_POSITION[None, :]) ^ flip(syndrome[:, None] ^ _POSITION[None, :])
    others = np.sort(others, axis=1)
    return np.concatenate([np.stack(every, axis=1), others], axis=1)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fp), SLICE):
            some = fp[at : at + SLICE]
            for side, half in enumerate((some >> np.uint64(32), some & np.uint64(0xFFFFFFFF))):
                near = anchors(half)
                first = np.ones(near.shape, bool)
                first[:, 3:] = near[:, 3:] != near[:, 2:-1]
                first[:, 2:] &= near[:, 2:] != near[:, :1]
                rows, cols = np.nonzero(first)
                key = near[rows, cols].astype(np.int64) | np.int64(side << 32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[rows].view(np.int64))], names=["anchor", "fp"])


class Forest:
    """Union-find over fingerprints; what it yields is one link from each member to its tree's first."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[y]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def _links(fp: np.ndarray, n_left: int, most: int) -> np.ndarray:
    """The tree of each row: its first row. Rows before n_left are compared with those after it, or all with all if n_left is their number.

    Labels are merged as arrays, so that a thousand near copies cost a thousand merges, not a million links.
    """
    label = np.arange(len(fp))
    right = 0 if n_left == len(fp) else n_left
    for p in range(n_left):
        at = max(right, p + 1)
        met = label[at:][np.bitwise_count(fp[at:] ^ fp[p]) <= most]
        for other in np.unique(met[met != label[p]]):
            a, b = sorted((int(other), int(label[p])))
            label[label == b] = a
    return label


def _compare(most: int):
    """Rows (anchor, i, j, block, fp) come sorted: those of a cell (anchor, i, j) are compared, block i with block j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None

        def cells(block: np.ndarray, fp: np.ndarray, starts: np.ndarray) -> None:
            whole, sizes = fp.view(np.uint64), np.diff(starts)
            two = starts[:-1][sizes == 2]
            two = two[np.bitwise_count(whole[two] ^ whole[two + 1]) <= most]
            for u, v in zip(fp[two].tolist(), fp[two + 1].tolist(), strict=True):
                forest.join(u, v)
            for at, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                n_left = n if block[at] == block[at + n - 1] else int(np.searchsorted(block[at : at + n], block[at], "right"))
                label = _links(whole[at : at + n], n_left, most)
                for k in np.flatnonzero(label != np.arange(n)).tolist():
                    forest.join(int(fp[at + k]), int(fp[at + label[k]]))

        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            anchor, i, j, block, fp = cols
            new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if len(new):
                cells(block, fp, np.concatenate(([0], new)))
                cols = [c[int(new[-1]) :] for c in cols]
            held = cols
            if len(forest.up) > HELD_LINKS:
                yield forest.links()
                forest.up.clear()
        if held is not None and len(held[0]):
            cells(held[3], held[4], np.array([0, len(held[4])]))
        yield forest.links()

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, digest): the fingerprint as a signed 64-bit number, and a hash of the text as it is, by which rows of one id are told apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), digest_of(F.col(text_col)).alias("digest"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long, digest long")


def digest_of(text: Column) -> Column:
    return F.xxhash64(words_of(text))


def near_links(fps: DataFrame, bits: int = BITS_APART, block: int = BLOCK) -> DataFrame:
    """(u, v): a forest that joins all distinct fingerprints fps(fp) at most `bits` (4 or fewer) apart."""
    if bits > 4:
        raise ValueError("halves and anchors are laid out for 4 bits at most")
    at = fps.select("fp").mapInArrow(_replicas, "anchor long, fp long")
    large = at.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > block)
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    cut = at.join(large, "anchor", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("fp"), F.col("blocks")))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 34 * fps.count() // TASK_ROWS)
    return cells.repartition(parts, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "block", "fp").mapInArrow(_compare(bits), "u long, v long")


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS_APART, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id.

    Null texts and texts without a word have fingerprint zero and are linked like any other. component_id is the
    smallest id reachable by links of `bits` or fewer differing bits; null ids are ignored in it unless a group has no
    other. Rows that repeat an id, ties and equal texts each keep their row; an empty table gives an empty result;
    other columns are ignored.
    """
    return classed(docs, id_col, text_col, bits, block).drop("digest")


def classed(docs: DataFrame, id_col: str, text_col: str, bits: int = BITS_APART, block: int = BLOCK) -> DataFrame:
    """near_dups() with the digest of each row's text."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    n = rows.count()
    fps = written(rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")), "distinct")
    roots = components(near_links(fps, bits, block)).withColumnRenamed("node", "fp")
    # Fingerprints without a link are their own component; those of one root share the smallest id.
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = rooted.where(F.col("root") != F.col("fp")).select("root").distinct()
    alone = rooted.join(linked, "root", "left_anti").select("fp", "copies", F.col("first_id").alias("component_id"))
    several = written(rooted.join(linked, "root", "left_semi"), "rooted")
    least = several.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    several = lookup(several, "root", least, "members", n).select("fp", "copies", "component_id")
    classes = written(alone.unionByName(several), "classes")
    return lookup(rows, "fp", classes, "copies", n).select("doc_id", "fp", "component_id", "digest")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component the document with the smallest id stays, with all its columns.

    Where rows of that id have several texts in the component, one text stays; rows that repeat both id and text stay or go
    together. A row that has the id of another component's document doesn't stay for that. Of a component without
    ids one text of each fingerprint stays.
    """
    found = classed(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    of, digest = fresh(docs, "__of", "__digest")
    least = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min("digest").alias(digest))
    kept = least.select(F.col("component_id").alias(of), digest).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(F.col(of)) & (digest_of(docs[text_col]) == F.col(digest)), "left_semi")


QUERIES = {"op6_simhash_near_dedup": op6_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}

"""Token-ID output: flat unsigned integer files plus 64-bit document offsets, read back memory-mapped.

Layout below one folder: tokens-<part>-<attempt>.bin holds the ids of a range of documents in ascending order, as
little-endian uint16 or uint32; offsets-<part>-<attempt>.idx holds the part's document offsets within it, as uint64, one more than
documents; the manifest (a Parquet table) names the files of the attempts that were committed. A part's base is the
prefix sum of the ids before it. An attempt that is lost leaves files that no manifest names.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.shared import parts_for, work_dir

END_ID = 2
#: Least input of a part (its sort spills where it must), and parts whose bases one task sums.
PART_MB, PARTS_SUMMED = 1024, 1000
#: Bytes of text encoded at a time, as whole documents; different pieces of which a Python worker keeps the ids: beyond that, those of the last slice stay.
SLICE_BYTES, REMEMBERED = 8 << 20, 800_000
#: Longer pieces are not kept.
LONG = 64
#: Latin letters: their runs, perhaps after a space, are units of byte-level pre-tokenizers, unless letters of other kinds or an apostrophe are beside them.
WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Class of each byte: a letter, anything else visible in ASCII but the apostrophe, a space, white space of one byte; 0 is beside no cut but that before a space.
LETTER, VISIBLE, SPACE, BREAK = 1, 2, 4, 8
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = VISIBLE
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CUT_BESIDE = np.isin(np.arange(9), (LETTER, VISIBLE))
CLASS[[39, 32, *range(9, 14)]] = [0, SPACE, *[BREAK] * 5]
#: White space (and, to be safe, other invisible characters) of three bytes in UTF-8; those of two bytes begin with 0xC2.
WIDE = ("\u1680", "\u180e", *map(chr, range(0x2000, 0x2010)), *map(chr, range(0x2028, 0x2030)), *map(chr, range(0x205F, 0x2070)), "\u3000", "\ufeff")
WIDE_BYTES = np.array([int.from_bytes(c.encode(), "big") for c in WIDE])


class PieceEncoder:
    """Encodes whole texts as the tokenizers library does, calling it once for each new piece of text.

    Byte-level BPE splits texts before it merges: always between something other than white space and a space, between
    letters and ASCII of another kind (but an apostrophe), and around a single line end or tab. There texts are cut,
    and the ids are those of the pieces in order. The pieces of a slice of texts are numbered by value, so that each
    different one is looked up once, and once encoded by the library while it is remembered. Texts that hold a special
    token, and those of other kinds of tokenizer, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cut = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.visible = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}
        del self.visible[10]  # stands between words

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(self, new: list[str]) -> None:
        """Adds the ids of pieces to those known. Words are what the library's pre-tokenizer makes of them: they go to its model."""
        known, tokenize, packed = self.known, self.model.tokenize, self.packed
        words = [p for p in new if WORD(p)]
        if len(words) < len(new):
            known.update((p, self.whole(p)) for p in new if not WORD(p))
        if words:
            for word, seen in zip(words, "\n".join(words).encode().decode("latin-1").translate(self.visible).split("\n"), strict=True):
                known[word] = packed([t.id for t in tokenize(seen)])

    def special_in(self, texts: pa.StringArray) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for t in self.special:
            found |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        return found

    def pieces(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """All pieces of the texts in order (views of the same bytes), and how many each text has."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets - offsets[0]
        begin = np.zeros(len(data) + 1, bool)
        if self.cut and len(data):
            kind = CLASS[data]
            latin = np.flatnonzero(data[:-1] == 0xC3)  # the first byte of a Latin-1 letter, or of a multiplication or division sign
            latin = latin[(data[latin + 1] & 0xDF) != 0x97]
            kind[latin] = kind[latin + 1] = LETTER
            begin[1:-1] = (kind[1:] | kind[:-1]) == LETTER | VISIBLE
            at = np.flatnonzero(kind[1:] == SPACE) + 1
            one = data[at - 1]
            keep = (one > 0x20) & (one != 0x7F)
            high = np.flatnonzero(one >= 0x80)
            if len(high):  # the last byte of a character of two bytes or more
                p = at[high]
                two, three = data[p - 2].astype(np.int64), data[np.maximum(p - 3, 0)].astype(np.int64)
                keep[high] = (two != 0xC2) & ~np.isin(three << 16 | two << 8 | one[high], WIDE_BYTES)
            begin[at[keep]] = True
            at = np.flatnonzero(kind[1:-1] == BREAK) + 1
            beside = CUT_BESIDE[kind]
            at = at[beside[at - 1] & beside[at + 1]]
            begin[at] = begin[at + 1] = True
        if self.cut:
            for k in np.flatnonzero(self.special_in(texts)).tolist():
                begin[starts[k] : starts[k + 1]] = False
        begin[starts] = True
        begin[-1] = False
        begins = np.flatnonzero(begin)
        ends = np.append(begins, len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(data)), np.diff(np.searchsorted(begins, starts))

    def flat(self, texts: pa.StringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each followed by end_id if there is one, and how many each text has."""
        pieces, counts = self.pieces(texts)
        numbered = pieces.dictionary_encode()
        codes, different = numbered.indices.to_numpy(), numbered.dictionary.to_pylist()
        if self.cut:
            special = np.flatnonzero(self.special_in(numbered.dictionary)).tolist()
            new = [p for p in different if p not in self.known]
            self.learn(new)
            self.known |= {different[k]: self.whole(different[k]) for k in special}
            held = list(map(self.known.__getitem__, different))
            for p in {p for p in new if len(p) > LONG} | {different[k] for k in special}:
                del self.known[p]
        else:
            held = [self.whole(t) for t in different]
        if end_id is not None:
            codes = np.insert(codes, np.cumsum(counts), len(held))
            held.append(self.packed([end_id]))
            counts = counts + 1
        if len(self.known) > REMEMBERED:
            self.known = {p: h for p, h in zip(different, held, strict=False) if len(p) <= LONG}
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // self.dtype.itemsize
        first = np.cumsum(sizes) - sizes
        n = sizes[codes]
        stop = np.concatenate(([0], np.cumsum(n)))
        ids = np.frombuffer(b"".join(held), self.dtype)[np.repeat(first[codes] - stop[:-1], n) + np.arange(int(stop[-1]))]
        return ids, np.diff(stop[np.concatenate(([0], np.cumsum(counts)))])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.flat(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker, which outlives tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def sliced(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """b in slices of about `most` bytes of its second column (a string), of one row at least."""
    if not b.num_rows:
        return
    at, ends = 0, np.frombuffer(b.column(1).buffers()[1], np.int32, b.num_rows + 1, 4 * b.column(1).offset)
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + most, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, part_mb: int = PART_MB) -> DataFrame:
    """Writes docs in ascending id order; returns the manifest (part, tokens_file, offsets_file, first_id, n_docs, n_tokens, bits).

    Null texts are empty: such a document is its end id alone. Null ids come first; rows that repeat an id each keep
    their own place, in no stated order among themselves. An empty table writes no files. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Rows of one id may be in several parts that follow each other: none is too large for a task.
    rows = rows.repartitionByRange(parts_for(rows, part_mb), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        name, ids, sizes, out = f"{part:06d}-{uuid.uuid4().hex}", [], [np.zeros(1, np.int64)], None
        for b in batches:
            for some in sliced(b, SLICE_BYTES):
                found, n = enc.flat(some.column(1), end_id)
                if out is None:
                    out = fs.open_output_stream(f"{root}/tokens-{name}.bin")
                out.write(found)
                sizes.append(n)
                ids.append(some.column(0).fill_null(-1).to_numpy())
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{root}/offsets-{name}.idx") as f:
            f.write(np.cumsum(np.concatenate(sizes)).astype("<u8").tobytes())
            f.write(np.concatenate(ids).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "tokens_file": f"tokens-{name}.bin", "offsets_file": f"offsets-{name}.idx", "n_docs": sum(map(len, ids)), "n_tokens": int(sum(n.sum() for n in sizes)), "bits": 8 * enc.dtype.itemsize}],
            schema=pa.schema([("part", pa.int32()), ("tokens_file", pa.string()), ("offsets_file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bits", pa.int32())]),
        )

    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    made = rows.mapInArrow(run, "part int, tokens_file string, offsets_file string, n_docs long, n_tokens long, bits int")
    made.write.parquet(f"{folder}/manifest")
    return spark.read.schema(made.schema).parquet(f"{folder}/manifest")


def based(manifest: DataFrame, summed: int = PARTS_SUMMED) -> DataFrame:
    """The manifest with each part's base, the ids before it: prefix sums within groups of `summed` parts, and over the groups' sums (a row for each group)."""
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = manifest.withColumn("of_group", F.floor(F.col("part") / summed))
    groups = grouped.groupBy("of_group").agg(F.sum("n_tokens").alias("n_tokens")).select("of_group", before(Window.orderBy("of_group")).alias("base"))
    within = grouped.withColumn("before", before(Window.partitionBy("of_group").orderBy("part")))
    return within.join(groups, "of_group").withColumn("base", F.col("base") + F.col("before")).drop("of_group", "before")


def _mapped(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """The file memory-mapped where it is on a mounted file system, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian uint32 bytes) of every document, from the files."""
    manifest = based(spark.read.parquet(f"{folder}/manifest"))
    parts = manifest.select("base", "tokens_file", "offsets_file", "n_docs", "n_tokens", "bits")
    return parts.repartition(parts_for(parts, 1), "tokens_file").mapInArrow(_reader(folder, False), "doc_id long, start long, n_tokens long, ids binary")


def _reader(folder: str, digest: bool):
    kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                ids = _mapped(fs, f"{root}/{r['tokens_file']}", f"<u{r['bits'] // 8}")
                index = _mapped(fs, f"{root}/{r['offsets_file']}", "<u8")
                offsets, names = index[: r["n_docs"] + 1].astype(np.int64), index[r["n_docs"] + 1 :].view("<i8")
                if len(ids) != r["n_tokens"] or len(names) != r["n_docs"] or offsets[-1] != r["n_tokens"]:
                    raise ValueError(f"{r['tokens_file']} is not whole")
                for at in range(0, r["n_docs"], 1000):
                    ends = offsets[at : at + 1001]
                    raw = [ids[a:z].astype("<u4").tobytes() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    last = [zlib.crc32(x) for x in raw] if digest else raw
                    yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 1000]), pa.array(ends[:-1] + r["base"]), pa.array(np.diff(ends)), pa.array(last, kind[1])], schema=schema)

    return run


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """As read_tokens, with the CRC-32 of each document's ids in place of the ids."""
    manifest = based(spark.read.parquet(f"{folder}/manifest"))
    parts = manifest.select("base", "tokens_file", "offsets_file", "n_docs", "n_tokens", "bits")
    return parts.repartition(parts_for(parts, 1), "tokens_file").mapInArrow(_reader(folder, True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_dir(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, folder)


QUERIES = {"op7_token_output": op7_token_output}
ORACLE_SQL: dict[str, str] = {}

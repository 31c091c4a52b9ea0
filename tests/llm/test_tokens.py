import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from fathom.llm import tokens
from fathom.llm.shared import work_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_are_encoded_as_the_library_does(spark, sf):
    whole, enc = Tokenizer.from_file(PATH), tokens.PieceEncoder(PATH)
    rng = random.Random(1)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", " ", "　", "'s", "'", "don't", "12", ".", "é", "ß", "日本", "😀", "́", "word", "_", "--", "<|endoftext|>", "\r\n", "ı", "٣", "​", "\x00", "\xad"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_short_texts_are_cut_where_the_library_cuts():
    whole, enc = Tokenizer.from_file(PATH), tokens.PieceEncoder(PATH)
    rng = random.Random(2)
    alphabet = [*"aB .12'_-\n\t×éßª", "  ", "\u3000", "'s", "don't", "日本", "😀", "\u0301", "word", "<|endoftext|>", "\r\n", "ı", "٣", "\u200b", "\x00", "\xad", "x" * 80]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 8))) for _ in range(20_000)]
    for at in range(0, len(texts), 500):  # pieces of one slice are numbered together
        some = texts[at : at + 500]
        ids, sizes = enc.flat(pa.array(["other", *some]).slice(1), tokens.END_ID)
        for t, got in zip(some, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert got.tolist() == [*whole.encode(t, add_special_tokens=False).ids, tokens.END_ID], t
    assert not any(len(p) > tokens.LONG for p in enc.known)


def test_bases_in_two_levels(spark):
    rng = random.Random(3)
    parts = [(p, rng.randint(0, 50)) for p in sorted(rng.sample(range(3000), 700))]
    got = {r["part"]: r["base"] for r in tokens.based(spark.createDataFrame(parts, "part int, n_tokens long"), 100).collect()}
    assert got == {p: sum(n for q, n in parts if q < p) for p, _ in parts}


def want_of(rows):
    whole, at, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_on_the_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.op7_token_output(spark, sf).orderBy("doc_id").collect()]
    assert got == want_of(rows)


def test_odd_rows(spark):
    rows = [(5, "five"), (-3, None), (2, ""), (10**12, "long " * 100_000), (7, "é😀 " * 50)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    folder = work_dir(spark, "tokens-test")
    manifest = tokens.write_tokens(df, folder, PATH)
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in tokens.read_tokens(spark, folder).orderBy("start").collect()]
    assert got == want_of(rows)
    assert {r["bits"] for r in manifest.collect()} == {16}
    # Equal ids have places of their own.
    folder = work_dir(spark, "tokens-test")
    tokens.write_tokens(spark.createDataFrame([(1, "a"), (1, "a"), (1, "bb")], "doc_id long, text string"), folder, PATH)
    back = tokens.read_digests(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [1, 1, 1] and back[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(back, back[1:], strict=False))


def test_empty(spark):
    folder = work_dir(spark, "tokens-test")
    assert tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, PATH).count() == 0
    assert tokens.read_tokens(spark, folder).count() == 0

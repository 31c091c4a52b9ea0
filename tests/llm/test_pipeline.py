import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from fathom.llm import decontaminate, langid, mixing


def brute(docs, spark, sf):
    """Documents that are left, by each stage's own rule."""
    from test_decontaminate import brute_leaks
    from test_simhash import brute_components, brute_fp

    docs = [d for d in docs if re.search(r"[^\W\d_]", d["text"] or "")]
    fps = [brute_fp(d["text"]) for d in docs]
    ids = [d["doc_id"] for d in docs]
    docs = [d for d, c in zip(docs, brute_components(ids, fps), strict=True) if d["doc_id"] == c]
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    gone = {d for d, _ in brute_leaks([(d["doc_id"], d["text"]) for d in docs], items)}
    return [d for d in docs if d["doc_id"] not in gone]


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    want = brute(rows, spark, sf)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*docs.columns, "shard"]
    assert {r["doc_id"] for r in got.collect()} == {d["doc_id"] for d in want}
    tokens = {}
    for d in want:
        tokens[d["source"]] = tokens.get(d["source"], 0) + len(d["text"].split()) + 1
    made = mixing.plan(tokens)
    used = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(mixing.tokens_of(F.col("text"))).alias("n")).collect()}
    assert used.keys() == made.budgets.keys() and all(used[s] >= b for s, b in made.budgets.items())


def test_stages_on_odd_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    odd = spark.createDataFrame([(1, None, None, None, None, "e"), (1, "", "en", "a", 0, "e"), (None, "the cat sat on the mat", "en", "a", 5, "e"), (2, "the dog " * 50_000, "en", None, 9, "e"), (3, "the dog sat", "de", "b", 1, None), (3, "the dog sat", "de", "b", 1, None)], schema)
    for df in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, sf)
            assert out.columns == df.columns + (["shard"] if k == 4 else [])
            assert out.count() <= max(1, df.count()) * 8
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "source_mixing", "sharding"]
    assert langid.filter_known and decontaminate.without_leaks


FOREIGN_TEXTS = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita.",
    "Vaka vanha Väinämöinen lauleli suurella äänellä pitkin järven rantaa ja kulki kohti pohjoista.",
    "Litwo, ojczyzno moja, ty jesteś jak zdrowie, ile cię trzeba cenić, ten tylko się dowie, kto cię stracił.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar, akıl ve vicdana sahiptirler.",
    "Съешь же ещё этих мягких французских булок, да выпей чаю. the and of the",
    "春はあけぼの、やうやう白くなりゆく山ぎは、すこしあかりて the and of the",
]


def test_language_rejects_foreign_prose_and_keeps_learned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    foreign = spark.createDataFrame([(10**9 + 1 + 3 * k, t * 3) for k, t in enumerate(FOREIGN_TEXTS)], "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns[2:]])
    assert docs.columns[:2] == ["doc_id", "text"]
    kept = corpus_pipeline.language(spark, docs.unionByName(foreign), sf)
    assert kept.where(F.col("doc_id") > 10**9).count() == 0
    assert kept.count() == docs.where("text rlike '\\\\p{L}'").count()


def test_columns_of_the_same_names_as_ours(spark, sf):
    """Stages keep a user's columns, whatever their names."""
    names = ["__id", "__of", "__digest", "__uses", "__pass", "__slot", "__Shard", "__last", "__kept", "block", "row", "digest", "fp", "held", "of"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    texts = ["the cat sat on the mat and the dog", "an entirely different line of words is here", "the cat sat on the mat and the dog"]
    df = spark.createDataFrame([(k, t, "en", "a", 9, *range(k, k + len(names))) for k, t in enumerate(texts)], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:], 1):
        out = stage(spark, df, sf)
        assert out.columns == df.columns + (["shard"] if k == 4 else [])
        kept = {tuple(r)[: len(df.columns)] for r in out.collect()}
        assert kept == {tuple(r) for r in df.collect()} - ({tuple(r) for r in df.where("doc_id = 2").collect()} if k == 1 else set())


def test_run_leaves_one_table(spark, sf):
    from fathom.llm.shared import shared_dir

    p = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    held = lambda: {s.getPath().getName() for s in fs.listStatus(p)}
    before = held()
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n.split("-")[1] for n in held() - before] == ["source_mixing"]


def test_rows_passes_and_shards_of_run(spark, sf):
    """Each row of run() by its last two stages' rules alone: how often a document is used, and where its rows go."""
    import hashlib
    import math

    from fathom.llm import sharding

    rows = corpus_pipeline.run(spark, sf).collect()
    table = sharding.lookup_table([f"shard-{k:05d}" for k in range(sharding.SHARDS)])
    assert all(r["shard"] == table[int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS] for r in rows)
    docs = {r["doc_id"]: r for r in rows}
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) + 1
    md5 = lambda *parts: hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    sources = {}
    for r in docs.values():
        sources.setdefault(r["source"], []).append(r)
    made = mixing.plan({s: sum(map(size, rs)) for s, rs in sources.items()})
    want = {}
    for s, rs in sources.items():
        held, blocks = sum(map(size, rs)), max(1, math.ceil(len(rs) / mixing.BLOCK_DOCS))
        whole, rest = divmod(made.budgets[s], held)
        block = {r["doc_id"]: int(md5("block", r["doc_id"])[:15], 16) % blocks for r in rs}
        order = sorted(rs, key=lambda r: (md5("pass", whole, s, block[r["doc_id"]]), block[r["doc_id"]], md5("doc", whole, r["doc_id"]), r["doc_id"]))
        spent = 0
        for r in order:
            want[r["doc_id"]] = whole + (spent < rest)
            spent += size(r)
    assert Counter(r["doc_id"] for r in rows) == want

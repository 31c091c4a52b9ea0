import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fathom.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append(i)
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        keep = min((x for x in groups[n] if x is not None), default=None)
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bits", "bucket"), [(64, 65_536), (4, 2), (64, 3)])
def test_brute_force(spark, bits, bucket):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, "", " ", "\t\n", "a b", "a  b", "a\x0bb", "a b", "A b", " a b", f"text {rng.randint(0, 60)}", "é😀", "x" * 5000])) for k in rng.sample(range(100_000), 400)]
    rows += [(k, "the hot text") for k in range(200_000, 200_400)] + [(None, "a b"), (None, "only null ids"), (7, "twin"), (7, "twin")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, key string, group_size int")
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(df, bits and "doc_id", "text", bucket, bits).collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_directory_splits_overfull_buckets(spark):
    entries = spark.range(4000).selectExpr("xxhash64(id) AS key")
    leaves = exact_dedup.directory(entries, 100).collect()
    assert max(r["depth"] for r in leaves) > exact_dedup.SHALLOWEST
    held = {}
    for k in (r["key"] for r in entries.collect()):
        prefix = (k & (2**64 - 1)) >> (64 - exact_dedup.DEEPEST)
        leaf = next(r["bucket"] for r in leaves if r["prefix"] == prefix)
        held[leaf] = held.get(leaf, 0) + 1
    assert max(held.values()) <= 100 and sum(held.values()) == 4000


def test_native(spark, sf):
    plan = exact_dedup.op9_exact_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "ArrowEval", "InPandas"))


@pytest.mark.parametrize(("keys", "bits"), [(0, 64), (0, 5), (10**6, 5)])
def test_chained_hashes_broadcast_or_shuffled(spark, monkeypatch, keys, bits):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", keys)
    rows = [(k, f"text {k % 40}" if k % 3 else "the hot  text") for k in range(600)]
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), key_bits=bits).collect()), key=repr)
    assert got == brute(rows)


def test_owners_have_whole_buckets(spark):
    entries = spark.range(3000).selectExpr("xxhash64(id) AS key", "id AS keep_id", "1L AS group_size")
    leaves = exact_dedup.directory(entries, 50, 5)
    found = exact_dedup.index(entries, leaves, 7).withColumn("file", F.input_file_name())
    assert found.count() == 3000 and found.groupBy("bucket").agg(F.count_distinct("file").alias("files")).where("files > 1").count() == 0
    assert found.select("file").distinct().count() > 3 and found.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 50

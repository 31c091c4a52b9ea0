from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathom.llm import sharding


def test_table_is_even_and_moves_little():
    names = [f"s{k}" for k in range(20)]
    a, b = sharding.lookup_table(names, 2003), sharding.lookup_table(names[:-1], 2003)
    counts = Counter(a)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 20
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 19)
    assert moved < 0.12 * 2003
    assert sharding.lookup_table(["one"], 7) == [0] * 7
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (list("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_rows(spark):
    df = spark.createDataFrame([(1, "a", 5), (None, "b", 6), (1, "c", 7), (None, "d", None)], "doc_id long, __text string, shard int")
    got = sharding.shard(df)
    assert got.columns == ["doc_id", "__text", "shard"]
    rows = {r["__text"]: r["shard"] for r in got.collect()}
    assert len(rows) == 4 and rows["a"] == rows["c"] and rows["b"] == rows["d"]
    assert sharding.shard(df.limit(0)).count() == 0
    many = sharding.shard(spark.range(20_000).withColumnRenamed("id", "doc_id")).groupBy("shard").agg(F.count("*").alias("n")).collect()
    assert len(many) == sharding.SHARDS and all(450 < r["n"] < 800 for r in many)

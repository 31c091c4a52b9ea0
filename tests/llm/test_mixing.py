import math

import pytest
from pyspark.sql import functions as F

from fathom.llm import mixing


def test_exponent_meets_entropy_or_repetition():
    tokens = {"a": 9000, "b": 2000, "c": 1500, "d": 1000}
    made = mixing.plan(tokens, target=0.9, most_passes=50)
    assert mixing.entropy(mixing.weights(tokens, made.exponent)) == pytest.approx(0.9 * 2, abs=1e-9)
    tight = mixing.plan(tokens, target=1.0, most_passes=2)
    assert mixing.passes(tokens, mixing.weights(tokens, tight.exponent)) == pytest.approx(2, abs=1e-9)
    assert mixing.plan({"a": 5}, 0.9).exponent == 1.0 and mixing.plan({}, 0.9).weights == {}
    for p in (made, tight):
        assert all(p.budgets[s] >= tokens[s] for s in tokens) and sum(p.weights.values()) == pytest.approx(1e6, rel=1e-5)


def rows_of(spark):
    rows = [(k, f"w{k} " * 9, "big") for k in range(600)] + [(1000 + k, "x y z " * 3, "small") for k in range(60)] + [(2000 + k, None, None) for k in range(40)]
    return spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, block int"), rows


def test_budgets_are_realised(spark):
    df, rows = rows_of(spark)
    uses = mixing.draws(df, target=0.999, most_passes=6.0, block_docs=8)
    got = uses.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("most"), F.countDistinct("doc_id").alias("n")).collect()
    tokens = {s: sum((len((t or "").split()) + 1) for _, t, x in rows if x == s) for s in ("big", "small", None)}
    made = mixing.plan(tokens, 0.999, 6.0)
    for r in got:
        assert made.budgets[r["source"]] <= r["t"] < made.budgets[r["source"]] + r["most"]
        assert r["n"] == sum(x == r["source"] for _, _, x in rows)  # every document at least once
    assert {r["source"]: r["t"] for r in got}["small"] > tokens["small"]
    twice = uses.groupBy("doc_id", "pass").count().where("count > 1").count()
    assert twice == 0
    last = uses.groupBy("source", "doc_id").agg(F.max("pass").alias("p")).groupBy("source").agg((F.max("p") - F.min("p")).alias("spread"))
    assert all(r["spread"] <= 1 for r in last.collect())
    mixed = mixing.mix(df, target=0.999, most_passes=6.0, block_docs=8)
    assert mixed.columns == df.columns and mixed.count() == uses.count()


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.draws(empty).collect() == [] and mixing.mix(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b", "s"), (None, "c", "s"), (1, None, "s"), (1, "", None), (1, "d", None)], "doc_id long, text string, source string")
    assert mixing.draws(odd).count() >= 5
    one = spark.createDataFrame([(k, "a b c", "s") for k in range(50)], "doc_id long, text string, source string")
    assert mixing.draws(one).count() == 50
    assert not math.isnan(mixing.plan({"a": 1, "b": 10**15}).exponent)


def test_hot_and_missing_ids(spark):
    """Rows without an id, or with one that many share, go to blocks of the usual size; every row is used, budgets are met."""
    rows = [(None, f"text {k} of many", "a", k) for k in range(3000)] + [(7, "the same", "b", k) for k in range(3000)] + [(k, "some text here", "c", k) for k in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    uses = mixing.used(df, "doc_id", "source", "text")
    per_block = {r["source"]: r["most"] for r in uses.groupBy("source", "block").count().groupBy("source").agg(F.max("count").alias("most")).collect()}
    assert uses.count() == len(rows) and per_block["a"] < 16 * mixing.BLOCK_DOCS
    made = mixing.plan({r["source"]: r["t"] for r in uses.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()})
    spent = {r["source"]: r["t"] for r in uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("t")).collect()}
    assert all(0 <= spent[s] - b <= 8 for s, b in made.budgets.items()) and uses.where("uses < 1").count() == 0
    out = mixing.mix(df)
    assert out.columns == df.columns and {(r["source"], r["n"]) for r in out.select("source", "n").distinct().collect()} == {(s, n) for _, _, s, n in rows}

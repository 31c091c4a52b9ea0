"""Approximate vector search by lists: recall against exact search, rows that are read, edges."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.plans import lists
from fathom.plans import query as q
from fathom.plans.definition import IndexDefinition
from fathom.plans.index import SearchIndex


@pytest.mark.parametrize("similarity", ["cosine", "euclidean", "dotProduct"])
def test_recall_and_rows_read(spark, tmp_path, similarity, monkeypatch):
    monkeypatch.setattr(lists, "ROWS_EACH", 100)
    monkeypatch.setattr(lists, "READ_EACH", 5)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    vectors = [[x + rng.gauss(0, 0.4) for x in rng.choice(centres)] for _ in range(6000)]
    rows = [(k, v, k % 3) for k, v in enumerate(vectors)] + [(10_000, None, 0), (10_001, [1.0], 0)]
    definition = IndexDefinition.vector([{"type": "vector", "path": "v", "numDimensions": 16, "similarity": similarity}, {"type": "filter", "path": "c"}])
    index = SearchIndex(spark.createDataFrame(rows, "_id long, v array<float>, c int"), definition).write(f"file://{tmp_path}/i")
    assert index.docs.count() == len(rows) and len(index.lists["v"].sizes) == 60 and index.lists["v"].sizes.sum() == 6000
    found = total = 0
    for k in range(0, 6000, 300):
        body = {"path": "v", "queryVector": [float(x) for x in vectors[k]], "limit": 10}
        for more in ({}, {"filter": {"c": 1}}):
            exact = {r["_id"] for r in q.vector(index, body | more | {"exact": True}).collect()}
            near = [r["_id"] for r in q.vector(index, body | more | {"numCandidates": 100}).collect()]
            assert len(near) == 10
            found, total = found + len(exact & set(near)), total + 10
    assert found / total >= 0.9
    some = index.lists["v"].nearest(vectors[0], 100)
    assert 8 <= len(some) < 30 and index.docs.where(F.col("__list").isin(some)).count() >= 500
    assert "__list" not in q.vector(index, body | {"exact": True}).columns


def test_small_and_empty_tables_have_no_lists(spark, tmp_path):
    definition = IndexDefinition.vector([{"type": "vector", "path": "v", "numDimensions": 2, "similarity": "euclidean"}])
    for k, rows in enumerate(([(1, [0.0, 1.0]), (2, None)], [])):
        index = SearchIndex(spark.createDataFrame(rows, "_id long, v array<float>"), definition).write(f"file://{tmp_path}/{k}")
        assert index.lists == {} and q.vector(index, {"path": "v", "queryVector": [0.0, 0.5], "numCandidates": 5, "limit": 5}).count() == len(rows) // 2

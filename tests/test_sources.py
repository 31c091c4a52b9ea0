"""Views, synonyms, sinks, cursors, change events as a stream, embeddings."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 - registers the queries
from fathom import registry
from fathom.plans import query as q
from fathom.plans.errors import QueryError
from fathom.plans.index import SearchIndex
from fathom.sources.synonyms import load
from fathom.sources.tables import batches, in_batches, materialize_embeddings, numbered, scan, upserted, write_partitioned
from fathom.sources.views import apply_view
from fathom.streaming.cdc import IndexedTable, apply_stream, changes, relevant

EVENT = "op string, _id int, seq int, doc struct<_id:int,title:string,n:int>, updated array<string>"


def test_view(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, None, 5), (3, "b", None)], "_id int, t string, n int")
    got = apply_view(df, [{"$match": {"n": {"$gte": 1}}}, {"$set": {"m": {"$add": ["$n", 1]}, "t": {"$ifNull": ["$t", "none"]}}}]).collect()
    assert sorted((r["_id"], r["t"], r["m"]) for r in got) == [(1, "a", 3), (2, "none", 6)]
    with pytest.raises(QueryError):
        apply_view(df, [{"$project": {"n": 1}}])


def test_view_is_applied_once_to_a_written_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "red fox", 2), (2, "fox", 5)], "_id int, t string, n int")
    definition = {"mappings": {"fields": {"t": {"type": "string"}, "n": {"type": "number"}}}, "view": [{"$addFields": {"n": {"$add": ["$n", 1]}}}]}
    held = SearchIndex(df, definition).write(f"file://{tmp_path}/i")
    assert [r["n"] for r in q.search(held, {"text": {"path": "t", "query": "red"}}).collect()] == [3]


def test_synonyms(spark):
    rows = spark.createDataFrame([("equivalent", ["car", "auto"], None), ("explicit", ["sea"], ["ocean"])], "mappingType string, synonyms array<string>, input array<string>")
    assert load(rows, str.split) == [(["auto"], [["car"], ["auto"]]), (["car"], [["car"], ["auto"]]), (["ocean"], [["sea"]])]
    index = SearchIndex(spark.createDataFrame([(1, "a car"), (2, "an auto"), (3, "the sea"), (4, "the ocean")], "_id int, t string"), {"mappings": {"fields": {"t": {"type": "string"}}}, "synonyms": [{"name": "s", "source": {"collection": "c"}, "analyzer": "lucene.standard"}]}, synonyms={"c": rows})
    find = lambda w: [r["_id"] for r in q.search(index, {"text": {"path": "t", "query": w, "synonyms": "s"}}).collect()]
    assert find("car") == [1, 2] and find("ocean") == [4, 3] and find("sea") == [3]
    with pytest.raises(QueryError):
        load(rows.withColumn("mappingType", F.lit("other")), str.split)


def test_sinks_and_cursor(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("_id"), (F.col("id") * 2).alias("v"))
    write_partitioned(df, f"file://{tmp_path}/t", 4)
    back = scan(spark, f"file://{tmp_path}/t", resume_after=900)
    assert back.count() == 99
    sizes = [len(b) for b in batches(df)]
    assert sizes[0] == 101 and sum(sizes) == 1000 and sizes[1] > 101
    assert [len(b) for b in batches(df, 400)] == [400, 400, 200]
    new = upserted(df.where("_id < 3"), spark.createDataFrame([(1, 7, False), (2, 0, True), (9, 9, False)], "_id long, v long, gone boolean"), deleted_col="gone")
    assert sorted(map(tuple, new.collect())) == [(0, 0), (1, 7), (9, 9)]


def test_places_and_batches_of_an_ordered_result(spark):
    df = spark.range(0, 3000, 1, 7).select(((F.col("id") * 7919) % 3001).alias("_id"), (F.col("id") % 5).alias("v"))
    result = df.orderBy(F.col("v").desc(), "_id")
    want = [(k, r["_id"]) for k, r in enumerate(result.collect(), 1)]
    assert [tuple(r) for r in numbered(result).select("place", "_id").orderBy("place").collect()] == want
    for size in (None, 400):
        own = {r["batch"]: r["n"] for r in in_batches(result, size).groupBy("batch").agg(F.count("*").alias("n")).collect()}
        assert own == dict(enumerate(len(b) for b in batches(result, size)))
    assert in_batches(result.where("v > 9")).count() == numbered(result.where("v > 9")).count() == 0


@pytest.mark.parametrize("name", ["sort_nan_below_numbers", "sort_mixed_types", "cursor_batches"])
def test_ordered_results_stay_off_the_driver(spark, sf, monkeypatch, name):
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a, **k: pytest.fail("rows come to the driver"))
    assert registry.QUERIES[name](spark, sf).count() > 1


def test_a_sort_compares_columns(spark):
    index = SearchIndex(spark.range(50).select("id", F.parse_json(F.col("id").cast("string")).alias("m")), {"mappings": {"fields": {"id": {"type": "number"}, "m": {"type": "number"}}}}, "id")
    df = q.search(index, {"exists": {"path": "id"}, "sort": {"m": -1}, "limit": None})
    sort = next(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in x)
    assert "variant" not in sort and [r["id"] for r in df.collect()] == list(range(49, -1, -1))


def test_embeddings_are_kept_for_unchanged_texts(spark, tmp_path):
    calls = f"{tmp_path}/vectors"
    one = spark.createDataFrame([(1, "a b"), (2, None)], "_id int, t string")
    first = {r["_id"]: r["v"] for r in materialize_embeddings(one, f"file://{calls}", "t", "v").collect()}
    two = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d")], "_id int, t string")
    second = {r["_id"]: r["v"] for r in materialize_embeddings(two, f"file://{calls}", "t", "v").collect()}
    assert set(second) == {1, 2, 3} and second[1] == first[1]


def test_changes(spark):
    rows = [("insert", 1, 1, (1, "a", 1), None), ("update", 1, 3, (1, "c", 3), ["title"]), ("update", 1, 2, (1, "b", 2), ["n"]), ("delete", 2, 5, None, None), ("insert", 2, 4, (2, "x", 0), None), ("update", 3, 6, None, ["n"]), ("replace", 4, 7, (4, "d", -1), None)]
    events = spark.createDataFrame(rows, EVENT)
    got = {r["_id"]: (r["title"], r["deleted"]) for r in changes(events).collect()}
    assert got == {1: ("c", False), 2: (None, True), 3: (None, True), 4: ("d", False)}
    viewed = {r["_id"]: r["deleted"] for r in changes(events, view=[{"$match": {"n": {"$gte": 0}}}]).collect()}
    assert viewed == {1: False, 2: True, 3: True, 4: True}
    assert relevant(events, ["title"]).where("op = 'update'").count() == 1


def test_stream(spark, tmp_path):
    folder = f"file://{tmp_path}"
    table = IndexedTable(spark, f"{folder}/table", spark.createDataFrame([], "_id int, title string, n int").schema)

    def feed(k, rows):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(spark.createDataFrame([], EVENT).schema).parquet(f"{folder}/events")
        apply_stream(stream, table, f"{folder}/checkpoint", once=True).awaitTermination()

    feed(1, [("insert", 1, 1, (1, "a", 1), None), ("insert", 2, 2, (2, "b", 2), None)])
    feed(2, [("update", 1, 3, (1, "aa", 1), ["title"]), ("delete", 2, 4, None, None), ("insert", 3, 5, (3, "c", 3), None)])
    assert sorted(map(tuple, table.read().collect())) == [(1, "aa", 1), (3, "c", 3)]
    assert len(table.versions()) == 2
    with pytest.raises(Exception, match="drop"):
        feed(3, [("drop", None, 6, None, None)])


def test_a_merge_writes_touched_buckets_only(spark, tmp_path):
    import os

    table = IndexedTable(spark, f"file://{tmp_path}/table", "_id long, n int", buckets=8)
    rows = lambda pairs: spark.createDataFrame([(i, n, False) for i, n in pairs], "_id long, n int, deleted boolean")
    table.merge(rows([(k, k) for k in range(200)]), 0)
    table.merge(rows([(5, -5)]), 1)
    assert len([d for d in os.listdir(f"{tmp_path}/table/v=1") if d.startswith("__bucket=")]) == 1
    assert {r["_id"]: r["n"] for r in table.read().collect()} == {k: k for k in range(200)} | {5: -5}
    assert {r["_id"]: r["n"] for r in table.read(0).collect()} == {k: k for k in range(200)}  # the version before is still whole
    table.merge(rows([(5, 50)]), 1)  # a batch that is run again
    table.merge(rows([(k, 0) for k in range(200)]).withColumn("deleted", F.col("_id") != 7), 2)
    assert [tuple(r) for r in table.read().collect()] == [(7, 0)] and table.versions() == [1, 2]
    table.merge(rows([(300, 3)]), 3)
    assert sorted(map(tuple, table.read().collect())) == [(7, 0), (300, 3)] and table.versions() == [2, 3]
    assert sorted(d for d in os.listdir(f"{tmp_path}/table") if d.startswith("v=")) == ["v=2", "v=3"]


def test_a_join_is_made_once_for_an_index(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).mapInArrow(counted, "id long").groupBy("id").agg(F.count("*").alias("n"))
    SearchIndex(rows, {"mappings": {"fields": {"n": {"type": "number"}}}}, "id").write(f"file://{tmp_path}/i")
    assert seen.value == 100

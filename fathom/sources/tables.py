"""Collection scans, sinks and cursors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from operator import add

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fathom.sources.storage import work_dir

FIRST_BATCH, GROWTH = 101, 1.03


def scan(spark: SparkSession, path: str, id_col: str = "_id", resume_after: object = None, fmt: str = "parquet") -> DataFrame:
    """A collection's rows; with resume_after those of larger ids only, which the scan's statistics prune."""
    df = spark.read.format(fmt).load(path)
    return df if resume_after is None else df.where(F.col(id_col) > F.lit(resume_after))


def write_partitioned(df: DataFrame, path: str, partitions: int, id_col: str = "_id", mode: str = "overwrite") -> None:
    """Rows by the Murmur3 hash of their id, a file for each of `partitions`."""
    df.repartition(partitions, id_col).write.mode(mode).parquet(path)


def upserted(current: DataFrame, changes: DataFrame, id_col: str = "_id", deleted_col: str | None = None) -> DataFrame:
    """current with the changed rows in place of those of the same id; rows marked as deleted go. changes has one row per id."""
    kept = current.join(changes.select(id_col), id_col, "left_anti")
    new = changes.where(~F.coalesce(F.col(deleted_col), F.lit(False))).drop(deleted_col) if deleted_col else changes
    return kept.unionByName(new.select(*current.columns))


def batches(df: DataFrame, batch_size: int | None = None) -> Iterator[list[Row]]:
    """Result batches as a cursor gives them: the client's size, or 101 and then each larger by a power of 1.03 of that. Rows come partition by partition."""
    size, held = float(batch_size or FIRST_BATCH), []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) >= int(size):
            yield held
            held = []
            size = float(batch_size) if batch_size else size**GROWTH
    if held:
        yield held


def numbered(df: DataFrame, name: str = "place") -> DataFrame:
    """Rows with their place in df's order, from 1. The rows are written once as their sort deals them out, each task numbers its own, and what is before a task's first comes from a count for each task: none of the rows come to the driver."""
    path = work_dir(df.sparkSession, "numbered")
    df.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    counts = sorted((r["task"], r["n"]) for r in held.groupBy(F.shiftright("__at", 33).alias("task")).agg(F.count("*").alias("n")).collect())  # a row for each task
    before = [(task, sum_before) for (task, _), sum_before in zip(counts, accumulate((n for _, n in counts), initial=0))]
    starts = df.sparkSession.createDataFrame(before, "__task long, __before long")
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(F.broadcast(starts), F.shiftright("__at", 33) == F.col("__task")).select(*df.columns, place.alias(name))


def in_batches(df: DataFrame, batch_size: int | None = None, name: str = "batch") -> DataFrame:
    """Rows with the number, from 0, of the cursor's batch that they are in (`batches`), without the driver."""
    held = numbered(df, "__place")
    if batch_size:
        number = F.floor((F.col("__place") - 1) / F.lit(batch_size))
    else:
        total, ends, size = held.count(), [], float(FIRST_BATCH)
        while (ends[-1] if ends else 0) < total:
            ends.append((ends[-1] if ends else 0) + int(size))
            size = size**GROWTH
        number = reduce(add, [(F.col("__place") > end).cast("int") for end in ends[:-1]], F.lit(0))  # sizes grow: a few dozen ends for any table
    return held.select(*df.columns, number.cast("int").alias(name))


def materialize_embeddings(docs: DataFrame, path: str, text_col: str, vector_col: str, embedder=None, dims: int = 64, id_col: str = "_id") -> DataFrame:
    """Writes (id, digest, vector) of a text column; texts whose digest is already there keep their vector: only changed ones are embedded.

    The view is a table in versions: a job that dies leaves the version before it as it is.
    """
    from fathom.functions.vectors import embed
    from fathom.streaming.cdc import IndexedTable

    now = docs.select(id_col, F.col(text_col).alias("__text"), F.sha2(F.col(text_col).cast("string"), 256).alias("digest"))
    table = IndexedTable(docs.sparkSession, path, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, digest string, {vector_col} array<float>", id_col)
    held = table.versions()
    if not held:
        made = now.select(id_col, "digest", embed(F.col("__text"), embedder, dims).alias(vector_col))
    else:
        old = table.read()
        same = now.join(old, [id_col, "digest"]).select(id_col, "digest", vector_col)
        fresh = now.join(old.select(id_col, "digest"), [id_col, "digest"], "left_anti")
        made = same.unionByName(fresh.select(id_col, "digest", embed(F.col("__text"), embedder, dims).alias(vector_col)))
    table.write(made, (held[-1] if held else 0) + 1)
    return table.read()

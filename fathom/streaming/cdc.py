"""Change events into an indexed table: last write per id, view rewriting, pruning, versions of the table.

Events are rows (op, id, seq, document..., updated: array<string>): op insert, update, replace, delete; drop, rename and
invalidate end the stream. A micro-batch is reduced to the last event of each id with a partial aggregation and
merged into the table of the version before, bucket by bucket; a version is a folder of its own, so readers and retries never see half
of one, and a batch that is run again writes the same folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fathom.sources.tables import upserted
from fathom.sources.views import rewrite_events

#: Buckets of a table by default: a merge writes those that its ids fall into.
BUCKETS = 16
WRITES, ENDS = ("insert", "update", "replace"), ("drop", "rename", "invalidate", "dropDatabase")


class InvalidatedError(RuntimeError):
    """The collection was dropped or renamed: the table has to be built anew."""


def last_events(events: DataFrame, id_col: str = "_id", seq_col: str = "seq") -> DataFrame:
    """The last event of each id; partial results in each task, so an id with many events is no hot spot."""
    every = F.struct(*[F.col(c) for c in events.columns])
    return events.groupBy(F.col(id_col).alias("__id")).agg(F.max_by(every, F.col(seq_col)).alias("__e")).select("__e.*")


def relevant(events: DataFrame, indexed: list[str], op_col: str = "op", updated_col: str = "updated") -> DataFrame:
    """Without updates that touch no indexed field (or a field above or below one); without the list of fields every update counts."""
    touched = F.exists(updated_col, lambda u: F.exists(F.array(*[F.lit(p) for p in indexed]), lambda p: (u == p) | u.startswith(F.concat(p, F.lit("."))) | p.startswith(F.concat(u, F.lit(".")))))
    return events.where((F.col(op_col) != "update") | F.col(updated_col).isNull() | touched)


def changes(events: DataFrame, document_col: str = "doc", id_col: str = "_id", seq_col: str = "seq", op_col: str = "op", view: list[dict] | None = None) -> DataFrame:
    """(document columns, deleted): deletes, updates without a document and documents that a view leaves out are deleted."""
    last = last_events(events, id_col, seq_col)
    rows = last.select(F.col(id_col).alias("__id"), F.col(op_col).alias("__op"), F.col(document_col).isNull().alias("__none"), f"{document_col}.*")
    if view:
        rows = rewrite_events(rows, view)
    else:
        rows = rows.withColumn("deleted", F.lit(False))
    gone = (F.col("__op") == "delete") | F.col("__none") | F.coalesce(F.col("deleted"), F.lit(True))
    return rows.withColumn(id_col, F.coalesce(F.col("__id"), F.col(id_col))).withColumn("deleted", gone).drop("__id", "__op", "__none")


class IndexedTable:
    """A table in versions, by buckets of its ids: <path>/v=<n>/__bucket=<k> folders, and for each version a list of where each bucket's rows are.

    A merge writes the buckets that its ids fall into; the others stay where they are. A version counts when its list is whole.
    """

    def __init__(self, spark: SparkSession, path: str, schema, id_col: str = "_id", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.id_col, self.buckets = spark, path.rstrip("/"), T.StructType.fromDDL(schema) if isinstance(schema, str) else schema, id_col, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.hash(self.id_col), F.lit(self.buckets))

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.path}/{n}/_buckets/_SUCCESS")))

    def places(self, version: int) -> dict[int, int]:
        """The version that each bucket's rows were written in; buckets without rows have none."""
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/v={version}/_buckets").collect()}  # a row for each bucket

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        held = self.versions()
        at = version if version is not None else held[-1] if held else None
        places = {} if at is None else self.places(at)
        folders = [f"{self.path}/v={v}/__bucket={b}" for b, v in sorted(places.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int, kept: dict[int, int] | None = None) -> None:
        """Rows of some buckets; kept says where those of the others are."""
        folder = f"{self.path}/v={version}"
        rows = df.select(*[f.name for f in self.schema]).withColumn("__bucket", self.bucket())
        rows.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        own = {int(n.split("=")[1]): version for n in names if n.startswith("__bucket=")}
        places = self.spark.createDataFrame(sorted(((kept or {}) | own).items()), "bucket int, version int")
        places.coalesce(1).write.mode("overwrite").parquet(f"{folder}/_buckets")

    def merge(self, batch: DataFrame, version: int, keep: int = 2) -> None:
        """Applies changes(...) to the last version below `version`: only buckets with changes are read and written."""
        before = [v for v in self.versions() if v < version]
        places = self.places(before[-1]) if before else {}
        batch = batch.select(*[f.name for f in self.schema], "deleted").persist()
        touched = {r["b"] for r in batch.select(self.bucket().alias("b")).distinct().collect()}
        current = self.read(before[-1], touched) if before else self.spark.createDataFrame([], self.schema)
        self.write(upserted(current, batch, self.id_col, "deleted"), version, {b: v for b, v in places.items() if b not in touched})
        batch.unpersist()
        self._drop_unused([*before[len(before) - keep + 1 :], version] if keep > 1 else [version], before)

    def _drop_unused(self, kept: list[int], before: list[int]) -> None:
        """Folders that no kept version has rows in; versions that aren't kept lose their list first."""
        used = {(v, b) for n in kept for b, v in self.places(n).items()}
        for old in [v for v in before if v not in kept]:
            self._fs.delete(self._path(f"{self.path}/v={old}/_buckets"), True)
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if not name.startswith("v=") or int(name[2:]) in kept or int(name[2:]) > kept[-1]:
                continue
            own = [s.getPath().getName() for s in self._fs.listStatus(status.getPath())]
            left = [n for n in own if n.startswith("__bucket=") and (int(name[2:]), int(n.split("=")[1])) in used]
            for n in own if left else ():
                if n.startswith("__bucket=") and n not in left:
                    self._fs.delete(self._path(f"{self.path}/{name}/{n}"), True)
            if not left:
                self._fs.delete(status.getPath(), True)


def apply_stream(events: DataFrame, table: IndexedTable, checkpoint: str, document_col: str = "doc", view: list[dict] | None = None, indexed: list[str] | None = None, refresh: str = "1 second", once: bool = False, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts the stream: each micro-batch is a version. A restart goes on from the checkpoint; the batch in flight is merged again into the version before it."""

    def batch(df: DataFrame, number: int) -> None:
        ended = df.where(F.col("op").isin(*ENDS)).select("op").limit(1).collect()
        if ended:
            raise InvalidatedError(ended[0]["op"])
        kept = relevant(df, indexed) if indexed and "updated" in df.columns else df
        table.merge(changes(kept, document_col, table.id_col, view=view), number)
        if after:
            after(table.read(), number)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=refresh)).start()


def follow_synonyms(events: DataFrame, index, name: str, table: IndexedTable, checkpoint: str, refresh: str = "1 second", once: bool = False) -> StreamingQuery:
    """Keeps an index's synonym mapping as its collection is: after each micro-batch of change events the mapping has the collection's rows."""
    return apply_stream(events, table, checkpoint, refresh=refresh, once=once, after=lambda rows, _: index.refresh_synonyms(name, rows))

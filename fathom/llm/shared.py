"""Helpers that every operator of this subpackage uses: shared folders, written tables, lookups of hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that normalisation and word splitting treat as white space.
WHITE = r"[\x20\x09-\x0D]+"
#: A key with more than 1 / HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 512
#: Catalyst's estimate of what it knows nothing of is larger than any table.
UNKNOWN_BYTES = 1 << 60


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset (tests), an own temporary one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="fathom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        path = f"file://{path}"
    if held.isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: Folders made within scratch(), innermost last.
_SCRATCH: list[list[str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one; runs at the same time don't meet in it. It is deleted at the end of scratch(), else of the session."""
    path = f"{shared_dir(spark)}/fathom-{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work folders made within are deleted at its end: what is to stay is written to a folder made outside of it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            drop_dir(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as make it no column of df."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a work folder, by the file system that it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size: that of its input files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, target_mb: int) -> int:
    """As many partitions as leave about target_mb of input to each; never fewer than the session's shuffle partitions.

    Rows that don't come from files have no size in their plan: then it is the partitions that they are in.
    """
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return max(least, df.rdd.getNumPartitions() if size >= UNKNOWN_BYTES else -(-size // (target_mb << 20)))


def words_of(text: Column) -> Column:
    """text with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def lookup(rows: DataFrame, key: str, table: DataFrame, size: str, n: int) -> DataFrame:
    """rows with the columns of table's row of the same key (an inner join; table has one row for each key of rows).

    size is table's column with the number of rows of the key, n the number of all rows. Fewer than HOT_SHARE keys
    can have over n / HOT_SHARE rows: those are broadcast, so that a key with a third of all rows never meets in one
    task; all others go through a shuffle in which no key exceeds that share. rows should be a written table: it is
    read twice.
    """
    bound = max(64, n // HOT_SHARE)
    hot, cold = table.where(F.col(size) > bound), table.where(F.col(size) <= bound)
    at_hot = rows.join(F.broadcast(hot), key)
    at_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return at_hot.unionByName(at_cold)

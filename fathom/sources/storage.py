"""The shared folder for what a session writes, and indexes that are written once and then read by many queries."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from fathom.plans.index import SearchIndex

_OPENED: dict[tuple, SearchIndex] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; where it is unset (tests on one machine), a temporary folder of this session."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    held = sc._jsc.sc().getCheckpointDir()
    if path:
        return path.rstrip("/")
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="fathom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(f"file://{path}")
    return sc._jsc.sc().getCheckpointDir().get()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one, deleted with the session."""
    path = f"{shared_dir(spark)}/fathom-{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and modification times of a table's files: another state is another index. A store's folders have no such state."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return path, tuple(sorted(files))


def opened(spark: SparkSession, name: str, sources: list[str], make: Callable[[], SearchIndex]) -> SearchIndex:
    """The written index of a name over source tables: made by the first query that asks for it in a session, as long as the sources stay as they are.

    What an analyzer makes of a text is then a stored array column, and a query reads only the columns that it names.
    """
    key = (spark.sparkContext.applicationId, name, *[state_of(spark, s) for s in sources])
    if key not in _OPENED:
        made = make()
        _OPENED[key] = made.write(work_dir(spark, f"index-{name}"))
    held = _OPENED[key]
    # A new object over the same files: statistics that one query has looked up don't speed up the measure of the next.
    return SearchIndex.open(spark, held.path, held.definition, held.id_col, held.field_names_col, held.synonym_rows)

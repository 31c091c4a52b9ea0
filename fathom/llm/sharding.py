"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size (an offset and a skip). In turn,
each shard claims its first free slot, until the table is full: shards get equally many slots, give or take one, and
adding or removing a shard moves few others. A document's slot is a hash of its id; the table is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.shared import fresh

#: Production parameters: the table is prime and over a hundred times as large as the number of shards.
SHARDS, SLOTS = 32, 4099
#: A table of at most this many slots (8 bytes each) is broadcast to every task.
MOST_SLOTS = 1_000_003


def _hash(text: str) -> int:
    """The first 60 bits of MD5, as SQL can compute it."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it. Names must differ; there are fewer shards than slots."""
    if not is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MOST_SLOTS}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be 1 to `slots` different names")
    offset = [_hash(f"offset:{s}") % slots for s in shards]
    skip = [_hash(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, at, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for k in range(len(shards)):
            while table[slot := (offset[k] + at[k] * skip[k]) % slots] >= 0:
                at[k] += 1
            table[slot] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(id_col: Column, slots: int) -> Column:
    """The slot of a document: a hash of its id as text; a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def shard(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with one more column, the index of each row's shard; one map-side step, no shuffle.

    Rows of one id go to one shard, null ids too. An empty table gives an empty one. A column of the new name is
    replaced. All other columns are kept.
    """
    shards = shards or [f"shard-{k:05d}" for k in range(SHARDS)]
    spark, kept = docs.sparkSession, docs.drop(name) if name.lower() != id_col.lower() else docs
    slot, place = fresh(docs, "__slot", "__shard")
    table = spark.createDataFrame([(k, s) for k, s in enumerate(lookup_table(shards, slots))], f"{slot} long, {place} int")
    placed = kept.withColumn(slot, slot_of(F.col(id_col), slots)).join(F.broadcast(table), slot)
    return placed.drop(slot).withColumnRenamed(place, name)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs.select("doc_id", "source", "n_chars"))


def sql_hash(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


QUERIES = {"op8_sharding": op8_sharding}
ORACLE_SQL = {
    "op8_sharding": f"""
WITH RECURSIVE s AS (
  SELECT k, {sql_hash("'offset:shard-' || lpad(CAST(k AS VARCHAR), 5, '0')")} % {SLOTS} AS o,
         {sql_hash("'skip:shard-' || lpad(CAST(k AS VARCHAR), 5, '0')")} % ({SLOTS} - 1) + 1 AS skip FROM range({SHARDS}) t(k)),
p AS (SELECT list(o ORDER BY k) AS os, list(skip ORDER BY k) AS skips FROM s),
fill AS (
  SELECT 0 AS turn, list_transform(range({SLOTS}), lambda x: -1) AS tab, list_transform(range({SHARDS}), lambda x: CAST(0 AS BIGINT)) AS tries, os, skips FROM p
  UNION ALL
  SELECT turn + 1,
         list_concat(list_concat(tab[1:slot], [CAST(turn % {SHARDS} AS INT)]), tab[slot+2:]),
         list_concat(list_concat(tries[1:turn % {SHARDS}], [n + 1]), tries[turn % {SHARDS} + 2:]), os, skips
  FROM (SELECT *, (os[turn % {SHARDS} + 1] + n * skips[turn % {SHARDS} + 1]) % {SLOTS} AS slot FROM (
    SELECT *, list_filter(range(tries[turn % {SHARDS} + 1], {SLOTS}), lambda j: tab[(os[turn % {SHARDS} + 1] + j * skips[turn % {SHARDS} + 1]) % {SLOTS} + 1] < 0)[1] AS n
    FROM fill WHERE turn < {SLOTS}))),
done AS (SELECT tab FROM fill WHERE turn = {SLOTS})
SELECT doc_id, source, n_chars, CAST((SELECT tab FROM done)[{sql_hash("coalesce(CAST(doc_id AS VARCHAR), '')")} % {SLOTS} + 1] AS INT) AS shard FROM documents
""",
}

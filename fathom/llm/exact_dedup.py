"""Exact dedup by an extendible-hash index on shared files; DataFrame functions only.

A document's entry is the 64-bit hash of its normalised text. The entries of equal hashes are pre-aggregated, and a
directory of hash prefixes is doubled until no bucket of distinct hashes is overfull. The index is written by
bucket: a task owns the buckets that fall to it, and each row goes to the owner of its hash's bucket, where it meets
the entry (rows of hot hashes excepted, whose entries go to the rows). An entry of several documents is a chain that
may hold collisions: there, and only there, the whole texts are compared, byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.shared import HOT_SHARE, WHITE, lookup, parts_for, words_of, written

#: Distinct hashes a bucket holds before it is split.
BUCKET = 65_536
#: Depth at which the directory starts at least, and the most it may be doubled to: its 2**DEEPEST counters stay a bounded table.
SHALLOWEST, DEEPEST = 4, 18
#: The directory starts with so many buckets for each owner, as they are dealt out by hash; an owner's input.
BUCKETS_EACH, OWNER_MB = 8, 64
#: Up to so many chained hashes (of 8 bytes) are broadcast; more go through a shuffle.
BROADCAST_KEYS = 1_000_000


def normalised(text: Column) -> Column:
    """Null is empty; each run of white space is one space."""
    return F.regexp_replace(words_of(text), WHITE, " ")


def hashed(text: Column, key_bits: int) -> Column:
    key = F.xxhash64(text)
    return key if key_bits == 64 else F.shiftleft(key, 64 - key_bits)


def prefix_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - DEEPEST)


def directory(entries: DataFrame, bucket: int = BUCKET, least: int = SHALLOWEST) -> DataFrame:
    """(prefix, depth, bucket): the leaf of each of the deepest prefixes in use.

    A prefix starts at `least` bits; while more than `bucket` distinct hashes share it, the directory doubles and
    it is split in two: a leaf is one bit deeper for each overfull prefix above it. The last depth keeps what it gets:
    then a bucket is large, but no key is lost. All depths come from one table of 2**DEEPEST counters at most.
    """
    counts = written(entries.groupBy(prefix_of(F.col("key")).alias("prefix")).agg(F.count("*").alias("n")), "hash-counts")
    above = counts.select("prefix", "n", F.explode(F.sequence(F.lit(least), F.lit(max(least, DEEPEST - 1)))).alias("d")).withColumn("p", F.expr(f"shiftright(prefix, {DEEPEST} - d)"))
    overfull = above.groupBy("d", "p").agg(F.sum("n").alias("held")).where(F.col("held") > bucket).select("d", "p")
    deeper = above.join(F.broadcast(overfull), ["d", "p"], "left_semi").groupBy("prefix").agg(F.count("*").alias("doublings"))  # 2**DEEPEST rows at most
    leaves = counts.join(F.broadcast(deeper), "prefix", "left").select("prefix", F.least(F.lit(DEEPEST), F.lit(least) + F.coalesce("doublings", F.lit(0))).cast("int").alias("depth"))
    return written(leaves.withColumn("bucket", F.expr(f"shiftleft(shiftright(prefix, {DEEPEST} - depth), {DEEPEST} - depth)")), "hash-directory")


def placed(keyed: DataFrame, leaves: DataFrame) -> DataFrame:
    """keyed(key, ...) with the bucket of each key, looked up in the directory."""
    return keyed.withColumn("prefix", prefix_of(F.col("key"))).join(F.broadcast(leaves.select("prefix", "bucket")), "prefix").drop("prefix")


def index(entries: DataFrame, leaves: DataFrame, owners: int) -> DataFrame:
    """The entries as index files: each is an owner's buckets, sorted by hash."""
    return written(placed(entries, leaves).repartition(owners, "bucket").sortWithinPartitions("bucket", "key"), "hash-index")


def owned(rows: DataFrame, entries: DataFrame, leaves: DataFrame, n: int, owners: int) -> DataFrame:
    """rows(doc_id, key, sha) with keep_id and group_size of their key's entry.

    Rows and entries of a bucket meet at its owner. Fewer than HOT_SHARE keys have more than 1 / HOT_SHARE of the n
    rows: those are broadcast to the rows, so that no owner gets a hot one.
    """
    bound = max(64, n // HOT_SHARE)
    hot = entries.where(F.col("group_size") > bound).select("key", "keep_id", "group_size")
    cold = placed(rows.join(F.broadcast(hot.select("key")), "key", "left_anti"), leaves)
    cold = cold.select("bucket", "key", F.struct("doc_id", "sha").alias("row"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    held = entries.where(F.col("group_size") <= bound).select("bucket", "key", F.lit(None).cast(cold.schema["row"].dataType).alias("row"), "keep_id", "group_size")
    chain = Window.partitionBy("bucket", "key")
    met = cold.unionByName(held).repartition(owners, "bucket").select("key", "row", F.max("keep_id").over(chain).alias("keep_id"), F.max("group_size").over(chain).alias("group_size"))
    met = met.where("row IS NOT NULL").select("key", "row.doc_id", "row.sha", "keep_id", "group_size")
    return met.unionByName(rows.join(F.broadcast(hot), "key"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, key_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text equals the empty text. A group keeps its smallest id; rows that repeat an id and text are members of one
    group and are all marked as kept where the id is the smallest. A null id never becomes keep_id unless all ids of
    the group are null; its row is kept in that case only. An empty table gives an empty result. Other columns are ignored. key_bits
    below 64 makes hashes collide (for tests); results stay the same.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    keyed = texts.withColumn("key", hashed(F.col("norm"), key_bits))
    rows = written(keyed.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "hash-rows")
    n = rows.count()
    entries = written(rows.groupBy("key").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id")), "hash-entries")
    owners = parts_for(rows, OWNER_MB)
    leaves = directory(entries, bucket, min(DEEPEST, max(SHALLOWEST, (BUCKETS_EACH * owners - 1).bit_length())))
    entries = index(entries, leaves, owners)
    chained = entries.where("group_size > 1").select("key")
    n_chained = chained.count()
    apart = None
    if n_chained:
        chained = F.broadcast(chained) if n_chained <= BROADCAST_KEYS else chained
        # The grouping compares the bytes of the texts; a map-side pass brings the copies of each task to one row.
        classes = keyed.join(chained, "key", "left_semi").groupBy("key", "norm").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"))
        classes = written(classes.select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "hash-chains")
        collided = classes.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key")
        if collided.limit(1).count():
            # Rare: one hash, several texts. Rows of such chains are told apart by the digest of the compared bytes.
            both = F.concat("sha", F.col("key").cast("string").cast("binary")).alias("both")
            of_chains = classes.join(collided, "key", "left_semi").select(both, "keep_id", "group_size")
            apart = lookup(rows.join(collided, "key", "left_semi").select("*", both), "both", of_chains, "group_size", n).drop("both")
            entries, rows = (df.join(collided, "key", "left_anti") for df in (entries, rows))
    found = owned(rows, entries, leaves, n, owners)
    found = found if apart is None else found.unionByName(apart)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLE_SQL = {
    "op9_exact_dedup": """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
     h AS (SELECT doc_id, norm, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY norm)
""",
}

"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import drop_dir, lookup, work_dir


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v): root is the smallest node of its component.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest of them, until nothing
    changes; the number of rounds grows with the logarithm of a component's size. A round's links are written to the
    shared folder, so that no round depends on executors of an earlier one; links stay linear in the nodes. A node
    that is the centre of a large star learns its least neighbour through a broadcast of hot nodes, so that its links
    stay in the tasks that they are in. Empty links give no rows; links from a node to itself are ignored.
    """
    spark = links.sparkSession
    base, round_no = work_dir(spark, "stars"), 0

    def keep(df: DataFrame) -> tuple[DataFrame, tuple]:
        nonlocal round_no
        path, round_no = f"{base}/{round_no}", round_no + 1
        df.write.parquet(path)
        df = spark.read.parquet(path)
        # A change of the set of links changes its count or these sums.
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())

    # u is the larger end throughout.
    edges, mark = keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if not mark[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        # Large star: every neighbour larger than the node goes to the least neighbour (or the node itself).
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = lookup(both.where("v > u"), "u", least, "degree", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: the node and its smaller neighbours go to the least of them.
        large, held = keep(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = lookup(large, "u", least, "degree", held[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, now = keep(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if now == mark:
            break
        mark = now
        drop_dir(spark, f"{base}/{round_no - 3}")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent between 0 (all sources alike) and 1 (as they
are). The exponent is bisected: the largest that reaches the target entropy, and then, if some source were repeated
too often, the least larger one that keeps the repetition limit. The weights are realised as token budgets: each
source goes through its blocks of documents in a new pseudo-random order in each pass, until its budget is spent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.shared import fresh, written

#: Target entropy as a part of the largest, log2 of the number of sources; passes over a source at most.
ENTROPY, PASSES = 0.98, 4.0
#: A block has about this many documents; from MOST_BLOCKS blocks of a source on, blocks grow instead.
BLOCK_DOCS, MOST_BLOCKS = 64, 65_536
#: A block of more than OVERFULL times the documents that it should have is cut; hashes of different ids never make one.
OVERFULL = 16
#: The shares of this many sources at most are brought to the driver (about 100 bytes each); the rest is an error, not dropped.
MOST_SOURCES = 200_000
STEPS = 60


@dataclass(frozen=True)
class Plan:
    """What a source may use: exponent of the mix, and the ppm weight and token budget of each source."""

    exponent: float
    weights: dict[str | None, int]
    budgets: dict[str | None, int]


def weights(tokens: dict[str | None, int], exponent: float) -> dict[str | None, float]:
    total = sum(tokens.values())
    raw = {s: (t / total) ** exponent for s, t in tokens.items()}
    norm = math.fsum(raw.values())
    return {s: r / norm for s, r in raw.items()}


def entropy(w: dict[str | None, float]) -> float:
    return -math.fsum(x * math.log2(x) for x in w.values() if x > 0)


def bisect(ok, low: float, high: float) -> float:
    """The largest exponent in [low, high] for which ok holds, given that it holds from low up to some point."""
    if ok(high):
        return high
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def passes(tokens: dict[str | None, int], w: dict[str | None, float]) -> float:
    """How often the most repeated source is gone through when the least repeated one is gone through once."""
    use = [w[s] / t for s, t in tokens.items()]
    return max(use) / min(use)


def plan(tokens: dict[str | None, int], target: float = ENTROPY, most_passes: float = PASSES) -> Plan:
    """Sources without tokens have no weight. The budget is the least with which every source is gone through once."""
    tokens = {s: t for s, t in tokens.items() if t > 0}
    if not tokens:
        return Plan(1.0, {}, {})
    goal = target * math.log2(len(tokens)) if len(tokens) > 1 else 0.0
    exponent = bisect(lambda a: entropy(weights(tokens, a)) >= goal, 0.0, 1.0)
    if passes(tokens, weights(tokens, exponent)) > most_passes:
        exponent = 1 - bisect(lambda b: passes(tokens, weights(tokens, 1 - b)) <= most_passes, 0.0, 1 - exponent)
    w = weights(tokens, exponent)
    ppm = {s: max(1, round(x * 1e6)) for s, x in w.items()}
    # tokens[s] * sum / ppm[s] is the total with which s is gone through once: the largest serves all.
    least = max(tokens, key=lambda s: (tokens[s] / ppm[s], str(s)))
    budgets = {s: max(tokens[s], tokens[least] * p // ppm[least]) for s, p in ppm.items()}
    return Plan(exponent, ppm, budgets)


def order_of(*parts: Column) -> Column:
    """A pseudo-random order that SQL can compute as well."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def tokens_of(text: Column) -> Column:
    """Words by white space, and one for the end of the document, so that no document is free."""
    return (F.size(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))) + 1).cast("long")


def used(docs: DataFrame, id_col: str, source_col: str, text_col: str, target: float = ENTROPY, most_passes: float = PASSES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, source, n_tokens, block, digest (of source and text), and how often the mix uses it.

    The sums before a document are those of the blocks before its block (a row per block and pass) and those of the
    documents before it within the block, so no task sees all documents of a source. A block is a hash of ids; where
    many rows repeat an id, or have none and the same text, its block would be overfull: it is cut by row.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens_of(F.col(text_col)).alias("n_tokens"), digest_of(F.col(source_col), F.col(text_col)).alias("digest"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    found = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    made = plan({r["source"]: r["t"] for r in found}, target, most_passes)
    spark = docs.sparkSession
    sources = [(r["source"], r["t"], max(1, min(MOST_BLOCKS, -(-r["n"] // block_docs))), made.budgets[r["source"]], max(block_docs, r["n"] // MOST_BLOCKS)) for r in found]
    sources = spark.createDataFrame(sources, "of string, held long, blocks long, budget long, each long")
    at = F.conv(F.substring(order_of(F.lit("block"), F.coalesce(F.col("doc_id").cast("string"), F.col("digest").cast("string"))), 1, 15), 16, 10).cast("long") % F.col("blocks")
    placed = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(F.col("of"))).withColumn("block", at).withColumn("cut", F.lit(0)).drop("of")
    overfull = placed.groupBy("source", "block").agg(F.count("*").alias("n"), F.first("each").alias("each")).where(F.col("n") > OVERFULL * F.col("each"))
    overfull = written(overfull.select(F.col("source").alias("of"), F.col("block").alias("of_block"), F.ceil(F.col("n") / F.col("each")).alias("cuts")), "mix-overfull")
    if overfull.limit(1).count():
        at_block = placed["source"].eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))
        placed = placed.join(overfull, at_block, "left").withColumn("cut", F.coalesce(F.pmod(F.xxhash64("row"), F.col("cuts")), F.lit(0))).drop("of", "of_block", "cuts")
    blocks = placed.groupBy("source", "block", "cut").agg(F.sum("n_tokens").alias("in_block"), F.first("held").alias("held"), F.first("budget").alias("budget"))
    # All passes but the last take every block: only the last one needs sums.
    whole = F.floor(F.col("budget") / F.col("held")).cast("long")
    last = blocks.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("held"))
    by = Window.partitionBy("source").orderBy(order_of(F.lit("pass"), F.col("whole"), F.col("source"), F.col("block")), "block", "cut").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("before_block", F.coalesce(F.sum("in_block").over(by), F.lit(0)))
    last = last.select(F.col("source").alias("of"), F.col("block").alias("of_block"), F.col("cut").alias("of_cut"), "whole", "rest", "before_block")
    joined = placed.join(last, placed["source"].eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")) & (F.col("cut") == F.col("of_cut"))).drop("of", "of_block", "of_cut")
    inside = Window.partitionBy("source", "block", "cut").orderBy(order_of(F.lit("doc"), F.col("whole"), F.col("doc_id")), "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("before", F.col("before_block") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    uses = F.col("whole") + (F.col("before") < F.col("rest")).cast("long")
    return joined.select("doc_id", "source", "n_tokens", "block", "digest", uses.alias("uses"))


def digest_of(source: Column, text: Column) -> Column:
    return F.xxhash64(source.cast("string"), text.cast("string"))


def draws(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target: float = ENTROPY, most_passes: float = PASSES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per use of a document: doc_id, source, n_tokens, pass, block.

    Every document is used once at least, those of sources with a larger budget again, in whole passes and a last one
    that ends within a block. Null sources are a source of their own, null texts have one token; null ids and rows that
    repeat an id are drawn as their own rows. One source gives every row once; an empty table nothing. Other columns are ignored.
    """
    found = used(docs, id_col, source_col, text_col, target, most_passes, block_docs)
    return found.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), (F.col("uses") - 1).cast("int"))).alias("pass"), "block")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """docs with every row as often as the mix uses it, all columns kept. Rows alike in id, source and text are used alike, as often as the most used of them."""
    of, digest, uses, turn = fresh(docs, "__of", "__digest", "__uses", "__pass")
    plan_of = used(docs, id_col, source_col, text_col, **options).groupBy(F.col("doc_id").alias(of), F.col("digest").alias(digest)).agg(F.max("uses").alias(uses))
    found = docs.join(plan_of, docs[id_col].eqNullSafe(F.col(of)) & (digest_of(docs[source_col], docs[text_col]) == F.col(digest)))
    return found.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(uses)))).drop(of, digest, uses, turn)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "n_tokens", F.col("pass").cast("int").alias("pass"), F.col("block").cast("long").alias("block"))


def _sql() -> str:
    """The same draws in SQL; the exponent is bisected in a recursive query."""
    md5 = lambda *parts: "md5(" + " || ':' || ".join(parts) + ")"
    ent = "(SELECT -sum(w * log2(w)) FROM (SELECT pow(p, {a}) / sum(pow(p, {a})) OVER () AS w FROM share))"
    pas = "(SELECT max(u) / min(u) FROM (SELECT pow(p, {a}) / p AS u FROM share))"
    return f"""
WITH RECURSIVE r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS BIGINT) AS n_tokens FROM documents),
g AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS t, count(*) AS n FROM r GROUP BY source),
share AS (SELECT source, t / (SELECT sum(t) FROM g) AS p FROM g),
goal AS (SELECT {ENTROPY} * log2(count(*)) AS h FROM g),
e(i, lo, hi) AS (
  SELECT 0, CASE WHEN {ent.format(a="1.0")} >= (SELECT h FROM goal) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT -sum(x / s * log2(x / s)) FROM (SELECT pow(p, (lo + hi) / 2) AS x, sum(pow(p, (lo + hi) / 2)) OVER () AS s FROM share)) >= (SELECT h FROM goal) AS ok FROM e WHERE i < {STEPS})),
a1 AS (SELECT lo AS a FROM e WHERE i = {STEPS}),
f(i, lo, hi) AS (
  SELECT 0, CASE WHEN {pas.format(a="(SELECT a FROM a1)")} <= {PASSES} THEN 1 - (SELECT a FROM a1) ELSE CAST(0 AS DOUBLE) END, 1 - (SELECT a FROM a1)
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT max(pow(p, 1 - (lo + hi) / 2) / p) / min(pow(p, 1 - (lo + hi) / 2) / p) FROM share) <= {PASSES} AS ok FROM f WHERE i < {STEPS})),
a2 AS (SELECT 1 - lo AS a FROM f WHERE i = {STEPS}),
w AS (SELECT source, t, n, greatest(1, CAST(round(pow(p, (SELECT a FROM a2)) / (SELECT sum(pow(p, (SELECT a FROM a2))) FROM share) * 1e6) AS BIGINT)) AS ppm FROM g JOIN share USING (source)),
l AS (SELECT t AS lt, ppm AS lp FROM w ORDER BY t / ppm DESC, source DESC LIMIT 1),
b AS (SELECT source, t AS held, greatest(1, least({MOST_BLOCKS}, (n + {BLOCK_DOCS - 1}) // {BLOCK_DOCS})) AS blocks, greatest(t, lt * ppm // lp) AS budget FROM w, l),
q AS (SELECT r.*, held, budget, budget // held AS whole, budget - budget // held * held AS rest,
        CAST('0x' || substr({md5("'block'", "doc_id")}, 1, 15) AS BIGINT) % blocks AS block FROM r JOIN b USING (source)),
k AS (SELECT source, block, sum(n_tokens) AS t, any_value(whole) AS whole FROM q GROUP BY source, block),
kb AS (SELECT source, block, coalesce(sum(t) OVER (PARTITION BY source ORDER BY {md5("'pass'", "whole", "source", "block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_block FROM k),
z AS (SELECT q.*, before_block + coalesce(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY {md5("'doc'", "whole", "doc_id")}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q JOIN kb USING (source, block))
SELECT doc_id, source, n_tokens, CAST(unnest(range(CAST(whole + CASE WHEN before < rest THEN 1 ELSE 0 END AS BIGINT))) AS INT) AS pass, CAST(block AS BIGINT) AS block FROM z
"""


QUERIES = {"op10_source_mixing": op10_source_mixing}
ORACLE_SQL = {"op10_source_mixing": _sql()}

"""From raw documents to sharded training data: five stages, each an operator of fathom.llm.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontaminate, langid, mixing, sharding, simhash
from fathom.llm.shared import drop_dir, scratch, work_dir

#: Times the phrases per 100 symbols of held-out texts of a language beyond which it doesn't explain a text, and the least such limit. Prose that
#: whole samples learned has 17 in the tables, at most 31; other Latin-script languages have 37 and more, random letters 55, unlearned scripts 100.
FOREIGN, FOREIGN_LEAST = 1.6, 32.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no learned language: those without a letter, and those that no language explains.

    The columns stay as they are: a prediction rejects, it doesn't relabel. Without any labelled text nothing is known
    of languages, and only documents without a letter go.
    """
    samples = langid.sample(docs.where(~langid.in_fold(F.col("doc_id"))), "text", "lang")
    return langid.filter_known(docs, langid.Model(samples), langid.limits(samples, FOREIGN, FOREIGN_LEAST))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item's question and answer go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; those of sources with a larger weight again, as rows of the same columns."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns and the index of each row's shard."""
    return sharding.shard(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing), ("sharding", sharded)]

#: Language models, SimHash components and verified retrieval have no equal in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again.

    What a stage wrote for itself, and its predecessor's result, are deleted when its own is there.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_dir(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages over the documents table, each with one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's documents. All but the last return the columns of documents. Null and empty texts
leave at the first stage, which asks for ten words; repeated rows leave at the second. Every stage
judges each row by its text: null and repeated ids are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import decontaminate, minhash, mixing, pii, rules
from tributary.llm.queries import TARGETS, labelled_domains
from tributary.llm.scratch import keyed_by, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, null ids last.

    Rows are told apart by a key of their own, so that null and repeated ids are judged by their texts.
    """
    key = keyed_by(docs)
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    classes = minhash.near_duplicates(rows, id_col=key, words=5, percent=80).select(key, "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(key).alias("kept")))
    kept = rows.select(key, "doc_id").join(classes, key).groupBy("component_id").agg(least.alias("least")).select(F.col("least.kept").alias(key))
    return rows.join(kept, key, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it masked in the text."""
    return pii.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their rate and number of copies under the target weights of the domains."""
    model = mixing.learn(labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = mixing.mixed(docs, model, TARGETS, keep=tuple(docs.columns))
    return out.select(*docs.columns, *[c for c in out.columns if c not in docs.columns])


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("decontamination", decontamination), ("personal data", personal_data), ("mixing", mix)]

#: SQL can't express the MinHash classes' order of work nor the fitted rates; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs

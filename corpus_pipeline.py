"""The training-data pipeline over ``documents``.

Each stage works on all rows the one before has kept, and hands on the columns of documents; the
last returns the places of the documents in bins.  A stage's rows are written to the shared folder
and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillscan.llm import decontamination, queries, secrets, simhash, toxicity
from rillscan.llm.shared import importable, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = queries.toxicity_model(docs, labels)
    scored = docs.select(*COLUMNS).withColumn("score", toxicity.score_column(F.col("text"), model, spark))
    return scored.filter(F.col("score") < queries.TOXIC).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of the least id, null ids first.

    A row is known by its id and its text, so rows of one id with different texts are documents of their
    own; rows that agree in both are one.
    """
    docs = docs.select(*COLUMNS)
    row = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    groups = simhash.near_duplicates(docs.select(row.alias("row"), "text"), shingle=3, distance=2, id_col="row")
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    keyed = docs.withColumn("row", row)
    return keyed.join(gone, keyed.row == gone.doc_id, "left_anti").dropDuplicates(["row"]).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.with_leaks(docs.select(*COLUMNS), items)
    return found.filter(F.size("leaks") == 0).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    found = secrets.scan(docs.select(*COLUMNS))
    marked = F.when(F.size("spans") > 0, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.withColumn("text", marked).withColumn(
        "n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def in_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document: bin, start, length."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("best_fit_packing", in_bins),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = written(docs)
    return docs

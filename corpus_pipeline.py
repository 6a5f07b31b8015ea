"""A corpus made ready for training: judged, deduplicated, freed of benchmarks and personal data, packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
A stage's result is written before the next one reads it. Nulls, empty and long texts, repeated rows, empty tables and more
columns are as each operator's module says; ids may be null or repeated: the near-duplicate
stage goes by rows, and keeps one of rows that share doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import decontam, jaccard, packing, pii, quality
from wakeline.llm.queries import tokenizer_path
from wakeline.llm.store import Scratch, unused


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the document with the smallest id."""
    rows, row = docs, "doc_id"
    if not docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():  # ids do not tell rows apart: numbers in the order of ids do
        (row,) = unused(docs, "row")
        rows = Scratch(spark, "rows").keep(docs.orderBy(F.asc_nulls_last("doc_id"), "text").withColumn(row, F.monotonically_increasing_id()))
    linked = jaccard.link(rows, k=5, percent=80, doc_id=row)
    first = linked.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(row))
    kept = rows.join(first, row, "left_semi").select(*docs.columns)
    return kept if row == "doc_id" else kept.dropDuplicates(["doc_id", "text"])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window of ten words."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get pseudonyms, under the session's key or one of this run alone; n_chars follows the text."""
    return pii.pseudonymise(docs, pii.session_key(spark)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack(packing.tokenise(docs, tokenizer_path()))


STAGES = [("quality", judged), ("near_duplicates", deduplicated), ("decontamination", decontaminated), ("pseudonyms", pseudonymised), ("packing", packed)]

#: No stage but the last but one could be said in SQL within reason; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs

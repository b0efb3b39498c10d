"""The corpus pipeline: documents in, weighted training documents out.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame; all
but the last return the columns of documents. run() writes each stage's rows to the shared folder, reads them again
for the next one, and deletes them once that is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriloom.llm import decontamination, jaccard_join, mixing, suffix_dedup, toxicity
from fabriloom.llm.common import discard, fresh, small_batches, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    small_batches(spark)
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def by_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the name of a column that names each row: doc_id if no two rows share one and none is null; else docs
    with a number for each row, written so that the numbers stay."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).isEmpty():
        return docs, "doc_id"
    row = fresh("row", docs)
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of docs that gone doesn't name."""
    names = [F.col(f"`{n}`") for n in docs.columns if n != row or n == "doc_id"]
    return docs.join(gone.distinct(), row, "left_anti").select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the row of the least doc_id stays, or, where doc_ids repeat or are null in the
    table, the first row of the group in it. Documents without words all stay. Unlike texts never count as one
    document, even if they share a doc_id."""
    small_batches(spark)
    docs, row = by_row(docs)
    found = jaccard_join.components(docs.select(F.col(row).alias("doc_id"), "text"))
    return without(docs, row, found.where("class is not null and doc_id <> component_id").select(F.col("doc_id").alias(row)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 or more that repeat anywhere are cut out of the texts; documents with nothing left go. Null and
    empty texts pass as they are."""
    small_batches(spark)
    had = F.coalesce(F.length("text"), F.lit(0)) > 0
    return suffix_dedup.remove_repeats(docs.where(had)).where(had).unionByName(docs.where(~had))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, each judged by its own text, whatever its doc_id."""
    small_batches(spark)
    docs, row = by_row(docs)
    found = decontamination.occurrences(docs.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, row, found.where("start is not null").select(F.col("doc_id").alias(row)))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets the rate at which it is to be repeated, so that domains meet their target weights."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", weigh),
]

#: Trained models, connected components and descent steps can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = None
    for name, function in STAGES:
        docs, before = stage(function(spark, docs, sf_dir), name), kept
        if before is not None:  # what the stage read is no longer needed
            discard(before)
        kept = docs
    return docs

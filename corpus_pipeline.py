"""The corpus pipeline: documents through filters, deduplication and packing; each stage is written and read again.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the
last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import minhash, packing, quality_rules, substring_dedup, toxicity
from skeinwork.llm.common import keyed, work_dir
from skeinwork.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts have no words and fail; repeated rows and null ids are judged row by row."""
    return quality_rules.kept_documents(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier passes; it is trained on the labelled rows that reach this stage.

    Without any of them nothing is learned and all rows pass or fail by the share of label 1. Rows with a null id are never trained on.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_documents(docs, toxicity.train(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: shingles of five words, similarity 0.8 or more.

    Rows that repeat an id, or have none, are documents of their own, so equal ones are near-duplicates too; texts without words
    are linked with nothing and stay.
    """
    rows = keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), work_dir(spark, "one-of-each"))
    found = minhash.near_duplicates(rows.select(F.col("_rk").alias("doc_id"), "text"), shingle=5)
    return rows.select("row", "_rk").join(found.where("kept").select("_rk"), "_rk", "left_semi").select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a document that loses all its words stays, with empty text."""
    return substring_dedup.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequence and place; a null or empty text is its end id alone, an empty table gives no rows."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("MinHash near-dedup", one_of_each),
    ("substring dedup", without_repeats),
    ("best-fit packing", packed),
]

#: Learned scores and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

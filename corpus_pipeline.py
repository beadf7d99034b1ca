"""The pipeline over `documents`: quality, toxicity, near duplicates, secrets, packing.

Each stage works on what its predecessor kept, written as Parquet and read again. All but the last return the columns of
`documents`. SQL can't state the trained stages, so ORACLE_SQL is None and tests compare the stages with plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import cotraining, cutting_stock, secret_scan, tensored_minhash, toxicity_chain
from riskloom.llm.common import stored, table


def kept_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id `verdicts` (doc_id, kept) does not reject. Rows without a doc_id stay."""
    rejected = verdicts.where("NOT kept").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier (operator 5) rejects go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return kept_rows(docs, cotraining.score(docs, cotraining.train(docs, labels)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain (operator 2) calls toxic go."""
    setting = toxicity_chain.ChainSetting()
    sample = toxicity_chain.categories_of(table(spark, sf_dir, "labels"), docs, setting)
    scored = toxicity_chain.score(docs, toxicity_chain.train(sample, setting=setting))
    return kept_rows(docs, scored.select("doc_id", (~F.col("toxic")).alias("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (operator 6; five words, similarity 0.8) the smallest doc_id stays.

    Rows that repeat a doc_id are one document, of which one row stays.
    """
    groups = tensored_minhash.near_duplicates(docs)
    one = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id IS NULL"))
    return kept_rows(one, groups)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets (operator 4) give way to a mark in the text; n_chars follows where a text changed."""
    model = secret_scan.train(secret_scan.samples(docs), documents=docs)
    found = secret_scan.scan(docs, model)
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("spans")))
    changed = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens (operator 9)."""
    return cutting_stock.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

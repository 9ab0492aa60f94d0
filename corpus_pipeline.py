"""The training-data pipeline: quality rules, near duplicates, secrets, mixing, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all rows its
predecessor kept. All but the last return the columns of ``documents``. ``run`` writes each stage as Parquet
in the shared folder of ``spark.checkpoint.dir`` and reads it again, so that a lost executor repeats no
earlier stage.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketlens.llm import mixing, quality_rules, secret_index, simhash_variants, tree_bpe
from docketlens.llm.queries import vocabulary
from docketlens.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failed lines leave the others."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash_variants.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text is replaced by its kind."""
    return secret_index.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes; the last copy of a budget is cut at the budget."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, with what they decode to; few words are kept per worker, which holds other stages' memory."""
    out = tree_bpe.encode(docs, vocabulary("word_bpe_49k.json"), "bare", keep=["doc_id", "source", "n_chars"], cached=100_000)
    return out.select("doc_id", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secret scans", secrets), ("mixing", mix), ("tokens", tokens)]

# SQL has neither the fingerprints nor the vocabulary; the tests hold run() against a plain program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs

"""A corpus pipeline: quality filter, near-duplicate removal, source mixing, tokenization.

``STAGES`` holds (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_documents
from tidemark.llm.common import materialize
from tidemark.llm.mixing import mix_documents
from tidemark.llm.ngram_join import keep_one
from tidemark.llm.quality import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    Null and empty texts go or stay by the score of a text of length 0, repeated rows
    together. Like all stages, it leaves an empty table empty and keeps extra columns.
    """
    return keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id.

    Documents without words are nobody's copies and stay; null ids come last in a group.
    """
    return keep_one(spark, docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Documents without words are not taken; a null source is a source of its own.
    """
    return mix_documents(spark, docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy, and hashes of the ids and of the text that they decode to.

    Null and empty texts have no ids; repeated rows have a row each.
    """
    encoded = encode_documents(spark, docs)
    return encoded.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mix_to_weights),
    ("BPE encoding and decoding", tokenize),
]

# the classifier's compressed sizes, the mix's draws and the vocabulary have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)

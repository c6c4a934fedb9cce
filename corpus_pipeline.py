"""A corpus pipeline: toxicity, near duplicates, secrets, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet in the shared folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinthread.llm import bpe, jaccard, mixing, secrets, toxicity
from kinthread.llm.common import scratch_path
from kinthread.runtime import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from ``labels``.

    Rows are judged each by their whole text: repeated rows alike, null and empty
    texts as a text without a word, which is kept. Columns of any names stay; no
    rows, or no labels, reject nothing.
    """
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_harmless(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; a link is a Jaccard similarity of 0.8 or more over five words.

    Links come from the anchor-point covering of SimHash fingerprints, confirmed
    exactly, and are completed to all there are. A group keeps its smallest
    doc_id (null last), of rows that share it one. Null and empty texts are one
    group. Columns of any names and types stay; no rows give none.
    """
    ship(spark)
    return jaccard.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked, n_chars recounted there.

    Null, empty and other texts without secrets stay as they are, as do repeated
    rows and columns of any names; no rows give none.
    """
    ship(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, unchanged; at most three times.

    Null and empty texts have no words and aren't taken. A null source is one of
    its own. Repeated rows count each, ties are settled by the rows' hashes.
    Columns of any names and types stay; no rows give none.
    """
    ship(spark)
    return mixing.mixed_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids of every row, and a digest of what they decode to.

    Null and empty texts have no ids; repeated rows and null doc_ids keep their
    rows; other columns are left; no rows give none.
    """
    ship(spark)
    return bpe.decode(bpe.encode(docs)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Fitted classifiers and BPE can't be told in SQL; tests compare with a brute-force version.
ORACLE_SQL = None

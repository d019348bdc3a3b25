"""From raw documents to token ids: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as Parquet and read again as the next stage's
``docs``. All but the last return the columns of ``documents``; the last returns doc_id, ids, n_tokens, ids_sha256 and
decoded_sha256.

In every stage a null text counts as an empty one and stays null where its row stays, rows without an id are treated like
others, further columns of any name are kept, and no rows give no rows. Nothing is cut off: long texts are taken whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from surveyframe.llm import bpe, cuckoo, decontam, queries, simhash, toxicity
from surveyframe.llm.common import remove, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last link of the chain says toxic go, a probability of one half included. Equal texts go or stay together."""
    chain = toxicity.train(docs, queries.table(spark, sf_dir, "labels"), queries.categories())
    return toxicity.drop_toxic(docs, chain)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; a null id is smaller than any other, and of rows equal in id and
    text one stays."""
    return cuckoo.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 of their shingles of five words, directly or through others, the one with the
    smallest id stays; a null id is larger than any other. Texts without words are similar to each other. No link is lost."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go. Items without words mark nothing."""
    return decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"), remove="documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digests of the ids and of what they decode to; an empty text has no ids."""
    return bpe.round_trip(docs, queries.RANKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: The first stage's model can't be expressed in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The tables between them lie in the shared folder; each goes when the next is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages but the
last return the columns of ``docs`` and drop whole rows only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesieve.llm import packing
from sitesieve.llm.common import row_key, saved, table
from sitesieve.llm.near_dup import near_duplicates
from sitesieve.llm.quality_classifier import quality_scores
from sitesieve.llm.quality_rules import keep_rows, quality_verdicts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and are no robust outliers of their language and source.

    A null text is empty and goes; very long ones are judged whole; repeated rows stay or go together; an empty
    table gives an empty result.
    """
    return keep_rows(docs, quality_verdicts(docs).where("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    It is fitted on the whole documents table: what the rules before rejected is what it has to know.
    Null and empty texts have statistics of zero; repeated rows have equal scores; an empty table gives an empty result.
    """
    found = quality_scores(docs, table(spark, sf_dir, "labels"), train=table(spark, sf_dir, "documents"))
    return keep_rows(docs, found.where("predicted = 1"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more).

    Rows go by doc_id and text: different texts under one doc_id, and rows without doc_id, are judged each on their own;
    rows alike in both are one document, whatever their other columns say.  Empty texts are copies of nothing.
    An empty table gives an empty result.
    """
    kept = keep_rows(docs, near_duplicates(docs, k=5, threshold=0.8).where("chosen"))
    return kept.withColumn("__key", row_key(docs)).dropDuplicates(["__key", "doc_id"]).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids, packed into sequences of at most 1024.

    A null text is empty: one piece, the end id alone.  Long texts are cut; repeated rows have pieces each; an empty
    table gives an empty result.
    """
    pieces = packing.tokenised(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("minhash_dedup", minhash_dedup),
    ("packing", pack_sequences),
]

#: The stages hold fitted models, a randomised search and a tokenizer: not SQL.  Tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs

"""A corpus from raw documents to token ids: rules, classifier, near-duplicates, mixture, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return the
columns of ``docs``, among them columns named like an operator's own. Null, empty and blank texts are short texts to the rules
and go there; stages called by themselves treat them as their operators say. Very long texts are read whole, repeated rows are
judged alike and are copies to the near-duplicate stage, rows without an id stay rows, and an empty table gives an empty table. :func:`run` writes each stage to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadlake.llm import bpe, classifier, mixing, rules, shingles
from leadlake.llm.base import table
from leadlake.session import shared_folder


#: The share of tokens that the mixture keeps, whatever rare categories there are.
KEEP = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of policy v2."""
    return rules.only_passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as good; learnt from the labels of those that came here."""
    return classifier.only_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id: of each SimHash component first, then of each component of
    what is left whose five-word shingles have a Jaccard similarity of 0.8 or more, which 2 bits of a fingerprint seldom show.
    One reading of the texts serves both.
    """
    return shingles.one_of_each(docs, radius=2)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: float = KEEP) -> DataFrame:
    """Documents with a share of the tokens, sampled so that sources, languages and topics stand in their tempered proportions."""
    return mixing.sampled(docs, keep=keep)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    return bpe.encoding_digests(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "source", "lang"))


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("simhash_near_dedup", near_dedup), ("mixing", mixture), ("bpe_encoding", encoding)]

#: SQL cannot express fingerprints, the classifier or the encoding; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, keep: float = KEEP) -> DataFrame:
    """All stages over ``documents``; the mixture keeps ``keep`` of the tokens."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir, keep) if stage is mixture else stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

"""Corpus preparation in stages; each works on all that the one before it kept.

All stages but the last return the columns that they are given, whatever others there are beside doc_id, text, lang and
source. Null and empty texts have no words and fail the base rules of the first stage; given to a later stage on their
own, they are linked with nothing, clean, masked as they are and encoded as no tokens. A null doc_id has no label and is
never a near duplicate; rows that repeat a doc_id are judged alike and stay or go together; a null language is one of its
own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.llm.bpe import default_vocabulary, encode_and_decode
from marketpanel.llm.common import table
from marketpanel.llm.decontaminate import drop_contaminated
from marketpanel.llm.near_dup import drop_near_duplicates
from marketpanel.llm.pii import redact
from marketpanel.llm.quality_rules import keep_good
from marketpanel.sources.sinks import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at a similarity of 0.8."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no benchmark item is covered to the threshold."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of all documents."""
    coded = encode_and_decode(docs, default_vocabulary())
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", privacy),
    ("byte-pair encoding", tokens),
]

# Near duplicates, tiling, boosted trees and merges are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

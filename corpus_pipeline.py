"""The corpus pipeline: quality rules, near-dedup, secret scan, mixing, packing.

Each stage takes all rows that the one before kept; all but the last return
the columns of documents, any others too. run() writes each stage's rows to the
shared folder, goes on from there, and deletes what the stage had put there itself.

Null and empty texts have too few words for the quality rules and go there;
null doc_id, lang or source stay as they are; of repeated rows near-dedup keeps
one; an empty table gives no pieces. Texts are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, quality_rules, secrets, simhash
from tidemark.llm.common import table, text_column
from tidemark.shared import fresh_path, remove, scratch

#: Whose ids packing counts; mixing counts the pieces that its pre-tokenizer makes.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Shares of pieces that the mixed corpus should have, by domain of `labels`. No document is repeated.
TARGETS = {"good": 0.97, "toxic": 0.02, "junk": 0.01}


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits of their language and source."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near copies."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the rates that bring the domains to TARGETS; a rate of 1 or more always stays."""
    return mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), TARGETS, max_rate=1.0, tokens=mixing.pieces(text_column()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens, each window with the sources' shares of the mixed corpus."""
    return packing.pack(docs, TOKENIZER, end_id=2, with_ids=False)


STAGES = [("quality rules", rules), ("near-dedup", near_dedup), ("secret scan", secret_scan), ("mixing", mix), ("packing", pack)]

#: The models of the mixing stage and the token ids of packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            remove(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

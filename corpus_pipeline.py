"""From raw documents to token ids: five stages, each on all that the one before has kept.

Toxic documents go; of near duplicates one document stays; strings that repeat are taken out of
the texts; sources are mixed to their target weights; the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.llm import bpe, mixing, simhash, suffix, toxicity
from lendlens.llm.common import importable, table
from lendlens.llm.queries import tokenizer_path
from lendlens.session import settle, tune


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold of the toxicity query."""
    importable(tune(spark))
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints of three-word shingles link within two bits."""
    importable(tune(spark))
    return simhash.keep_one(docs, width=3, radius=2)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 400 bytes and passages of over 50 words that also start elsewhere."""
    importable(tune(spark))
    return suffix.without_repeats(docs, words=51)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    importable(tune(spark))
    return mixing.take_copies(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row of the mix: its id and token ids, and whether they decode to the tokens of its text."""
    importable(tune(spark))
    done = bpe.encode(docs, tokenizer_path(), decoded=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: SQL can't express a trained classifier, fingerprints of shingles or BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: toxic documents go, repeated lines go, near copies go, sources are mixed, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents.

Defined results: what the operators say of nulls, empty and long texts, ties, repeated rows and extra columns holds in
each stage; documents without text pass the first stages and meet as copies of each other in the third; an empty
table passes all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlex.llm import byte_bpe, dart_minhash, fuzzy_lines, mixing, toxicity
from lumenlex.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones among them, scores below 0.5."""
    return toxicity.accepted(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has in like words."""
    return fuzzy_lines.deduplicated(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return dart_minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents of each source as its budget takes, repeated where that is more than it has."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix."""
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The stages train a network and follow sketches, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training-data pipeline over ``documents``: five stages, each reading what the one before has kept.

Toxic documents go; recurring lines go, and with them documents that hold nothing else; of near-duplicates one stays;
documents that hold a benchmark passage go; what is left is tokenised and packed into sequences. Each stage's output
is written as Parquet in the shared folder and read again, so that a lost executor costs no more than its own stage.

Null and empty texts are neither toxic nor copies and have no lines to lose: they stay, as documents of one token.
Rows without a doc_id pass all stages. Repeated rows stay, as one document, in all stages but packing, which packs each.
Whatever columns documents have, and whatever their names, all stages but the last return them. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlspike.llm import decontamination, lines, minhash, packing, toxicity
from marlspike.llm.common import Scratch, table

#: The tokenizer's file; None for the one that the packing query uses.
VOCABULARY: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents of the whole table outside op9's held-out fold, scores and filters those in docs."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines but the first, and documents that hold nothing else."""
    return lines.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, from a similarity of 0.8 on, the one with the smallest doc_id stays."""
    return minhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, VOCABULARY or public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Tokenising and scoring can't be expressed in SQL; tests/llm compares run() with a version by hand, places and checksums included.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs

"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

In every stage but the last, further columns stay as they are, whatever their names; an empty table gives none, and very
long texts are read in parts or as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontamination, near_dedup, packing, secret_scan, toxicity
from docloom.llm.common import clear_stored, stored, stored_so_far, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to the labelled ones among docs, rejects go.

    Rows without text have nothing to reject and stay, as do all where no labels of both classes are known; a null doc_id has no
    label; repeated rows are judged each.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least doc_id; repeated rows and rows without words are copies of each other, a null doc_id comes last."""
    return near_dedup.without_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item occur go; rows without words stay, repeated rows share their fate."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out of the texts and n_chars follows; all documents stay, null texts as null."""
    return secret_scan.masked(secret_scan.scan(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences, neighbours on the curve together; each row, repeated ones too, is a document, a null text has the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Signatures, the language model and the packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again, and what it stored on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = stored_so_far()
        docs = stored(stage(spark, docs, sf_dir), name)
        clear_stored(spark, mark, keep_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)

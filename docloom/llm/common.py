"""Helpers that several operators share: shared storage, size-checked broadcasts, text expressions."""

from __future__ import annotations

import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its counted rows times its row width stay below this.
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session, as in tests, gets one of its own; a cluster has none to offer and fails."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_stored: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # the default codec holds direct buffers that only a collection frees
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_so_far() -> int:
    """A mark for clear_stored."""
    return len(_stored)


def clear_stored(spark: SparkSession, since: int = 0, keep_last: bool = False) -> int:
    """Deletes what this session has stored since a mark (but for the last table), once the results that read it are written; returns how many folders."""
    jvm = spark.sparkContext._jvm
    end = len(_stored) - keep_last
    gone, n = _stored[since:end], 0
    del _stored[since:end]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


#: Bytes of an Arrow batch, so that long texts don't fill a worker.
BATCH_BYTES = 4 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES; a batch has one row at least."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", spark.conf.get(key).lower()).groups()
    size = int(number) << 10 * " kmgtp".index(unit[:1] if unit[:1] in "kmgtp" and unit else " ")
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def wrapped(documents: DataFrame) -> DataFrame:
    """(text, document): the text, never null, and all else of documents(text, ...) in one column that no name can clash with."""
    rest = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != "text"))
    document = F.struct(rest.alias("rest"), F.col("text").isNull().alias("no_text"))
    return documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), document.alias("document"))


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The documents with these columns that wrapped has made rows(text, document) of."""
    text = F.when(~F.col("document.no_text"), F.col("text"))
    return rows.select(*((text if c == "text" else F.col(f"document.rest.`{c}`")).alias(c) for c in columns))


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows of df, at so many bytes each, are within the limit."""
    bound = limit // row_bytes
    return df.limit(bound + 1).count() <= bound


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits; else with one for a sort-merge join, whose hot keys adaptive execution splits."""
    return F.broadcast(df) if fits(df, row_bytes, limit) else df.hint("merge")


def broadcast_by_bytes(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """As maybe_broadcast for rows of any width, whose bytes are summed."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= limit else df.hint("merge")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; texts of ASCII only take the quicker built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def code_words(text: Column) -> Column:
    """Lower-cased runs of 0-9, a-z and all beyond ASCII; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def joined_sha(strings: Column) -> Column:
    """Lowercase hex SHA-256 of the strings, comma-joined."""
    return F.sha2(F.array_join(strings, ","), 256)

"""Documents from files and from text columns, as rows (path, md, mtime_ms, error)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.expr import is_markdown
from docloom.markdown.paths import MARKDOWN_EXTENSIONS

#: Largest accepted raw text, in bytes; files have no limit unless one is given.
RAW_TEXT_BYTES = 32 * 1024 * 1024
GLOB = "*.{" + ",".join((*MARKDOWN_EXTENSIONS, *(e.upper() for e in MARKDOWN_EXTENSIONS))) + "}"


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None, glob: str = GLOB) -> DataFrame:
    """All Markdown files below a path; one too large has an error and no text, and never fails the batch.

    Bytes that are not UTF-8 become replacement characters. The names and the size limit reach the scan: of a file that is
    too large only its entry is read.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    rows = rows.where(is_markdown(F.col("path")))
    entry = (F.regexp_replace("path", r"^file:(?://)?", "").alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"))
    text = F.make_valid_utf8(F.col("content").cast("string")).alias("md")
    if max_bytes is None:
        return rows.select(entry[0], text, entry[1], F.lit(None).cast("string").alias("error"))
    small = rows.where(F.col("length") <= max_bytes).select(entry[0], text, entry[1], F.lit(None).cast("string").alias("error"))
    large = rows.where(F.col("length") > max_bytes).select(entry[0], F.lit(None).cast("string").alias("md"), entry[1], F.lit(f"larger than {max_bytes} bytes").alias("error"))
    return small.union(large)


def from_text(rows: DataFrame, name: str, md: str, max_bytes: int = RAW_TEXT_BYTES) -> DataFrame:
    """Raw texts as documents without a folder or a time; a blank name becomes document.md."""
    small = F.octet_length(F.coalesce(F.col(md), F.lit(""))) <= max_bytes
    return rows.select(
        F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", "document.md").otherwise(F.col(name)).alias("path"),
        F.when(small, F.coalesce(F.col(md), F.lit(""))).alias("md"),
        F.lit(None).cast("long").alias("mtime_ms"),
        F.when(~small, F.lit("text too large")).alias("error"),
    )


def read_assets(spark: SparkSession, images: DataFrame, path: str) -> DataFrame:
    """images(doc, file) with length and content of the files below a path; a file outside it has neither."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.regexp_replace("path", r"^file:(?://)?", "").alias("file"), "length", "content")
    return images.join(files, "file", "left")

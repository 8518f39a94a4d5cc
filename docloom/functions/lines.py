"""Markdown by lines alone: the dialect that column expressions, and so SQL, can tell.

Fences are told by parity of fence lines, so their characters, lengths and nesting are ignored; the
parser is exact where a document needs that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE_LINE = r"^ {0,3}(```|~~~)"


def split_lines(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """(key, line_no, line, fenced, fence, fence_no) for each line: whether it is inside a fence, is a fence line, and the fence lines up to it.

    The fence lines of a document are found within its row, so no line leaves its task.
    """
    rows = docs.select(key, F.split(md, "\n").alias("lines"))
    rows = rows.withColumn("at", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(FENCE_LINE), i)), lambda i: i.isNotNull()))
    rows = rows.select(key, "at", F.posexplode("lines").alias("line_no", "line"))
    number = F.size(F.filter("at", lambda i: i <= F.col("line_no"))).cast("long")
    fence = F.array_contains("at", F.col("line_no"))
    rows = rows.withColumns({"fence_no": number, "fence": fence})
    return rows.select(key, F.col("line_no").cast("long").alias("line_no"), "line", (F.col("fence") | (F.col("fence_no") % 2 == 1)).alias("fenced"), "fence", "fence_no")


HEADING = r"^#{1,6}[ \t]+\S"


def heading_text(line: Column) -> Column:
    """Text of an ATX heading, null for other lines."""
    text = F.trim(F.regexp_replace(F.regexp_replace(line, r"^#{1,6}[ \t]+", ""), r"[ \t]+#+[ \t]*$", ""))
    return F.when(line.rlike(HEADING), text)


def headings(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, level, text) of the ATX headings outside fences."""
    h = lines.where(~F.col("fenced") & F.col("line").rlike(HEADING))
    return h.select(key, "line_no", F.length(F.regexp_extract("line", r"^(#{1,6})", 1)).cast("long").alias("level"), heading_text(F.col("line")).alias("text"))


def heading_slug(text: Column) -> Column:
    """Id of a heading before it is numbered: letters and digits of ASCII, dashes for spaces."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9 _-]", ""), r"[ _]", "-")
    return F.when(out == "", "heading").otherwise(out)


def numbered_slugs(heads: DataFrame, key: str = "doc_id") -> DataFrame:
    """headings with slug: repeats within a document get -1, -2 and so on."""
    w = Window.partitionBy(key, "base").orderBy("line_no")
    rows = heads.withColumn("base", heading_slug(F.col("text")))
    n = F.row_number().over(w) - 1
    return rows.withColumn("slug", F.when(n == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string")))).drop("base")

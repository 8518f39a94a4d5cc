"""Markdown made from the columns of documents, by one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import table

_LINES = (
    "'---'",
    "'title: Title ', doc_id",
    "'lang: ', lang",
    "'---'",
    "'# Doc ', doc_id, ' ', lang",
    "''",
    "'See [[Page', doc_id % 7, '|alias ', lang, ']], [[', source, '#part]] and [[v1.2]].'",
    "''",
    "'## Part ', source",
    "''",
    "'```', CASE lang WHEN 'en' THEN 'go' WHEN 'de' THEN 'Mermaid' WHEN 'fr' THEN 'md' ELSE '' END",
    "'# not a heading'",
    "'```'",
    "''",
    "'> [!', CASE doc_id % 3 WHEN 0 THEN 'NOTE' WHEN 1 THEN 'tip' ELSE 'Warning' END, ']'",
    "'> Body ', doc_id",
    "''",
    "'::: ', CASE doc_id % 3 WHEN 0 THEN concat('tip Title ', lang) WHEN 1 THEN 'Warning' ELSE '{.note .wide #s1}' END",
    "'inside'",
    "':::'",
    "''",
    "'*[le]: article ', lang",
    "'*[la]: artículo'",
    "'*[le]: last ', doc_id % 4",
    "''",
    "'E = mc^2^ and H~2~O with ==m', lang, '== and ++i', doc_id, '++ plus $a_', doc_id % 5, '$.'",
    "''",
    "'[x](docs/p', doc_id % 9, '.md#s) [y](https://example.com/', doc_id, ') [z](../img/', source, '.png) [w](#top)'",
    "''",
    "'![pic ', lang, '](img/', source, '.png) <https://example.org/', doc_id, '> ~~old~~ :rocket: :nothing: :+1:'",
    "''",
    "'Claim[^n', doc_id % 3, '] and again[^n', doc_id % 3, '], not[^none].'",
    "''",
    "'[^n', doc_id % 3, ']: note of ', source",
    "''",
    "'| Name | Use |'",
    "'|:-----|----:|'",
    "'| ', lang, ' | ', doc_id % 11, ' |'",
    "'| b ', chr(92), '| c |'",
    "''",
    "'Term ', lang",
    "': meaning ', doc_id % 5",
    "': second'",
    "''",
    "'- [x] done'",
    "'- [ ] open ', doc_id % 2",
    "''",
    "'## Part ', source",
    "''",
    "text",
)
#: SQL expression over documents.
MD = "concat(" + ", chr(10), ".join(_LINES) + ")"
#: The same as common table expressions for DuckDB: md(doc_id, lang, md) and lines(doc_id, line_no, line, fence, fenced).
MD_SQL = f"md AS (SELECT doc_id, lang, {MD} AS md FROM documents)"
LINES_SQL = rf"""{MD_SQL},
raw_lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(md, chr(10)) AS l FROM md)),
fences AS (SELECT *, regexp_matches(line, '^ {{0,3}}(```|~~~)') AS fence FROM raw_lines),
lines AS (SELECT doc_id, line_no, line, fence, fence OR sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS fenced FROM fences)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, path, md)."""
    return made(table(spark, sf_dir, "documents"))


def made(rows: DataFrame) -> DataFrame:
    """The same of given rows; DuckDB's concat takes a null column as empty, Spark's makes the whole text null."""
    return rows.select("doc_id", "lang", F.expr("concat('docs/', source, '/d', doc_id, '.md')").alias("path"), F.expr(MD).alias("md"))

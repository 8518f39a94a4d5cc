"""Queries over Markdown by lines: outlines, code, alerts, containers, abbreviations, inline marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import expr as X
from docloom.functions import lines as L
from docloom.plans.synthetic import LINES_SQL, MD_SQL, documents


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split_lines(documents(spark, sf_dir))


def outline(spark, sf_dir):
    return L.headings(_lines(spark, sf_dir))


def toc_by_doc(spark, sf_dir):
    h = L.numbered_slugs(outline(spark, sf_dir))
    rows = h.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "level", "text", "slug"))).alias("t"))
    return rows.select("doc_id", F.array_join(F.transform("t", lambda e: F.concat_ws("|", e["level"].cast("string"), e["text"], e["slug"])), ";").alias("toc"))


def first_h1_title(spark, sf_dir):
    h = outline(spark, sf_dir).where("level = 1 AND text <> ''")
    return h.groupBy("doc_id").agg(F.min_by("text", "line_no").alias("title"))


def code_langs(spark, sf_dir):
    f = _lines(spark, sf_dir).where("fence AND fence_no % 2 = 1")
    return f.groupBy(F.lower(F.trim(F.regexp_replace("line", r"^ {0,3}[`~]+", ""))).alias("lang")).agg(F.count("*").alias("blocks"))


def fence_dispatch(spark, sf_dir):
    f = _lines(spark, sf_dir).where("fence AND fence_no % 2 = 1")
    lang = F.lower(F.trim(F.regexp_replace("line", r"^ {0,3}[`~]+", "")))
    role = F.when(lang == "mermaid", "diagram").when(lang.isin("markdown", "md", "mdc", "mdx", "mkd"), "embed").otherwise("code")
    return f.select("doc_id", "line_no", role.alias("role"))


def alerts(spark, sf_dir):
    a = _lines(spark, sf_dir).where(~F.col("fenced"))
    kind = F.lower(F.regexp_extract("line", r"^ {0,3}> ?\[!((?i:note|tip|important|warning|caution))\][ \t]*$", 1))
    return a.select("doc_id", "line_no", kind.alias("alert")).where("alert <> ''")


def containers(spark, sf_dir):
    c = _lines(spark, sf_dir).where(~F.col("fenced") & F.col("line").rlike(r"^ *:{3,}[ \t]*\S"))
    info = F.trim(F.regexp_replace("line", r"^ *:{3,}", ""))
    return c.select("doc_id", "line_no", X.container_info(info).alias("i")).select("doc_id", "line_no", "i.callout", "i.title", "i.classes", F.col("i.id").alias("html_id"))


def abbr_defs(spark, sf_dir):
    d = _lines(spark, sf_dir).where(~F.col("fenced"))
    pattern = r"^\*\[([^\]]+)\]:[ \t]*(.+?)[ \t]*$"
    d = d.where(F.col("line").rlike(pattern)).select("doc_id", "line_no", F.trim(F.regexp_extract("line", pattern, 1)).alias("key"), F.regexp_extract("line", pattern, 2).alias("title"))
    return d.groupBy("doc_id", "key").agg(F.max_by("title", "line_no").alias("title"))


def abbr_uses(spark, sf_dir):
    """How often each key that a document defines occurs as a word in its lines that define nothing."""
    rest = F.array_join(F.filter(F.split("md", "\n"), lambda x: ~x.startswith("*[")), "\n")
    rows = documents(spark, sf_dir).select("doc_id", rest.alias("rest")).join(abbr_defs(spark, sf_dir).select("doc_id", "key"), "doc_id")
    return rows.select("doc_id", "key", F.regexp_count("rest", F.concat(F.lit(r"(?<![0-9A-Za-z_])\Q"), "key", F.lit(r"\E(?![0-9A-Za-z_])"))).cast("long").alias("uses"))


def wikilinks(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(X.wikilink_inner(F.col("md"))).alias("n", "inner"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), X.wikilink(F.col("inner")).alias("w")).select("doc_id", "n", "w.href", "w.shown")


def _marked(lines: DataFrame, **patterns: str) -> DataFrame:
    """(doc_id, line_no, ...) of every line outside fences that has some of the patterns' first groups, comma-joined."""
    found = [F.array_join(F.regexp_extract_all("line", F.lit(p), F.lit(1)), ",").alias(name) for name, p in patterns.items()]
    return lines.where(~F.col("fenced")).select("doc_id", "line_no", *found).where(" OR ".join(f"{name} <> ''" for name in patterns))


def sup_sub(spark, sf_dir):
    """Superscripts and subscripts of every line outside fences."""
    return _marked(_lines(spark, sf_dir), **SCRIPTS)


def mark_ins(spark, sf_dir):
    """Marked and inserted text of every line outside fences."""
    return _marked(_lines(spark, sf_dir), **MARKS)


SCRIPTS = {"sups": r"\^([^ \t\r\f^]+)\^", "subs": r"~([^ \t\r\f~]+)~"}
MARKS = {"marks": r"==([^=]+)==", "inss": r"\+\+([^+]+)\+\+"}
FRONT = r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)"


def front_matter(spark, sf_dir):
    """Flat keys of the front matter."""
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.split(F.regexp_extract("md", FRONT, 1), "\n")).alias("line"))
    rows = rows.select("doc_id", F.regexp_extract("line", r"^([A-Za-z0-9_-]+): ", 1).alias("key"), F.regexp_extract("line", r"^[A-Za-z0-9_-]+: (.*)$", 1).alias("value"))
    return rows.where("key <> ''")


def sections_of_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, section) for every line: the last heading at or above it, else the first one of the document, else null."""
    rows = lines.select("doc_id", "line_no", F.when(~F.col("fenced"), L.heading_text(F.col("line"))).alias("text"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    above = F.last("text", ignorenulls=True).over(w)
    below = F.first("text", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("doc_id", "line_no", F.coalesce(above, below).alias("section"))


def active_section(spark, sf_dir):
    """For each line the last heading at or above it, else the first one of the document."""
    return sections_of_lines(_lines(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (outline, toc_by_doc, first_h1_title, code_langs, fence_dispatch, alerts, containers, abbr_defs, abbr_uses, wikilinks, sup_sub, mark_ins, front_matter, active_section)
}

_HEADS = (
    LINES_SQL
    + r""",
heads AS (
  SELECT doc_id, line_no, CAST(length(regexp_extract(line, '^(#{1,6})', 1)) AS BIGINT) AS level,
    trim(regexp_replace(regexp_replace(line, '^#{1,6}[ \t]+', ''), '[ \t]+#+[ \t]*$', '')) AS text
  FROM lines WHERE NOT fenced AND regexp_matches(line, '^#{1,6}[ \t]+\S'))"""
)
_SLUGS = (
    _HEADS
    + r""",
bases AS (
  SELECT *, coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 _-]', '', 'g'), '[ _]', '-', 'g'), ''), 'heading') AS base FROM heads),
slugs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY line_no) - 1 AS n FROM bases)"""
)
_FENCED = LINES_SQL + ",\nnumbered AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS no FROM lines)"
_LANG = "lower(trim(regexp_replace(line, '^ {0,3}[`~]+', '')))"



def _marked_sql(patterns: dict[str, str]) -> str:
    found = ", ".join(f"array_to_string(regexp_extract_all(line, '{p}', 1), ',') AS {name}" for name, p in patterns.items())
    return f"WITH {LINES_SQL} SELECT * FROM (SELECT doc_id, line_no, {found} FROM lines WHERE NOT fenced) WHERE " + " OR ".join(f"{name} <> ''" for name in patterns)


ORACLE_SQL = {
    "outline": f"WITH {_HEADS} SELECT doc_id, line_no, level, text FROM heads",
    "toc_by_doc": f"""WITH {_SLUGS}
SELECT doc_id, string_agg(level || '|' || text || '|' || base || CASE WHEN n = 0 THEN '' ELSE '-' || n END, ';' ORDER BY line_no) AS toc FROM slugs GROUP BY doc_id""",
    "first_h1_title": f"WITH {_HEADS} SELECT doc_id, arg_min(text, line_no) AS title FROM heads WHERE level = 1 AND text <> '' GROUP BY doc_id",
    "code_langs": f"WITH {_FENCED} SELECT {_LANG} AS lang, count(*) AS blocks FROM numbered WHERE fence AND no % 2 = 1 GROUP BY 1",
    "fence_dispatch": f"""WITH {_FENCED}
SELECT doc_id, line_no, CASE WHEN {_LANG} = 'mermaid' THEN 'diagram' WHEN {_LANG} IN ('markdown', 'md', 'mdc', 'mdx', 'mkd') THEN 'embed' ELSE 'code' END AS role
FROM numbered WHERE fence AND no % 2 = 1""",
    "alerts": rf"""WITH {LINES_SQL}
SELECT doc_id, line_no, lower(regexp_extract(line, '^ {{0,3}}> ?\[!((?i:note|tip|important|warning|caution))\][ \t]*$', 1)) AS alert
FROM lines WHERE NOT fenced AND regexp_matches(line, '^ {{0,3}}> ?\[!((?i:note|tip|important|warning|caution))\][ \t]*$')""",
    "containers": rf"""WITH {LINES_SQL},
infos AS (SELECT doc_id, line_no, trim(regexp_replace(line, '^ *:{{3,}}', '')) AS info FROM lines WHERE NOT fenced AND regexp_matches(line, '^ *:{{3,}}[ \t]*\S')),
parts AS (
  SELECT *, starts_with(info, '{{') AS raw, lower(split_part(info, ' ', 1)) AS name,
    CASE WHEN contains(info, ' ') THEN trim(substr(info, strpos(info, ' ') + 1)) ELSE '' END AS rest,
    string_split(trim(info, '{{}}'), ' ') AS tokens FROM infos)
SELECT doc_id, line_no, CASE WHEN NOT raw THEN name END AS callout,
  CASE WHEN NOT raw THEN CASE WHEN rest = '' THEN upper(substr(name, 1, 1)) || substr(name, 2) ELSE rest END END AS title,
  CASE WHEN raw THEN array_to_string(list_transform(list_filter(tokens, lambda t: NOT starts_with(t, '#')), lambda t: ltrim(t, '.')), ' ') END AS classes,
  CASE WHEN raw THEN coalesce(substr(list_last(list_filter(tokens, lambda t: starts_with(t, '#'))), 2), '') END AS html_id
FROM parts""",
    "abbr_defs": rf"""WITH {LINES_SQL}
SELECT doc_id, trim(regexp_extract(line, '^\*\[([^\]]+)\]:[ \t]*(.+?)[ \t]*$', 1)) AS key,
  arg_max(regexp_extract(line, '^\*\[([^\]]+)\]:[ \t]*(.+?)[ \t]*$', 2), line_no) AS title
FROM lines WHERE NOT fenced AND regexp_matches(line, '^\*\[([^\]]+)\]:[ \t]*(.+?)[ \t]*$') GROUP BY 1, 2""",
    "abbr_uses": rf"""WITH {LINES_SQL},
keys AS (SELECT DISTINCT doc_id, trim(regexp_extract(line, '^\*\[([^\]]+)\]:[ \t]*(.+?)[ \t]*$', 1)) AS key FROM lines WHERE NOT fenced AND regexp_matches(line, '^\*\[([^\]]+)\]:[ \t]*(.+?)[ \t]*$')),
rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS rest FROM lines WHERE NOT starts_with(line, '*[') GROUP BY 1)
SELECT doc_id, key, CAST(len(regexp_extract_all(rest, '\b' || regexp_escape(key) || '\b')) AS BIGINT) AS uses FROM keys JOIN rest USING (doc_id)""",
    "wikilinks": rf"""WITH {MD_SQL},
inners AS (SELECT doc_id, list_filter(regexp_extract_all(md, '\[\[([^\n]*?)\]\]', 1), lambda x: trim(x) <> '') AS l FROM md),
each AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS inner_ FROM inners),
parts AS (
  SELECT doc_id, n, trim(split_part(inner_, '|', 1)) AS target, CASE WHEN contains(inner_, '|') THEN trim(substr(inner_, strpos(inner_, '|') + 1)) ELSE '' END AS shown FROM each),
pages AS (SELECT *, split_part(target, '#', 1) AS page, CASE WHEN contains(target, '#') THEN substr(target, strpos(target, '#')) ELSE '' END AS section FROM parts)
SELECT doc_id, n, CASE WHEN page <> '' AND NOT regexp_matches(page, '\.[^./\\]*$') THEN page || '.md' ELSE page END || section AS href,
  CASE WHEN shown = '' THEN target ELSE shown END AS shown FROM pages""",
    "sup_sub": _marked_sql(SCRIPTS),
    "mark_ins": _marked_sql(MARKS),
    "front_matter": rf"""WITH {MD_SQL},
front AS (SELECT doc_id, unnest(string_split(regexp_extract(md, '{FRONT}', 1), chr(10))) AS line FROM md)
SELECT doc_id, regexp_extract(line, '^([A-Za-z0-9_-]+): ', 1) AS key, regexp_extract(line, '^[A-Za-z0-9_-]+: (.*)$', 1) AS value FROM front WHERE regexp_matches(line, '^[A-Za-z0-9_-]+: ')""",
    "active_section": f"""WITH {_HEADS},
told AS (SELECT l.doc_id, l.line_no, h.text FROM lines l LEFT JOIN heads h ON h.doc_id = l.doc_id AND h.line_no = l.line_no)
SELECT doc_id, line_no, coalesce(last_value(text IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(text IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS section FROM told""",
}

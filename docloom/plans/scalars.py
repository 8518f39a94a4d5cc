"""Queries of the scalar functions: words, paths, links, assets, escapes, search, preferences, change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import expr as X
from docloom.markdown.paths import MARKDOWN_EXTENSIONS
from docloom.session import table
from docloom.streaming.changes import latest, without_repeats

#: Link destinations made from pages, by SQL that both engines read alike.
HREF = "CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN concat('#s', page_id) WHEN 2 THEN concat('notes/p', page_id, '.MD?x=1#part') WHEN 3 THEN concat('../img/a', page_id, '.png#f') WHEN 4 THEN '' WHEN 5 THEN concat('MAILTO:a', page_id, '@example.com') WHEN 6 THEN concat('/abs/q', page_id, '.markdown') ELSE '?q=1#top' END"
SOURCE = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('img/a b~', page_id, '*é.png') WHEN 2 THEN 'data:image/png;base64,xx' WHEN 3 THEN concat('../x/', page_id, '&y.svg') ELSE '' END"
NAME = "concat('dir.v', page_id % 3, '/sub/', CASE page_id % 6 WHEN 0 THEN 'a.md' WHEN 1 THEN 'B.MarkDown' WHEN 2 THEN 'c.litcoffee' WHEN 3 THEN 'd' WHEN 4 THEN 'e.tar.RMD' ELSE 'f.txt' END)"
PREFERENCES = """concat('{"rscale":', CAST(o_orderkey % 4 - 1 AS STRING), ',"tocWidth":', CAST((o_orderkey * 37) % 1500 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN ',"tocOpen":false' ELSE '' END, ',"window":{"x":1,"y":2,"w":', CAST(o_orderkey % 400 AS STRING), ',"h":200,"max":true}}')"""


def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


def conversation_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(X.word_count(F.col("text"))).alias("words"), F.count("*").alias("turns"))


def link_classify(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(HREF).alias("href"))
    return rows.select("page_id", "href", X.classify_link(F.lit("docs/guide"), F.col("href")).alias("l")).select("page_id", "href", F.col("l.kind").alias("link_kind"), "l.path", "l.fragment")


def asset_resolve(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(SOURCE).alias("source"))
    return rows.select("page_id", X.resolve_asset(F.lit("docs/guide"), F.col("source")).alias("resolved"))


def path_parts(spark, sf_dir):
    p = F.col("path")
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(NAME).alias("path"))
    return rows.select("page_id", X.folder(p).alias("folder"), X.base_name(p).alias("name"), X.stem(p).alias("stem"), X.extension(p).alias("ext"))


def is_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(NAME).alias("path"))
    return rows.select("page_id", X.is_markdown(F.col("path")).alias("markdown"), X.is_droppable(F.col("path"), F.expr("CASE WHEN page_id % 2 = 0 THEN 'text/plain' END")).alias("droppable"))


def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.html_escape(F.col("text"))).alias("escaped_md5"))


def asset_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.query_escape(F.expr("concat('a b~*', url, 'é/ü')")).alias("escaped"))


def find_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.find_count(F.col("text"), " The ").alias("hits"))
    return rows.where("hits > 0")


def find_step(spark, sf_dir):
    """The next and the previous hit from the last one, around the ends."""
    rows = find_counts(spark, sf_dir)
    return rows.select("doc_id", X.wrapped_step(F.col("hits") - 1, 1, F.col("hits")).alias("next_hit"), X.wrapped_step(F.lit(0).cast("long"), -1, F.col("hits")).alias("previous_hit"))


def reading_progress(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.progress((F.col("doc_id") * 100).cast("double"), F.col("n_chars").cast("double")).alias("progress"), X.clamp(F.col("n_chars"), 150, 640).cast("long").alias("width"))


def preferences(spark, sf_dir):
    p = X.preferences(F.expr(PREFERENCES))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"))
    return rows.select("o_orderkey", "p.scale", "p.toc_open", F.col("p.toc_width").cast("long").alias("toc_width"), F.col("p.window.w").cast("long").alias("window_w"))


def events_as_opens(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("path"))


def changes_latest(spark, sf_dir):
    return latest(events_as_opens(spark, sf_dir), ["user_id"])


def opens_deduplicated(spark, sf_dir):
    return without_repeats(events_as_opens(spark, sf_dir), "user_id")


QUERIES = {
    f.__name__: f
    for f in (word_count, conversation_words, link_classify, asset_resolve, path_parts, is_markdown, html_escape, asset_escape, find_counts, find_step, reading_progress, preferences, changes_latest, opens_deduplicated)
}

_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_WORDS = f"CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')) AS BIGINT)"
_KNOWN = ", ".join(f"'{e}'" for e in MARKDOWN_EXTENSIONS)
_EXT = r"lower(regexp_extract({}, '\.([^./\\]*)$', 1))"
# one leading .. is all that the made destinations have
_CLEAN = r"regexp_replace('docs/guide/' || {}, '[^/]+/\.\./', '')"
_ENCODE = "replace(replace(replace(url_encode({}), '%20', '+'), '*', '%2A'), '%7E', '~')"
_ESCAPED = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '"', '&#34;')"""
_HITS = "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS hits FROM documents"
_PREFERENCES = PREFERENCES.replace("AS STRING", "AS VARCHAR")

ORACLE_SQL = {
    "word_count": f"SELECT doc_id, {_WORDS} AS words FROM documents",
    "conversation_words": f"SELECT role, CAST(sum({_WORDS}) AS BIGINT) AS words, count(*) AS turns FROM conversations GROUP BY role",
    "link_classify": rf"""WITH h AS (SELECT page_id, {HREF} AS href FROM pages),
p AS (SELECT *, split_part(split_part(href, '#', 1), '?', 1) AS raw, CASE WHEN contains(href, '#') THEN substr(href, strpos(href, '#') + 1) ELSE '' END AS frag FROM h),
f AS (SELECT *, CASE WHEN starts_with(raw, '/') THEN raw ELSE {_CLEAN.format("raw")} END AS full_path FROM p),
k AS (SELECT *, CASE WHEN href = '' THEN 'normal' WHEN starts_with(href, '#') THEN 'anchor' WHEN regexp_matches(lower(href), '^(http://|https://|mailto:|tel:|ftp://)') THEN 'external'
  WHEN raw = '' THEN 'anchor' WHEN {_EXT.format("full_path")} IN ({_KNOWN}) THEN 'doc' ELSE 'open' END AS link_kind FROM f)
SELECT page_id, href, link_kind, CASE WHEN link_kind IN ('doc', 'open') THEN full_path ELSE '' END AS path, CASE WHEN link_kind = 'doc' THEN frag ELSE '' END AS fragment FROM k""",
    "asset_resolve": f"""WITH s AS (SELECT page_id, {SOURCE} AS source FROM pages)
SELECT page_id, CASE WHEN source = '' OR regexp_matches(lower(source), '^(http://|https://|data:)') THEN source ELSE '/asset?path=' || {_ENCODE.format(_CLEAN.format("source"))} END AS resolved FROM s""",
    "path_parts": rf"""WITH n AS (SELECT page_id, {NAME} AS path FROM pages)
SELECT page_id, regexp_extract(path, '^(.*)[/\\][^/\\]*$', 1) AS folder, regexp_extract(path, '([^/\\]*)$', 1) AS name,
  regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem, {_EXT.format("path")} AS ext FROM n""",
    "is_markdown": rf"""WITH n AS (SELECT page_id, {NAME} AS path FROM pages)
SELECT page_id, {_EXT.format("path")} IN ({_KNOWN}) AS markdown, {_EXT.format("path")} IN ({_KNOWN}) OR page_id % 2 = 0 AS droppable FROM n""",
    "html_escape": f"SELECT doc_id, md5({_ESCAPED}) AS escaped_md5 FROM documents",
    "asset_escape": f"SELECT page_id, {_ENCODE.format("concat('a b~*', url, 'é/ü')")} AS escaped FROM pages",
    "find_counts": f"SELECT * FROM ({_HITS}) WHERE hits > 0",
    "find_step": f"SELECT doc_id, CAST(0 AS BIGINT) AS next_hit, hits - 1 AS previous_hit FROM ({_HITS}) WHERE hits > 0",
    "reading_progress": "SELECT doc_id, CASE WHEN n_chars > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (doc_id * 100)::DOUBLE / n_chars::DOUBLE)) ELSE 0.0::DOUBLE END AS progress, CAST(greatest(150, least(640, n_chars)) AS BIGINT) AS width FROM documents",
    "preferences": f"""WITH j AS (SELECT o_orderkey, CAST({_PREFERENCES} AS JSON) AS j FROM orders)
SELECT o_orderkey, CASE WHEN CAST(j->>'$.rscale' AS DOUBLE) > 0 THEN CAST(j->>'$.rscale' AS DOUBLE) ELSE 1.0::DOUBLE END AS scale,
  coalesce(CAST(j->>'$.tocOpen' AS BOOLEAN), true) AS toc_open,
  CAST(CASE WHEN CAST(j->>'$.tocWidth' AS INT) > 0 THEN greatest(120, least(1200, CAST(j->>'$.tocWidth' AS INT))) ELSE 268 END AS BIGINT) AS toc_width,
  CASE WHEN CAST(j->>'$.window.w' AS INT) >= 200 THEN CAST(j->>'$.window.w' AS BIGINT) END AS window_w FROM j""",
    "changes_latest": "SELECT user_id, arg_max(event_type, event_id) AS path, max(event_id) AS seq FROM events GROUP BY user_id",
    "opens_deduplicated": """SELECT user_id, seq, path FROM (SELECT user_id, event_id AS seq, event_type AS path, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
WHERE path IS DISTINCT FROM b""",
}

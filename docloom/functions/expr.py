"""Scalar functions of documents as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.markdown.paths import EXTERNAL, MARKDOWN_EXTENSIONS

#: White space of Unicode that separates words, as a class that Java and RE2 read alike.
WORD_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
EXTENSION = r"\.([^./\\]*)$"


def word_count(text: Column) -> Column:
    """Words of a raw source, markup and front matter included; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPACE), "")).cast("long")


def is_markdown(name: Column) -> Column:
    """Whether a file name or path has an extension of Markdown."""
    return F.coalesce(F.lower(F.regexp_extract(name, EXTENSION, 1)).isin(*MARKDOWN_EXTENSIONS), F.lit(False))


def is_droppable(name: Column, mime: Column) -> Column:
    """Whether a dropped file counts as Markdown, by extension or by media type."""
    return is_markdown(name) | F.coalesce(mime.rlike(r"(?i)^text/(?:markdown|plain)"), F.lit(False))


def folder(path: Column) -> Column:
    out = F.regexp_extract(path, r"(?s)^(.*)[/\\][^/\\]*$", 1)
    return F.when(~path.rlike(r"[/\\]"), ".").when(out == "", "/").otherwise(out)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, EXTENSION, 1))


def clean_path(path: Column) -> Column:
    """A POSIX path without . and .. parts and doubled slashes; .. above the root is dropped, above a relative start kept."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")

    def step(done: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(F.concat(F.array(F.lit("")), done), -1), F.lit("")) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).when((p == "..") & rooted, done).otherwise(F.concat(done, F.array(p)))

    joined = F.array_join(F.aggregate(parts, none, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def resolved(folder_: Column, path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(clean_path(F.concat(folder_, F.lit("/"), path)))


def _starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p)
    return out


def classify_link(folder_: Column, href: Column) -> Column:
    """Struct of kind (normal, anchor, external, doc or open), path and fragment of a link in a document of a folder."""
    before = F.substring_index(href, "#", 1)
    fragment = F.when(href.contains("#"), F.substring(href, F.instr(href, "#") + 1, F.length(href))).otherwise("")
    path = F.substring_index(before, "?", 1)
    full = resolved(folder_, path)
    empty = F.coalesce(href, F.lit("")) == ""
    kind = (
        F.when(empty, "normal")
        .when(href.startswith("#"), "anchor")
        .when(_starts(href, EXTERNAL), "external")
        .when(path == "", "anchor")
        .when(is_markdown(full), "doc")
        .otherwise("open")
    )
    local = kind.isin("doc", "open")
    return F.struct(kind.alias("kind"), F.when(local, full).otherwise("").alias("path"), F.when(kind == "doc", fragment).otherwise("").alias("fragment"))


def query_escape(text: Column) -> Column:
    """Escaped for a query: space as +, all but letters, digits and -_.~ as bytes in hex."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def resolve_asset(folder_: Column, source: Column) -> Column:
    """Source of an image: as it is where it is empty or a URL, else a query for its file."""
    keep = (F.coalesce(source, F.lit("")) == "") | _starts(source, ("http://", "https://", "data:"))
    return F.when(keep, source).otherwise(F.concat(F.lit("/asset?path="), query_escape(resolved(folder_, source))))


def html_escape(text: Column) -> Column:
    out = text
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def capitalize(word: Column) -> Column:
    """The first code point in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def container_info(info: Column) -> Column:
    """Struct of callout (or null), title, classes and id from what follows a container's colons."""
    raw = info.startswith("{")
    tokens = F.array_remove(F.split(F.trim(F.regexp_replace(info, r"^[{}]+|[{}]+$", "")), r"\s+"), "")
    classes = F.transform(F.filter(tokens, lambda t: ~t.startswith("#")), lambda t: F.regexp_replace(t, r"^\.", ""))
    ids = F.transform(F.filter(tokens, lambda t: t.startswith("#")), lambda t: F.substring(t, 2, 1 << 30))
    name = F.lower(F.trim(F.substring_index(info, " ", 1)))
    rest = F.trim(F.when(F.instr(info, " ") > 0, F.substring(info, F.instr(info, " ") + 1, F.length(info))).otherwise(""))
    return F.struct(
        F.when(~raw, name).alias("callout"),
        F.when(~raw, F.when(rest == "", capitalize(name)).otherwise(rest)).alias("title"),
        F.when(raw, F.array_join(classes, " ")).alias("classes"),
        F.when(raw, F.coalesce(F.element_at(F.concat(F.array(F.lit("")), ids), -1), F.lit(""))).alias("id"),
    )


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def find_count(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a trimmed term, without regard to case."""
    term = term.strip().lower()
    if not term:
        return F.lit(0).cast("long")
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("long")


def wrapped_step(at: Column, by: int, n: Column) -> Column:
    """The next of n places, around the ends; null where there are none."""
    return F.when(n > 0, F.pmod(at + by, n))


def progress(offset: Column, extent: Column) -> Column:
    return F.when(extent > 0, clamp(offset / extent, 0.0, 1.0)).otherwise(F.lit(0.0))


def wikilink_inner(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(r"\[\[([^\n]*?)\]\]"), F.lit(1)), lambda x: F.trim(x) != "")


def wikilink(inner: Column) -> Column:
    """Struct of href and shown text of the inside of a wikilink."""
    target = F.trim(F.substring_index(inner, "|", 1))
    shown = F.trim(F.when(F.instr(inner, "|") > 0, F.substring(inner, F.instr(inner, "|") + 1, F.length(inner))).otherwise(""))
    page = F.substring_index(target, "#", 1)
    section = F.when(F.instr(target, "#") > 0, F.substring(target, F.instr(target, "#"), F.length(target))).otherwise("")
    page = F.when((page != "") & ~page.rlike(r"\.[^./\\]*$"), F.concat(page, F.lit(".md"))).otherwise(page)
    return F.struct(F.concat(page, section).alias("href"), F.when(shown == "", target).otherwise(shown).alias("shown"))


def preferences(raw: Column) -> Column:
    """Reading preferences from JSON with their defaults: a scale above 0, a bounded outline, a window that is large enough or null."""
    p = F.from_json(raw, "rscale double, tocOpen boolean, tocWidth int, window struct<x:int,y:int,w:int,h:int,max:boolean>")
    window = F.when((p["window"]["w"] >= 200) & (p["window"]["h"] >= 150), p["window"])
    width = F.coalesce(p["tocWidth"], F.lit(0))
    return F.struct(
        F.when(p["rscale"] > 0, p["rscale"]).otherwise(1.0).alias("scale"),
        F.coalesce(p["tocOpen"], F.lit(True)).alias("toc_open"),
        F.when(width > 0, clamp(width, 120, 1200)).otherwise(268).alias("toc_width"),
        window.alias("window"),
    )

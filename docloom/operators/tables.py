"""Derived tables of documents: one parse per document, then projections of its nodes.

parse_nodes runs the parser once for each document in Arrow batches; every table after it is plain
DataFrame code over the nodes. Rendering is separate, so a query of outlines never renders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.markdown import parse, render
from docloom.markdown.nodes import Node

NODES = "doc_id long, pos int, parent int, kind string, level int, text string, attrs map<string,string>, line_start int, line_end int"
RENDERED = "doc_id long, path string, ok boolean, html string, title string, toc array<struct<level:int,text:string,id:string>>, words long, error string"
#: Kinds whose own text is the text below them.
GATHERED = frozenset(("heading", "paragraph", "link", "image", "term", "cell", "em", "strong", "mark", "ins", "del", "definition", "footnote", "item"))
#: A bare mail address. A run of its characters is entered at its start or behind the match before, and nothing is given back, so time follows length.
ADDRESS = r"(?:(?<![A-Za-z0-9._+-])|\G)[._+-]*+([A-Za-z0-9][A-Za-z0-9._+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)"
_TOC = pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("id", pa.string())]))
_ATTRS = pa.map_(pa.string(), pa.string())


def flattened(root: Node) -> Iterator[tuple[int, int, Node]]:
    """(pos, parent's pos, node) in document order; the root has parent -1."""
    pending, pos = [(root, -1)], 0
    while pending:
        node, parent = pending.pop()
        yield pos, parent, node
        pending.extend((child, pos) for child in reversed(node.children))
        pos += 1


def _nodes(windows: bool, kinds: frozenset[str] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in NODES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), _ATTRS, pa.int32(), pa.int32()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, path, md in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc = parse(md or "", path or "", windows=windows)
                root = Node("document", [*doc.root.children, *doc.notes], doc.title, {"words": str(doc.words)} | {f"front.{k}": str(v) for k, v in doc.front.items()}, 0, 0, doc.root.last)
                for pos, parent, n in flattened(root):
                    if kinds is not None and n.kind not in kinds:
                        continue
                    text = n.plain() if n.kind in GATHERED else n.text
                    rows.append((doc_id, pos, parent, n.kind, n.level, text, list(n.attrs.items()), n.first, n.last))
                if len(rows) > 20_000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)

    return run


#: Inputs up to this size are dealt to all cores before they are parsed.
DEALT_BYTES = 256 * 1024 * 1024


def _source(docs: DataFrame) -> DataFrame:
    """(doc_id, path, md); a small input, which may lie in one file, is dealt out, as parsing costs far more than its shuffle. A larger one stays where it is read."""
    path = F.col("path").cast("string") if "path" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.col("md").cast("string").alias("md"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(docs.sparkSession.sparkContext.defaultParallelism) if size <= DEALT_BYTES else rows


def parse_nodes(docs: DataFrame, windows: bool = False, kinds: frozenset[str] | None = None) -> DataFrame:
    """docs(doc_id, md[, path]) to nodes; pos 0 is the document itself, with its title as text. Whole texts are parsed; of kinds, if given, nodes are handed on."""
    return _source(docs).mapInArrow(_nodes(windows, kinds), NODES)


def _render(windows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, path, md in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if md is None:
                    rows.append((doc_id, path, False, None, None, [], None, "no text"))
                    continue
                html, doc = render(md, path or "", windows)
                rows.append((doc_id, path, True, html, doc.title, [dict(zip(("level", "text", "id"), t, strict=True)) for t in doc.toc], doc.words, None))
            kinds = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), _TOC, pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ("doc_id", "path", "ok", "html", "title", "toc", "words", "error")])

    return run


def render_documents(docs: DataFrame, windows: bool = False) -> DataFrame:
    """docs(doc_id, md[, path]) to HTML, title, outline and words; a null text gives an error row."""
    return _source(docs).mapInArrow(_render(windows), RENDERED)


# tables over nodes


def headings(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, level, text, id) of all headings, at any depth."""
    return nodes.where("kind = 'heading'").select("doc_id", "pos", "level", "text", F.coalesce(F.col("attrs")["id"], F.lit("")).alias("id"))


def toc(nodes: DataFrame) -> DataFrame:
    """(doc_id, toc): the headings of a document in order; a document without any has an empty list."""
    entry = F.when(F.col("kind") == "heading", F.struct("pos", "level", "text", F.coalesce(F.col("attrs")["id"], F.lit("")).alias("id")))
    rows = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.select("doc_id", F.transform("entries", lambda e: F.struct(e["level"].alias("level"), e["text"].alias("text"), e["id"].alias("id"))).alias("toc"))


def titles(nodes: DataFrame) -> DataFrame:
    """(doc_id, title, words)."""
    return nodes.where("pos = 0").select("doc_id", F.col("text").alias("title"), F.col("attrs")["words"].cast("long").alias("words"))


def front_matter(nodes: DataFrame) -> DataFrame:
    """(doc_id, key, value) of the scalar and list entries of the front matter."""
    rows = nodes.where("pos = 0").select("doc_id", F.explode("attrs").alias("key", "value")).where(F.col("key").startswith("front."))
    return rows.select("doc_id", F.substring("key", len("front.") + 1, 1 << 30).alias("key"), "value")


def links(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, href, shown, link_kind, path, fragment, title) of links and wikilinks."""
    a = lambda k: F.coalesce(F.col("attrs")[k], F.lit(""))
    return nodes.where("kind = 'link'").select("doc_id", "pos", a("href").alias("href"), F.col("text").alias("shown"), a("kind").alias("link_kind"), a("path").alias("path"), a("fragment").alias("fragment"), F.col("attrs")["title"].alias("title"))


def autolinks(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, href, shown) of links in angle brackets, bare URLs and bare mail addresses; there are none in formulas, code and HTML."""
    return nodes.where("kind = 'autolink'").select("doc_id", "pos", F.col("attrs")["href"].alias("href"), F.col("text").alias("shown"))


def addresses(docs: DataFrame) -> DataFrame:
    """(doc_id, href, shown) of every mail address in docs(doc_id, md), wherever it stands: in formulas, code and HTML too, where nothing is linked."""
    shown = docs.select("doc_id", F.explode(F.regexp_extract_all("md", F.lit(ADDRESS), F.lit(1))).alias("shown"))
    return shown.select("doc_id", F.concat(F.lit("mailto:"), "shown").alias("href"), "shown")


def with_unlinked(linked: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, href, shown): the rows of linked, and those of found that it lacks; an equal row as often as the side that has it more often."""
    keys = ["doc_id", "href", "shown"]
    sides = [rows.select(*keys, F.lit(k).alias("of_linked"), F.lit(1 - k).alias("of_found")) for k, rows in ((1, linked), (0, found))]
    times = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.greatest(F.sum("of_linked"), F.sum("of_found")).cast("int").alias("times"))
    return times.select(*keys, F.explode(F.array_repeat(F.lit(True), F.col("times"))).alias("row")).drop("row")


def images(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, source, resolved, alt)."""
    return nodes.where("kind = 'image'").select("doc_id", "pos", F.col("attrs")["source"].alias("source"), F.col("attrs")["href"].alias("resolved"), F.col("text").alias("alt"))


def code_blocks(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, lang, role, code): role is what the renderer makes of the block."""
    lang = F.lower(F.coalesce(F.col("attrs")["lang"], F.lit("")))
    role = F.when(F.col("kind") == "code", "indented").when(lang == "mermaid", "diagram").when(lang.isin("markdown", "md", "mdc", "mdx", "mkd"), "embed").otherwise("code")
    return nodes.where("kind IN ('fence', 'code')").select("doc_id", "pos", lang.alias("lang"), role.alias("role"), F.col("text").alias("code"))


def formulas(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, tex, display, is_block)."""
    display = (F.col("kind") == "math_block") | (F.coalesce(F.col("attrs")["display"], F.lit("")) == "1")
    return nodes.where("kind IN ('math', 'math_block')").select("doc_id", "pos", F.col("text").alias("tex"), display.alias("display"), (F.col("kind") == "math_block").alias("is_block"))


def abbreviation_definitions(nodes: DataFrame) -> DataFrame:
    """(doc_id, key, title): of several definitions of a key the last holds."""
    d = nodes.where("kind = 'abbr_def'").select("doc_id", "pos", F.col("attrs")["key"].alias("key"), F.col("attrs")["title"].alias("title"))
    return d.groupBy("doc_id", "key").agg(F.max_by("title", "pos").alias("title"))


def abbreviation_uses(nodes: DataFrame) -> DataFrame:
    """(doc_id, key, uses)."""
    return nodes.where("kind = 'abbr'").groupBy("doc_id", F.col("text").alias("key")).agg(F.count("*").alias("uses"))


def containers(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, callout, title, classes, id)."""
    a = F.col("attrs")
    return nodes.where("kind = 'container'").select("doc_id", "pos", a["callout"].alias("callout"), a["title"].alias("title"), a["classes"].alias("classes"), a["id"].alias("id"))


def alerts(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, alert)."""
    return nodes.where("kind = 'quote'").where(F.col("attrs")["alert"].isNotNull()).select("doc_id", "pos", F.col("attrs")["alert"].alias("alert"))


def footnotes(nodes: DataFrame) -> DataFrame:
    """(doc_id, label, number, refs): how often each footnote is referred to."""
    refs = nodes.where("kind = 'footnote_ref'").select("doc_id", F.col("text").alias("label"), F.col("attrs")["number"].cast("int").alias("number"))
    return refs.groupBy("doc_id", "label", "number").agg(F.count("*").alias("refs"))


def footnote_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, label, text) of the footnotes that are referred to."""
    return nodes.where("kind = 'footnote'").select("doc_id", F.col("attrs")["label"].alias("label"), "text")


def table_cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, row, column, align, text): row 0 is the head."""
    a = F.col("attrs")
    return nodes.where("kind = 'cell'").select("doc_id", "pos", a["row"].cast("int").alias("row"), a["column"].cast("int").alias("column"), a["align"].alias("align"), "text")


def definitions(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, term, definition): each definition with the last term before it in its list."""
    w = Window.partitionBy("doc_id", "parent").orderBy("pos")
    rows = nodes.where("kind IN ('term', 'definition')")
    rows = rows.withColumn("term", F.last(F.when(F.col("kind") == "term", F.col("text")), ignorenulls=True).over(w))
    return rows.where("kind = 'definition'").select("doc_id", "pos", "term", F.col("text").alias("definition"))


def emoji(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, name, sign)."""
    return nodes.where("kind = 'emoji'").select("doc_id", "pos", F.col("attrs")["name"].alias("name"), F.col("text").alias("sign"))


def tasks(nodes: DataFrame) -> DataFrame:
    """(doc_id, done, open) counts of task items."""
    t = nodes.where("kind = 'item'").where(F.col("attrs")["task"].isNotNull())
    return t.groupBy("doc_id").agg(F.sum((F.col("attrs")["task"] == "done").cast("long")).alias("done"), F.sum((F.col("attrs")["task"] == "open").cast("long")).alias("open"))


def scripts(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, text) of superscripts, subscripts, marks, insertions and strikes."""
    return nodes.where("kind IN ('sup', 'sub', 'mark', 'ins', 'del')").select("doc_id", "pos", "kind", "text")


def find_in_text(nodes: DataFrame, term: str) -> DataFrame:
    """(doc_id, hits): occurrences of a term within single text nodes, without regard to case; raw HTML, code blocks and formulas are not text."""
    from docloom.functions.expr import find_count

    text = nodes.where("kind IN ('text', 'code_span', 'abbr', 'emoji', 'sup', 'sub')").where(F.trim("text") != "")
    return text.groupBy("doc_id").agg(F.sum(find_count(F.col("text"), term)).alias("hits")).where("hits > 0")

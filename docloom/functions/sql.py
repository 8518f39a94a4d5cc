"""The engine from SQL text: a table function that parses and scalar functions that render."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.markdown import parse, render
from docloom.markdown.nodes import Node
from docloom.markdown.sanitize import sanitize
from docloom.operators import tables as T


@F.udtf(returnType="pos int, parent int, kind string, level int, text string, attrs map<string,string>")
class ParseMarkdown:
    """parse_markdown(md): the nodes of a source; a null one has the document alone."""

    def eval(self, md: str) -> Iterator[tuple]:
        doc = parse(md or "")
        root = Node("document", [*doc.root.children, *doc.notes], doc.title, {"words": str(doc.words)})
        for pos, parent, n in T.flattened(root):
            yield pos, parent, n.kind, n.level, n.plain() if n.kind in T.GATHERED else n.text, n.attrs


def register(spark: SparkSession) -> None:
    """Registers parse_markdown, render_markdown, markdown_title and sanitize_html for SQL."""
    spark.udtf.register("parse_markdown", ParseMarkdown)
    for name, fn in (("render_markdown", lambda md: None if md is None else render(md)[0]), ("markdown_title", lambda md: parse(md or "").title), ("sanitize_html", lambda html: None if html is None else sanitize(html))):
        spark.udf.register(name, F.udf(fn, "string", useArrow=True))


def views(docs: DataFrame) -> None:
    """Temporary views nodes, headings, links, images, code_blocks, formulas, alerts, containers and abbreviations over docs(doc_id, md[, path])."""
    nodes = T.parse_nodes(docs)
    nodes.createOrReplaceTempView("nodes")
    for name, fn in (("headings", T.headings), ("links", T.links), ("images", T.images), ("code_blocks", T.code_blocks), ("formulas", T.formulas), ("alerts", T.alerts), ("containers", T.containers), ("abbreviations", T.abbreviation_definitions)):
        fn(nodes).createOrReplaceTempView(name)

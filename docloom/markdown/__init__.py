"""Markdown: a block parser, an inline parser, and HTML, on one tree of nodes."""

from docloom.markdown.document import Document, parse, render

__all__ = ["Document", "parse", "render"]

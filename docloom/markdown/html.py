"""HTML of a document's tree, a function for each kind of node."""

from __future__ import annotations

from urllib.parse import quote

from docloom.markdown.document import EMBEDDED, Document, parse
from docloom.markdown.highlight import highlighted
from docloom.markdown.inline import escape
from docloom.markdown.nodes import Node

LABELS = {"note": "Note", "tip": "Tip", "important": "Important", "warning": "Warning", "caution": "Caution"}


class Writer:
    def __init__(self, embedded: bool = False):
        self.embedded = embedded
        self.out: list[str] = []
        self.uses: dict[str, int] = {}

    def all(self, nodes: list[Node], tight: bool = False) -> None:
        for i, node in enumerate(nodes):
            if tight and node.kind == "paragraph":
                self.all(node.children)
                if i + 1 < len(nodes):
                    self.out.append("\n")
            else:
                getattr(self, node.kind)(node)

    def wrap(self, tag: str, node: Node, attrs: str = "", end: str = "") -> None:
        self.out.append(f"<{tag}{attrs}>")
        self.all(node.children)
        self.out.append(f"</{tag}>{end}")

    # blocks

    def heading(self, n: Node) -> None:
        self.wrap(f"h{n.level}", n, "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items()), "\n")

    def paragraph(self, n: Node) -> None:
        self.wrap("p", n, "", "\n")

    def rule(self, n: Node) -> None:
        self.out.append("<hr>\n")

    def code(self, n: Node) -> None:
        self.out.append(f'<div class="codeblock"><pre class="chroma"><code>{escape(n.text)}</code></pre></div>\n')

    def fence(self, n: Node) -> None:
        lang = n.attrs["lang"]
        if lang.lower() == "mermaid":
            self.out.append(f'<pre class="mermaid">{escape(n.text)}</pre>\n')
        elif lang.lower() in EMBEDDED and not self.embedded:
            self.out.append(f'<div class="md-embed">\n{to_html(parse(n.text, embedded=True), embedded=True)}</div>\n')
        else:
            named = f' data-lang="{escape(lang)}"' if lang else ""
            self.out.append(f'<div class="codeblock"{named}><pre class="chroma"><code>{highlighted(n.text, lang)}</code></pre></div>\n')

    def math_block(self, n: Node) -> None:
        self.out.append(f'<div class="math math-display">{escape(n.text)}</div>\n')

    def container(self, n: Node) -> None:
        if "callout" in n.attrs:
            kind, title = n.attrs["callout"], n.attrs["title"]
            self.out.append(f'<div class="callout{" callout-" + escape(kind) if kind else ""}">' + (f'<p class="callout-title">{escape(title)}</p>' if title else ""))
        else:
            given = (("class", n.attrs["classes"]), ("id", n.attrs["id"]))
            self.out.append("<div" + "".join(f' {k}="{escape(v)}"' for k, v in given if v) + ">")
        self.out.append("\n")
        self.all(n.children)
        self.out.append("</div>\n")

    def quote(self, n: Node) -> None:
        kind = n.attrs.get("alert")
        if not kind:
            self.out.append("<blockquote>\n")
            self.all(n.children)
            self.out.append("</blockquote>\n")
            return
        icon = f'<svg class="alert-ico" aria-hidden="true"><use href="#alert-{kind}"/></svg>'
        self.out.append(f'<div class="alert alert-{kind}"><p class="alert-title">{icon}<span>{LABELS[kind]}</span></p>')
        self.all(n.children)
        self.out.append("</div>\n")

    def list(self, n: Node) -> None:
        tag = "ol" if n.attrs.get("ordered") else "ul"
        start = f' start="{n.attrs["start"]}"' if n.attrs.get("start", "1") != "1" else ""
        self.out.append(f"<{tag}{start}>\n")
        for item in n.children:
            self.out.append("<li>")
            if "task" in item.attrs:
                self.out.append('<input checked="" disabled="" type="checkbox"> ' if item.attrs["task"] == "done" else '<input disabled="" type="checkbox"> ')
            tight = bool(n.attrs["tight"])
            if not tight and item.children:
                self.out.append("\n")
            self.all(item.children, tight)
            self.out.append("</li>\n")
        self.out.append(f"</{tag}>\n")

    def html(self, n: Node) -> None:
        self.out.append(n.text + "\n")

    def table(self, n: Node) -> None:
        self.out.append("<table>\n")
        for i, row in enumerate(n.children):
            tag = "th" if i == 0 else "td"
            self.out.append("<thead>\n<tr>\n" if i == 0 else "<tbody>\n<tr>\n" if i == 1 else "<tr>\n")
            for cell in row.children:
                self.wrap(tag, cell, f' style="text-align:{cell.attrs["align"]}"' if cell.attrs["align"] else "", "\n")
            self.out.append("</tr>\n</thead>\n" if i == 0 else "</tr>\n")
        self.out.append("</tbody>\n</table>\n" if len(n.children) > 1 else "</table>\n")

    def definitions(self, n: Node) -> None:
        self.out.append("<dl>\n")
        for child in n.children:
            if child.kind == "term":
                self.wrap("dt", child, "", "\n")
            else:
                self.out.append("<dd>")
                self.all(child.children, tight=True)
                self.out.append("</dd>\n")
        self.out.append("</dl>\n")

    def abbr_def(self, n: Node) -> None:
        pass

    # inline

    def text(self, n: Node) -> None:
        self.out.append(escape(n.text).replace("&#39;", "'").replace("&#34;", "&quot;"))

    emoji = text

    def code_span(self, n: Node) -> None:
        self.out.append(f"<code>{escape(n.text)}</code>")

    def em(self, n: Node) -> None:
        self.wrap("em", n)

    def strong(self, n: Node) -> None:
        self.wrap("strong", n)

    def mark(self, n: Node) -> None:
        self.wrap("mark", n)

    def ins(self, n: Node) -> None:
        self.wrap("ins", n)

    def sup(self, n: Node) -> None:
        self.out.append(f"<{n.kind}>{escape(n.text)}</{n.kind}>")

    sub = sup

    def math(self, n: Node) -> None:
        self.out.append(f'<span class="math math-{"display" if n.attrs.get("display") else "inline"}">{escape(n.text)}</span>')

    def abbr(self, n: Node) -> None:
        self.out.append(f'<abbr title="{escape(n.attrs["title"])}">{escape(n.text)}</abbr>')

    def raw_html(self, n: Node) -> None:
        self.out.append(n.text)

    def hard_break(self, n: Node) -> None:
        self.out.append("<br>\n")

    def soft_break(self, n: Node) -> None:
        self.out.append("\n")

    def autolink(self, n: Node) -> None:
        self.out.append(f'<a href="{escape(quote(n.attrs["href"], safe=SAFE))}">{escape(n.text)}</a>')

    def link(self, n: Node) -> None:
        a = n.attrs
        to = {
            "external": f' href="{escape(a["href"])}" data-external="1" rel="noreferrer"',
            "doc": f' href="#" data-doc="{escape(a.get("path", ""))}"' + (f' data-frag="{escape(a["fragment"])}"' if a.get("fragment") else ""),
            "open": f' href="#" data-open="{escape(a.get("path", ""))}"',
        }.get(a["kind"], f' href="{escape(a["href"])}"')
        self.wrap("a", n, to + (f' title="{escape(a["title"])}"' if "title" in a else ""))

    def image(self, n: Node) -> None:
        title = f' title="{escape(n.attrs["title"])}"' if "title" in n.attrs else ""
        self.out.append(f'<img src="{escape(n.attrs["href"])}" alt="{escape(n.plain())}"{title}>')

    def footnote_ref(self, n: Node) -> None:
        number = n.attrs["number"]
        use = self.uses[number] = self.uses.get(number, 0) + 1
        back = f"fnref{use - 1 if use > 1 else ''}:{number}"
        self.out.append(f'<sup id="{back}"><a href="#fn:{number}" class="footnote-ref" role="doc-noteref">{number}</a></sup>')

    def notes(self, notes: list[Node]) -> None:
        self.out.append('<div class="footnotes" role="doc-endnotes">\n<hr>\n<ol>\n')
        for number, note in enumerate(notes, 1):
            self.out.append(f'<li id="fn:{number}">\n')
            self.all(note.children)
            self.out.append(f'<a href="#fnref:{number}" class="footnote-backref" role="doc-backlink">&#x21a9;&#xfe0e;</a>\n</li>\n')
        self.out.append("</ol>\n</div>\n")


SAFE = "/?:@!$&'()*+,;=#%[]~"
setattr(Writer, "del", lambda self, n: self.wrap("del", n))


def to_html(doc: Document, embedded: bool = False) -> str:
    writer = Writer(embedded)
    writer.all(doc.root.children)
    if doc.notes:
        writer.notes(doc.notes)
    return "".join(writer.out)

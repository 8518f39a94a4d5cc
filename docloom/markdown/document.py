"""A whole document: front matter, blocks, inline text, transforms, outline, title and HTML."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from docloom.markdown.block import Blocks, Context, spaced
from docloom.markdown.inline import Inline
from docloom.markdown.nodes import Node
from docloom.markdown.paths import classify_link, resolve_asset, split_path

#: Fenced languages that are rendered as Markdown, one level deep.
EMBEDDED = frozenset(("markdown", "md", "mdc", "mdx", "mkd"))
#: White space of Unicode that separates words.
FIELD_SPACE = re.compile(r"[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@dataclass
class Document:
    root: Node
    front: dict[str, object] = field(default_factory=dict)
    notes: list[Node] = field(default_factory=list)  # in order of reference
    abbreviations: dict[str, str] = field(default_factory=dict)
    toc: list[tuple[int, str, str]] = field(default_factory=list)
    title: str = ""
    words: int = 0


def front_matter(source: str) -> tuple[dict[str, object], str, int]:
    """The leading block between --- lines as a mapping, the rest, and the lines taken."""
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:^|\n)(?:---|\.\.\.)[ \t]*(?:\r?\n|\Z)", source, re.S)
    if not m:
        return {}, source, 0
    return yaml_mapping(m[1]), source[m.end() :], source[: m.end()].count("\n")


def yaml_mapping(text: str) -> dict[str, object]:
    """A YAML mapping; without a YAML library, its flat scalar and list entries."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml is not None:
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError:
            return {}
        return {str(k): v for k, v in found.items()} if isinstance(found, dict) else {}
    out: dict[str, object] = {}
    for line in text.splitlines():
        if m := re.match(r"([^\s:#][^:]*):[ \t]+(.*?)[ \t]*$", line):
            value = m[2]
            out[m[1].strip()] = [x.strip() for x in value[1:-1].split(",")] if value[:1] == "[" else value.strip("\"'")
    return out


def slug(text: str, taken: dict[str, int]) -> str:
    """Id of a heading: letters and digits of ASCII, dashes for spaces, numbered where it is taken."""
    base = "".join("-" if c in " -_" else c for c in text.lower() if c.isascii() and (c.isalnum() or c in " -_")) or "heading"
    name, n = base, taken.get(base, 0)
    while name in taken:
        n += 1
        name = f"{base}-{n}"
    taken[base] = n
    taken.setdefault(name, 0)
    return name


INLINE_BLOCKS = frozenset(("heading", "paragraph", "term", "cell"))


def parse(source: str, path: str = "", embedded: bool = False, windows: bool = False) -> Document:
    """The document of a Markdown source; path resolves its relative links, embedded leaves headings without ids of their own."""
    front, body, taken_lines = front_matter(source)
    context = Context()
    texts = re.split(r"\r\n|\n|\r", body)
    if not texts[-1]:
        texts.pop()  # a line break ends the last line
    lines = [(i + taken_lines, spaced(t)) for i, t in enumerate(texts)]
    doc = Document(Node("document", last=max(0, taken_lines + len(lines) - 1)), front, words=sum(map(bool, FIELD_SPACE.split(source))))
    doc.root.children = Blocks(lines, context).parse()
    doc.abbreviations = context.abbreviations

    def inline(root: Node) -> None:
        for node in list(root.walk()):
            if node.kind in INLINE_BLOCKS and node.text:
                node.children, node.text = Inline(node.text, context.links, context.notes).parse(), ""

    inline(doc.root)
    order: dict[str, int] = {}
    at = 0
    pending = [doc.root]
    while at < len(pending):
        for node in pending[at].walk():
            if node.kind == "footnote_ref":
                if node.text not in order:
                    order[node.text] = len(order) + 1
                    note = context.notes[node.text]
                    inline(note)
                    doc.notes.append(note)
                    pending.append(note)
                node.attrs["number"] = str(order[node.text])
        at += 1

    folder = split_path(path)[0] if not embedded else ""
    taken: dict[str, int] = {}
    h1 = ""
    for top in (doc.root, *doc.notes):
        for node in top.walk():
            if node.kind == "heading":
                text = node.plain()
                if not embedded and "id" not in node.attrs:
                    node.attrs["id"] = slug(text, taken)
                elif "id" in node.attrs:
                    taken.setdefault(node.attrs["id"], 0)
                doc.toc.append((node.level, text, node.attrs.get("id", "")))
                h1 = h1 or (text if node.level == 1 else "")
            elif node.kind == "link":
                kind, to, fragment = classify_link(folder, node.attrs["href"], windows)
                node.attrs |= {"kind": kind} | ({"path": to} if to else {}) | ({"fragment": fragment} if fragment else {})
            elif node.kind == "image":
                node.attrs["source"] = node.attrs["href"]
                node.attrs["href"] = resolve_asset(folder, node.attrs["href"], windows)
        abbreviate(top, doc.abbreviations)
    doc.title = resolve_title(front, h1, path)
    return doc


def resolve_title(front: dict[str, object], h1: str, path: str) -> str:
    for key in ("title", "Title"):
        value = front.get(key)
        if isinstance(value, str) and value.strip():
            return value.strip()
    return h1 or split_path(path)[2]


def abbreviate(root: Node, known: dict[str, str]) -> None:
    """Wraps each whole-word occurrence of a known abbreviation in the text below root, longest first."""
    if not known:
        return
    keys = sorted(known, key=lambda k: (-len(k), k))
    pattern = re.compile(r"(?<![0-9A-Za-z_])(?:" + "|".join(map(re.escape, keys)) + r")(?![0-9A-Za-z_])")
    for node in list(root.walk()):
        if node.kind == "code_span" or not node.children:
            continue
        out: list[Node] = []
        for child in node.children:
            if child.kind != "text" or not pattern.search(child.text):
                out.append(child)
                continue
            at = 0
            for m in pattern.finditer(child.text):
                if m.start() > at:
                    out.append(Node("text", text=child.text[at : m.start()]))
                out.append(Node("abbr", text=m[0], attrs={"title": known[m[0]]}))
                at = m.end()
            if at < len(child.text):
                out.append(Node("text", text=child.text[at:]))
        node.children = out


def render(source: str, path: str = "", windows: bool = False) -> tuple[str, Document]:
    """HTML of a source and its document."""
    from docloom.markdown.html import to_html

    doc = parse(source, path, windows=windows)
    return to_html(doc), doc

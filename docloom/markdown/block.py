"""Block syntax: lines to a tree, by recursive descent over the lines of each container.

Each kind of block has an opener in OPENERS, asked in order: it gets the lines and a place, and
returns the block and the place after it, or None. A container hands the lines inside it, without
their markers, to the same parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from docloom.markdown.inline import normal, unescape
from docloom.markdown.nodes import Node

#: Containers inside one another; what is nested deeper is text.
DEEPEST = 60
FENCE = re.compile(r"^( {0,3})(`{3,}(?=[^`]*$)|~{3,})\s*(.*?)\s*$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
QUOTE = re.compile(r"^ {0,3}> ?")
ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:( +)(.*)|())$")
COLONS = re.compile(r"^ *(:{3,})[ \t]*(.*?)[ \t]*$")
ABBREVIATION = re.compile(r"^\*\[([^\]]+)\]:[ \t]*(.+?)[ \t]*$")
NOTE = re.compile(r"^ {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
REFERENCE = re.compile(r"""^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>]*)>|(\S+))(?:[ \t]+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*$""")
DELIMITER_ROW = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
DEFINITION = re.compile(r"^ {0,3}:[ \t]+(.*)$")
ATTRIBUTES = re.compile(r"[ \t]*\{([^{}]*)\}[ \t]*$")
ALERT = re.compile(r"^\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]$", re.I)
# Fixed values of the CommonMark specification: elements that begin an HTML block.
HTML_ELEMENTS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
HTML_BLOCKS = (
    (re.compile(r"^ {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"^ {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r"^ {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r"^ {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"^ {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"^ {{0,3}}</?(?:{'|'.join(HTML_ELEMENTS)})(?:\s|/?>|$)", re.I), None),
    (re.compile(r"""^ {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"""), None),
)

Line = tuple[int, str]


@dataclass
class Context:
    """What the blocks of one document define for its inline text."""

    links: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    notes: dict[str, Node] = field(default_factory=dict)
    abbreviations: dict[str, str] = field(default_factory=dict)


def blank(line: str) -> bool:
    return not line.strip()


def indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def spaced(line: str) -> str:
    """Tabs of the indentation as spaces, to columns of four."""
    if "\t" not in line[: len(line) - len(line.lstrip(" \t"))] and not re.match(r"^ {0,3}(?:[-+*>]|\d+[.)])\t", line):
        return line
    out = ""
    for i, c in enumerate(line):
        if c == "\t":
            out += " " * (4 - len(out) % 4)
        elif c == " " or re.match(r"^ {0,3}(?:[-+*>]|\d+[.)])$", out + c):
            out += c
        else:
            return out + line[i:]
    return out


def outdent(line: str, n: int) -> str:
    return line[min(n, indent(line)) :]


def attributes(text: str) -> dict[str, str]:
    """{.a .b #id key=value} without its braces."""
    out: dict[str, str] = {}
    for token in text.split():
        if token[0] == "#":
            out["id"] = token[1:]
        elif token[0] == ".":
            out["class"] = (out.get("class", "") + " " + token[1:]).strip()
        elif "=" in token:
            key, _, value = token.partition("=")
            out[key] = value.strip("\"'")
    return out


def container_info(info: str) -> dict[str, str]:
    """Attributes of a container from what follows its colons: a named callout with a title, or classes and an id."""
    if info.startswith("{"):
        tokens = info.strip("{}").split()
        classes = [t[1:] if t[0] == "." else t for t in tokens if t[0] != "#"]
        ids = [t[1:] for t in tokens if t[0] == "#"]
        return {"classes": " ".join(classes), "id": ids[-1] if ids else ""}
    name, _, title = info.partition(" ")
    name = name.strip().lower()
    return {"callout": name, "title": title.strip() or name[:1].upper() + name[1:]}


class Blocks:
    """Parses the lines of one container."""

    def __init__(self, lines: list[Line], context: Context, depth: int = 0):
        self.lines, self.context, self.depth = lines, context, depth

    def inner(self, lines: list[Line]) -> list[Node]:
        if self.depth >= DEEPEST:
            return [Node("paragraph", text="\n".join(t for _, t in lines).strip(), first=lines[0][0], last=lines[-1][0])] if lines else []
        return Blocks(lines, self.context, self.depth + 1).parse()

    def parse(self) -> list[Node]:
        out: list[Node] = []
        at = 0
        while at < len(self.lines):
            if blank(self.lines[at][1]):
                at += 1
                continue
            for opener in OPENERS:
                found = opener(self, at)
                if found:
                    node, after = found
                    if node:
                        node.first, node.last = self.lines[at][0], self.lines[after - 1][0]
                        out.append(node)
                    at = after
                    break
            else:
                at = self.paragraph(at, out)
        return out

    def interrupts(self, at: int) -> bool:
        """Whether the line at a place ends a paragraph before it."""
        line = self.lines[at][1]
        if blank(line) or RULE.match(line) or ATX.match(line) or FENCE.match(line) or QUOTE.match(line):
            return True
        if (m := COLONS.match(line)) and m[2]:
            return True
        if self.opens_formula(line):
            return True
        if (m := ITEM.match(line)) and (m[4] or "").strip() and (not m[2][0].isdigit() or int(m[2][:-1]) == 1):
            return True
        return any(opening.match(line) for opening, _ in HTML_BLOCKS[:6])

    @staticmethod
    def opens_formula(line: str) -> bool:
        left = line.lstrip(" \t")
        return left.startswith("$$") and indent(line) < 4 and "$$" not in left[2:]

    def paragraph(self, at: int, out: list[Node]) -> int:
        start, texts = at, [self.lines[at][1].lstrip()]
        at += 1
        while at < len(self.lines):
            line = self.lines[at][1]
            if m := UNDERLINE.match(line):
                node = Node("heading", text="\n".join(texts).strip(), level=1 if m[1][0] == "=" else 2, first=self.lines[start][0], last=self.lines[at][0])
                out.append(self.with_attributes(node))
                return at + 1
            if DEFINITION.match(line):
                break
            if self.interrupts(at):
                break
            texts.append(line.lstrip())
            at += 1
        after = at
        while after < len(self.lines) and blank(self.lines[after][1]):
            after += 1
        if after < len(self.lines) and after - at <= 1 and DEFINITION.match(self.lines[after][1]):
            return self.definitions(start, after, texts, out)
        out.append(Node("paragraph", text="\n".join(texts).rstrip(), first=self.lines[start][0], last=self.lines[at - 1][0]))
        return at

    def definitions(self, start: int, at: int, terms: list[str], out: list[Node]) -> int:
        if out and out[-1].kind == "definitions":
            node = out[-1]
        else:
            node = Node("definitions", first=self.lines[start][0])
            out.append(node)
        node.children += [Node("term", text=t.strip(), first=self.lines[start][0], last=self.lines[start][0]) for t in terms]
        while at < len(self.lines) and (m := DEFINITION.match(self.lines[at][1])):
            inside = [(self.lines[at][0], m[1])]
            at += 1
            while at < len(self.lines):
                line = self.lines[at][1]
                if blank(line):
                    ahead = at + 1
                    if ahead < len(self.lines) and indent(self.lines[ahead][1]) >= 2:
                        inside.append((self.lines[at][0], ""))
                        at += 1
                        continue
                    break
                if DEFINITION.match(line) or (indent(line) < 2 and self.interrupts(at)):
                    break
                inside.append((self.lines[at][0], outdent(line, 4)))
                at += 1
            node.children.append(Node("definition", self.inner(inside), first=inside[0][0], last=inside[-1][0]))
            while at + 1 < len(self.lines) and blank(self.lines[at][1]) and DEFINITION.match(self.lines[at + 1][1]):
                at += 1
        node.last = self.lines[at - 1][0]
        return at

    def with_attributes(self, node: Node) -> Node:
        if m := ATTRIBUTES.search(node.text):
            node.attrs |= attributes(m[1])
            node.text = node.text[: m.start()].rstrip()
        return node

    # openers: each returns the block (or None where it leaves none) and the place after it

    def indented(self, at: int):
        if indent(self.lines[at][1]) < 4:
            return None
        end = at
        for i in range(at, len(self.lines)):
            line = self.lines[i][1]
            if not blank(line):
                if indent(line) < 4:
                    break
                end = i + 1
        return Node("code", text="".join(outdent(t, 4) + "\n" for _, t in self.lines[at:end])), end

    def fenced(self, at: int):
        m = FENCE.match(self.lines[at][1])
        if not m:
            return None
        close = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
        end = at + 1
        while end < len(self.lines) and not close.match(self.lines[end][1]):
            end += 1
        text = "".join(outdent(t, len(m[1])) + "\n" for _, t in self.lines[at + 1 : end])
        info = unescape(m[3])
        return Node("fence", text=text, attrs={"lang": info.split()[0] if info.split() else "", "info": info}), min(end + 1, len(self.lines))

    def heading(self, at: int):
        m = ATX.match(self.lines[at][1])
        if not m:
            return None
        text = re.sub(r"^#+$", "", (m[2] or "").strip())
        return self.with_attributes(Node("heading", text=text, level=len(m[1]))), at + 1

    def rule(self, at: int):
        return (Node("rule"), at + 1) if RULE.match(self.lines[at][1]) else None

    def formula(self, at: int):
        if not self.opens_formula(self.lines[at][1]):
            return None
        parts = [self.lines[at][1].lstrip(" \t")[2:].rstrip()]
        for i in range(at + 1, len(self.lines)):
            line = self.lines[i][1].rstrip(" \t")
            if line.endswith("$$"):
                return Node("math_block", text="\n".join([*parts, line[:-2].strip()]).strip()), i + 1
            parts.append(self.lines[i][1])
        return Node("math_block", text="\n".join(parts).strip()), len(self.lines)

    def container(self, at: int):
        m = COLONS.match(self.lines[at][1])
        if not m or not m[2]:
            return None
        end = at + 1
        while end < len(self.lines) and not ((c := COLONS.match(self.lines[end][1])) and not c[2] and len(c[1]) >= len(m[1])):
            end += 1
        node = Node("container", self.inner(self.lines[at + 1 : end]), attrs=container_info(m[2]))
        return node, min(end + 1, len(self.lines))

    def quote(self, at: int):
        if not QUOTE.match(self.lines[at][1]):
            return None
        inside, end = [], at
        while end < len(self.lines):
            number, line = self.lines[end]
            if m := QUOTE.match(line):
                inside.append((number, line[m.end() :]))
            elif inside and not blank(inside[-1][1]) and not self.interrupts(end) and not FENCE.match(inside[-1][1]) and indent(inside[-1][1]) < 4:
                inside.append((number, line))
            else:
                break
            end += 1
        node = Node("quote", self.inner(inside))
        head = node.children[0] if node.children else None
        if head and head.kind == "paragraph":
            first, _, rest = head.text.partition("\n")
            if m := ALERT.match(first.strip()):
                node.attrs["alert"] = m[1].lower()
                head.text = rest
                if not rest:
                    node.children.pop(0)
        return node, end

    def items(self, at: int):
        m = ITEM.match(self.lines[at][1])
        if not m or RULE.match(self.lines[at][1]):
            return None
        kind = m[2][-1]
        ordered = m[2][0].isdigit()
        node = Node("list", attrs={"ordered": "1", "start": str(int(m[2][:-1]))} if ordered else {})
        loose, end = False, at
        while end < len(self.lines):
            m = ITEM.match(self.lines[end][1])
            if not m or m[2][-1] != kind or m[2][0].isdigit() != ordered or RULE.match(self.lines[end][1]):
                break
            gap = len(m[3] or " ")
            width = len(m[1]) + len(m[2]) + (gap if gap <= 4 else 1)
            start = end
            inside = [(self.lines[end][0], self.lines[end][1][width:] if m[4] is not None else "")]
            end += 1
            while end < len(self.lines):
                number, line = self.lines[end]
                if blank(line):
                    if len(inside) == 1 and blank(inside[0][1]):
                        break
                    inside.append((number, ""))
                elif indent(line) >= width:
                    inside.append((number, line[width:]))
                elif not blank(inside[-1][1]) and not self.interrupts(end) and not ITEM.match(line):
                    inside.append((number, line.lstrip()))
                else:
                    break
                end += 1
            trailing = 0
            while inside and blank(inside[-1][1]):
                inside.pop()
                trailing += 1
            children = self.inner(inside)
            item = Node("item", children, first=self.lines[start][0], last=inside[-1][0] if inside else self.lines[start][0])
            if children and children[0].kind == "paragraph" and (t := re.match(r"\[([ xX])\]\s+(?=\S)", children[0].text)):
                item.attrs["task"] = "done" if t[1] in "xX" else "open"
                children[0].text = children[0].text[t.end() :]
            for a, b in zip(children, children[1:], strict=False):
                loose |= b.first - a.last > 1
            node.children.append(item)
            after = end < len(self.lines) and (n := ITEM.match(self.lines[end][1])) and n[2][-1] == kind and not RULE.match(self.lines[end][1])
            if trailing and after:
                loose = True
            if not after:
                end -= trailing
                break
        node.attrs["tight"] = "" if loose else "1"
        return node, max(end, at + 1)

    def html(self, at: int):
        for k, (opening, closing) in enumerate(HTML_BLOCKS):
            if not opening.match(self.lines[at][1]):
                continue
            end = at
            while end < len(self.lines):
                line = self.lines[end][1]
                if closing is None and blank(line):
                    break
                end += 1
                if closing is not None and closing.search(line):
                    break
            return Node("html", text="\n".join(t for _, t in self.lines[at:end]), attrs={"type": str(k + 1)}), end
        return None

    def table(self, at: int):
        if at + 1 >= len(self.lines) or "|" not in self.lines[at][1] or not DELIMITER_ROW.match(self.lines[at + 1][1]):
            return None
        head, marks = cells(self.lines[at][1]), cells(self.lines[at + 1][1])
        if len(head) != len(marks):
            return None
        align = [("center" if x[-1] == ":" else "left") if x[0] == ":" else "right" if x[-1] == ":" else "" for x in marks]
        end = at + 2
        while end < len(self.lines) and not blank(self.lines[end][1]) and not self.interrupts(end):
            end += 1
        node = Node("table", attrs={"align": ",".join(align)})
        for i in [at, *range(at + 2, end)]:
            row = (cells(self.lines[i][1]) + [""] * len(head))[: len(head)]
            number = self.lines[i][0]
            node.children.append(Node("row", [Node("cell", text=c, attrs={"align": a, "row": str(len(node.children)), "column": str(k)}, first=number, last=number) for k, (c, a) in enumerate(zip(row, align, strict=True))], attrs={"head": "1"} if i == at else {}, first=number, last=number))
        return node, end

    def note(self, at: int):
        m = NOTE.match(self.lines[at][1])
        if not m:
            return None
        inside, end = [(self.lines[at][0], m[2])], at + 1
        while end < len(self.lines):
            number, line = self.lines[end]
            if blank(line):
                if end + 1 < len(self.lines) and indent(self.lines[end + 1][1]) >= 4:
                    inside.append((number, ""))
                else:
                    break
            elif indent(line) >= 4 or (not self.interrupts(end) and not NOTE.match(line) and not blank(inside[-1][1])):
                inside.append((number, outdent(line, 4)))
            else:
                break
            end += 1
        self.context.notes.setdefault(m[1], Node("footnote", self.inner(inside), attrs={"label": m[1]}, first=self.lines[at][0], last=self.lines[end - 1][0]))
        return None, end

    def abbreviation(self, at: int):
        m = ABBREVIATION.match(self.lines[at][1])
        if not m or not m[1].strip() or not m[2].strip():
            return None
        self.context.abbreviations[m[1].strip()] = m[2].strip()
        return Node("abbr_def", attrs={"key": m[1].strip(), "title": m[2].strip()}), at + 1

    def reference(self, at: int):
        m = REFERENCE.match(self.lines[at][1])
        if not m or m[1].startswith("^") or not m[1].strip():
            return None
        href = m[2] if m[2] is not None else m[3]
        self.context.links.setdefault(normal(m[1]), (unescape(href), unescape(m[4][1:-1]) if m[4] else None))
        return None, at + 1


def cells(line: str) -> list[str]:
    """Cells of a table row; a bar behind a backslash is text."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    parts = re.split(r"(?<!\\)\|", line)
    if len(parts) > 1 and blank(parts[-1]):
        parts.pop()
    return [p.strip().replace("\\|", "|") for p in parts]


#: Openers in the order in which they are asked; add to the list to extend the syntax.
OPENERS: list[Callable] = [
    Blocks.indented,
    Blocks.fenced,
    Blocks.heading,
    Blocks.formula,
    Blocks.container,
    Blocks.rule,
    Blocks.quote,
    Blocks.items,
    Blocks.html,
    Blocks.table,
    Blocks.note,
    Blocks.abbreviation,
    Blocks.reference,
]

"""The tree that both parsers build and all tables and renderers read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Node:
    kind: str
    children: list[Node] = field(default_factory=list)
    text: str = ""  # of leaves: literal text, code, TeX, raw HTML
    attrs: dict[str, str] = field(default_factory=dict)
    level: int = 0
    first: int = 0  # lines of the source, from 0
    last: int = 0

    def walk(self) -> Iterator[Node]:
        """This node and all below it, parents first."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.children:
                stack.extend(reversed(node.children))

    def plain(self) -> str:
        """Text below this node as an outline shows it: superscripts, subscripts and formulas are left out, soft breaks are nothing."""
        return "".join(n.text for n in self.walk() if n.kind in ("text", "code_span", "autolink")).strip()

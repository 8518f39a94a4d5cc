"""A tolerant reader of HTML: a page as flat arrays of nodes with their parents.

Void, raw-text and auto-closing elements are treated as browsers do; unclosed elements end with
their parent, an end tag without a start is skipped, and one of an inline element never closes a
block. Elements whose content is never text of a page are left out with all they hold.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript title textarea template plaintext".split())
SKIPPED = frozenset("script style head title noscript template iframe noembed noframes svg math canvas object audio video select textarea button datalist map".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption dd dt legend li optgroup option tbody td tfoot th thead tr".split()) | {"hr"}
#: Which open elements a start tag ends, and the elements beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}

TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
HINT = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


class Page(NamedTuple):
    tags: list[str]  # "#text" for a run of text
    parents: list[int]
    hints: list[str]  # class, id, role and the like, lower-cased; a text run has none
    texts: list[str]  # of text runs, decoded
    blocks: list[int]  # for each node the number of the block that text here belongs to


def read(html: str) -> Page:
    tags, parents, hints, texts, blocks = ["#root"], [-1], [""], [""], [0]
    stack, block, skip, at, end = [0], 0, 0, 0, len(html)

    def add(tag: str, hint: str, text: str) -> None:
        tags.append(tag)
        parents.append(stack[-1])
        hints.append(hint)
        texts.append(text)
        blocks.append(block)

    def run(raw: str) -> None:
        if not skip and raw and not raw.isspace():
            add("#text", "", unescape(raw))
        elif not skip and raw and tags[-1] == "#text" and blocks[-1] == block:
            texts[-1] += " "  # white space between inline elements

    def shut(to: int) -> None:
        nonlocal block, skip
        while len(stack) > to:
            tag = tags[stack.pop()]
            if tag in BLOCK:
                block += 1
            if tag in SKIPPED:
                skip -= 1

    while at < end:
        m = TAG.search(html, at)
        if not m:
            run(html[at:])
            break
        run(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if not html[at - 1 : at] == ">":  # cut off within a tag
            break
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = tags[stack[depth]]
                if open_tag == name:
                    shut(depth)
                    break
                if open_tag in BLOCK and name not in BLOCK and name not in SKIPPED:
                    break
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == "p":
                    shut(depth)
                    break
                if tags[stack[depth]] in BLOCK:
                    break
        if name in ENDS:
            ended, limit = ENDS[name]
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = tags[stack[depth]]
                if open_tag in limit:
                    break
                if open_tag in ended:
                    shut(depth)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
        if name == "body":
            for depth in range(1, len(stack)):
                if tags[stack[depth]] == "head":
                    shut(depth)
                    break
        if name in BLOCK:
            block += 1
        if name == "br":
            run(" ")
            continue
        if name in VOID:
            continue
        hint = " ".join(a or b or c for a, b, c in HINT.findall(rest)).lower() if rest else ""
        if rest and HIDDEN.search(rest):
            hint += " hidden"
        add(name, hint, "")
        stack.append(len(tags) - 1)
        skip += name in SKIPPED
        if name in RAW and not rest.endswith("/"):
            m = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            run(html[at : m.start() if m else end])
            at = m.end() if m else end
            shut(len(stack) - 1)
    return Page(tags, parents, hints, texts, blocks)

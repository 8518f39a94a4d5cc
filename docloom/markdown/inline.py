"""Inline syntax, by a registry of scanners: each trigger character has its scanners in order of priority.

A scanner gets the cursor at its trigger and returns a node and the place after it, or None; the
next one is asked then, and the character is text if none takes it. Emphasis-like runs are kept as
delimiters and paired when the text ends or a link closes.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from docloom.markdown.nodes import Node

PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
# Shortcodes of emoji.
EMOJI = {
    "tada": "🎉", "rocket": "🚀", "sparkles": "✨", "heart": "❤️", "+1": "👍", "thumbsup": "👍", "-1": "👎", "thumbsdown": "👎",
    "coffee": "☕", "fire": "🔥", "books": "📚", "book": "📖", "bug": "🐛", "zap": "⚡", "smile": "😄", "grin": "😁", "joy": "😂",
    "wink": "😉", "blush": "😊", "cry": "😢", "sob": "😭", "thinking": "🤔", "eyes": "👀", "wave": "👋", "clap": "👏", "pray": "🙏",
    "muscle": "💪", "star": "⭐", "star2": "🌟", "sunny": "☀️", "cloud": "☁️", "snowflake": "❄️", "warning": "⚠️", "x": "❌",
    "white_check_mark": "✅", "heavy_check_mark": "✔️", "question": "❓", "exclamation": "❗", "bulb": "💡", "memo": "📝",
    "pencil": "📝", "lock": "🔒", "key": "🔑", "link": "🔗", "mag": "🔍", "hammer": "🔨", "wrench": "🔧", "gear": "⚙️",
    "package": "📦", "computer": "💻", "phone": "☎️", "email": "📧", "calendar": "📆", "clock1": "🕐", "hourglass": "⌛",
    "100": "💯", "beer": "🍺", "pizza": "🍕", "cat": "🐱", "dog": "🐶", "bear": "🐻", "snake": "🐍", "whale": "🐳", "earth_americas": "🌎",
}
SCHEME = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
ADDRESS = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
RAW = re.compile(
    r"""<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>|<!---->|<!--(?!>|->).*?-->|<\?.*?\?>|<![A-Z]+\s[^>]*>|<!\[CDATA\[.*?\]\]>""",
    re.S,
)
ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
BARE_URL = re.compile(r"(?<![^\W_])(?:https?://|ftp://|www\.)(?=[^\s<])", re.I)
REST_OF_URL = re.compile(r"[^\s<]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SEPARATORS = frozenset("._+-")
LOCAL_PART = SEPARATORS | frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SHORTCODE = re.compile(r":([A-Za-z0-9_+-]+):")
#: Formulas of one line: the first sign that no backslash escapes must close it, with no space before and no digit after.
FORMULA = re.compile(r"\$((?=[^ \t\n\r\v\f])(?:[^\\$\n]|\\[^\n])+)(?<![ \t\n\r\v\f])\$(?![0-9])")
DISPLAYED = re.compile(r"\$\$([^\n]*?)\$\$")
TASK = re.compile(r"\[([ xX])\](?=\s)")


@dataclass
class Delimiter:
    char: str
    count: int
    opens: bool
    closes: bool
    at: int  # place among the nodes


def is_space(c: str) -> bool:
    return not c or c.isspace()


def is_mark(c: str) -> bool:
    return c in PUNCTUATION or unicodedata.category(c)[0] in "PS" if c else False


def addresses(source: str) -> Iterator[tuple[int, int]]:
    """Start and end of each bare mail address, in order; they begin with a letter or digit, and no text is read twice."""
    at, end = source.find("@"), 0
    while at >= 0:
        if m := DOMAIN.match(source, at + 1):
            start = at
            while start > end and source[start - 1] in LOCAL_PART:
                start -= 1
            while start < at and source[start] in SEPARATORS:
                start += 1
            if start < at:
                end = m.end()
                yield start, end
        at = source.find("@", at + 1)


def bare_links(source: str) -> dict[int, int]:
    """Where bare links may begin, in order: the ends of addresses, and 0 for URLs, whose end depends on what is around them."""
    found = dict(addresses(source))
    if "://" in source or "www." in source.lower():
        found |= {m.start(): 0 for m in BARE_URL.finditer(source)}
    return dict(sorted(found.items()))


def escape(text: str) -> str:
    """Text as HTML, with numeric references for quotes."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("'", "&#39;").replace('"', "&#34;")


class Inline:
    """One run of inline text; links and footnotes are those that the block parser found."""

    def __init__(self, source: str, links: dict[str, tuple[str, str | None]], notes: set[str] | dict):
        self.source, self.links, self.notes = source, links, notes
        self.nodes: list[Node] = []
        self.delimiters: list[Delimiter] = []
        self.brackets: list[tuple[int, int, bool, int]] = []  # node, place in the source, image, delimiters before
        self.bare = bare_links(source)
        self.starts = list(self.bare)

    def line(self, at: int) -> str:
        end = self.source.find("\n", at)
        return self.source[at:] if end < 0 else self.source[at:end]

    def add_text(self, text: str) -> None:
        if not text:
            return
        if self.nodes and self.nodes[-1].kind == "text" and not self.nodes[-1].attrs:
            self.nodes[-1].text += text
        else:
            self.nodes.append(Node("text", text=text))

    def parse(self) -> list[Node]:
        source, at, end = self.source, 0, len(self.source)
        while at < end:
            c = source[at]
            for scan in SCANNERS.get(c, ()):
                after = scan(self, at)
                if after is not None:
                    at = after
                    break
            else:
                found = TRIGGERS.search(source, at + 1)
                upto = found.start() if found else end
                if at in self.bare:
                    at = self.bare_link(at)
                    continue
                upto = self.next_word(at + 1, upto)
                self.add_text(source[at:upto])
                at = upto
        self.pair(0)
        return self.nodes

    def next_word(self, at: int, upto: int) -> int:
        """The next place up to upto where a bare link begins."""
        i = bisect_left(self.starts, at)
        return min(upto, self.starts[i]) if i < len(self.starts) else upto

    def bare_link(self, at: int) -> int:
        if end := self.bare[at]:
            address = self.source[at:end]
            self.nodes.append(Node("autolink", text=address, attrs={"href": "mailto:" + address}))
            return end
        url = REST_OF_URL.match(self.source, at)[0].rstrip("?!.,:*_~'\"")
        while url.endswith(")") and url.count(")") > url.count("("):
            url = url[:-1].rstrip("?!.,:*_~'\"")
        self.nodes.append(Node("autolink", text=url, attrs={"href": url if "://" in url else "http://" + url}))
        return at + len(url)

    # scanners: each returns the place after what it took, or None

    def escaped(self, at: int) -> int | None:
        after = self.source[at + 1 : at + 2]
        if after == "\n":
            self.nodes.append(Node("hard_break"))
            return at + 2
        if after in PUNCTUATION and after:
            self.add_text(after)
            return at + 2
        return None

    def code(self, at: int) -> int | None:
        run = len(re.compile(r"`+").match(self.source, at)[0])
        for m in re.compile(r"`+").finditer(self.source, at + run):
            if len(m[0]) == run:
                text = self.source[at + run : m.start()].replace("\n", " ")
                if len(text) > 2 and text[0] == text[-1] == " " and text.strip():
                    text = text[1:-1]
                self.nodes.append(Node("code_span", text=text))
                return m.end()
        self.add_text("`" * run)
        return at + run

    def wikilink(self, at: int) -> int | None:
        line = self.line(at)
        close = line.find("]]", 2)
        if not line.startswith("[[") or close < 0 or not line[2:close].strip():
            return None
        destination, shown = wiki_target(line[2:close])
        self.nodes.append(Node("link", [Node("text", text=shown)], attrs={"href": destination, "wiki": line[2:close]}))
        return at + close + 2

    def footnote(self, at: int) -> int | None:
        m = re.compile(r"\[\^([^\]\s]+)\]").match(self.source, at)
        if not m or m[1] not in self.notes:
            return None
        self.nodes.append(Node("footnote_ref", text=m[1]))
        return m.end()

    def bracket(self, at: int) -> int | None:
        self.brackets.append((len(self.nodes), at + 1, False, len(self.delimiters)))
        self.nodes.append(Node("text", text="[", attrs={"open": "1"}))
        return at + 1

    def image(self, at: int) -> int | None:
        if self.source[at + 1 : at + 2] != "[":
            return None
        self.brackets.append((len(self.nodes), at + 2, True, len(self.delimiters)))
        self.nodes.append(Node("text", text="![", attrs={"open": "1"}))
        return at + 2

    def close_bracket(self, at: int) -> int | None:
        if not self.brackets:
            return None
        node, start, image, before = self.brackets.pop()
        target = self.target(at + 1, self.source[start:at])
        if target is None:
            self.nodes[node].attrs.pop("open", None)
            return None
        href, title, after = target
        self.pair(before)
        inner = self.nodes[node + 1 :]
        if not image and any(n.kind == "link" for x in inner for n in x.walk()):
            return None
        self.nodes[node:] = [Node("image" if image else "link", inner, attrs={"href": href} | ({"title": title} if title is not None else {}))]
        if not image:
            self.brackets = [b for b in self.brackets if b[2]]
        return after

    def target(self, at: int, label: str) -> tuple[str, str | None, int] | None:
        """Destination, title and end of what follows a closing bracket."""
        m = re.compile(r"""\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""", re.S).match(self.source, at)
        if m:
            title = unescape(m[3][1:-1]) if m[3] else None
            return unescape(m[1] if m[1] is not None else m[2] or ""), title, m.end()
        m = re.compile(r"\[([^\[\]]*)\]").match(self.source, at)
        name = normal(m[1] if m and m[1].strip() else label)
        if name in self.links:
            return *self.links[name], m.end() if m else at
        return None

    def angle(self, at: int) -> int | None:
        for pattern, prefix in ((SCHEME, ""), (ADDRESS, "mailto:")):
            if m := pattern.match(self.source, at):
                self.nodes.append(Node("autolink", text=m[1], attrs={"href": prefix + m[1]}))
                return m.end()
        if m := RAW.match(self.source, at):
            self.nodes.append(Node("raw_html", text=m[0]))
            return m.end()
        return None

    def entity(self, at: int) -> int | None:
        m = ENTITY.match(self.source, at)
        if not m or (text := html.unescape(m[0])) == m[0]:
            return None
        self.add_text(text)
        return m.end()

    def formula(self, at: int) -> int | None:
        display = self.source.startswith("$$", at)
        m = (DISPLAYED if display else FORMULA).match(self.source, at)
        if not m:
            return None
        self.nodes.append(Node("math", text=m[1].strip(), attrs={"display": "1"}) if display else Node("math", text=m[1]))
        return m.end()

    def script(self, at: int) -> int | None:
        char = self.source[at]
        m = re.compile(rf"{re.escape(char)}([^\s{re.escape(char)}]+){re.escape(char)}").match(self.source, at)
        if not m:
            return None
        self.nodes.append(Node("sup" if char == "^" else "sub", text=m[1]))
        return m.end()

    def emoji(self, at: int) -> int | None:
        m = SHORTCODE.match(self.source, at)
        if not m or m[1] not in EMOJI:
            return None
        self.nodes.append(Node("emoji", text=EMOJI[m[1]], attrs={"name": m[1]}))
        return m.end()

    def delimiter(self, at: int) -> int | None:
        char = self.source[at]
        run = len(re.compile(re.escape(char) + "+").match(self.source, at)[0])
        if char in "=+~" and run != 2 and not (char == "~" and run == 1):
            self.add_text(char * run)
            return at + run
        before, after = self.source[at - 1 : at] if at else "", self.source[at + run : at + run + 1]
        left = not is_space(after) and (not is_mark(after) or is_space(before) or is_mark(before))
        right = not is_space(before) and (not is_mark(before) or is_space(after) or is_mark(after))
        opens = left and (char != "_" or not right or is_mark(before))
        closes = right and (char != "_" or not left or is_mark(after))
        self.delimiters.append(Delimiter(char, run, opens, closes, len(self.nodes)))
        self.nodes.append(Node("text", text=char * run, attrs={"run": "1"}))
        return at + run

    def smart(self, at: int) -> int | None:
        for plain, sign in (("...", "…"), ("---", "—"), ("--", "–"), ("<<", "«"), (">>", "»")):
            if self.source.startswith(plain, at):
                self.add_text(sign)
                return at + len(plain)
        c = self.source[at]
        if c not in "\"'":
            return None
        before, after = self.source[at - 1 : at] if at else "", self.source[at + 1 : at + 2]
        opening = (is_space(before) or before in "([{—–-") and not is_space(after)
        self.add_text(("“" if opening else "”") if c == '"' else "‘" if opening else "’")
        return at + 1

    def line_end(self, at: int) -> int | None:
        last = self.nodes[-1] if self.nodes and self.nodes[-1].kind == "text" else None
        hard = bool(last and last.text.endswith("  "))
        if last:
            last.text = last.text.rstrip(" ")
        self.nodes.append(Node("hard_break" if hard else "soft_break"))
        after = at + 1
        while self.source[after : after + 1] in (" ", "\t"):
            after += 1
        return after

    def pair(self, bottom: int) -> None:
        """Pairs the delimiters from bottom on, innermost first, and wraps what lies between."""
        stack = self.delimiters
        i = bottom
        while i < len(stack):
            closer = stack[i]
            if not closer.closes:
                i += 1
                continue
            for j in range(i - 1, bottom - 1, -1):
                opener = stack[j]
                if opener.char != closer.char or not opener.opens:
                    continue
                if opener.char in "*_" and (opener.closes or closer.opens) and (opener.count + closer.count) % 3 == 0 and not opener.count % 3 == closer.count % 3 == 0:
                    continue
                if opener.char not in "*_" and opener.count != closer.count:
                    continue
                break
            else:
                if closer.opens:
                    i += 1
                else:
                    del stack[i]
                continue
            used = closer.count if closer.char not in "*_" else 2 if opener.count >= 2 and closer.count >= 2 else 1
            kind = {"~": "del", "=": "mark", "+": "ins"}.get(closer.char) or ("strong" if used == 2 else "em")
            inner = self.nodes[opener.at + 1 : closer.at]
            opener.count, closer.count = opener.count - used, closer.count - used
            self.nodes[opener.at].text = opener.char * opener.count
            self.nodes[closer.at].text = closer.char * closer.count
            self.nodes[opener.at + 1 : closer.at] = [Node(kind, [n for n in inner if n.text or n.kind != "text"])]
            moved = len(inner) - 1
            del stack[j + 1 : i]
            i = j + 1
            for later in stack[i:]:
                later.at -= moved
            self.brackets = [(n - moved if n > opener.at else n, *rest) for n, *rest in self.brackets]
            if not opener.count:
                del stack[j]
                i -= 1
            if not closer.count:
                del stack[i]
        del stack[bottom:]


def wiki_target(inner: str) -> tuple[str, str]:
    """Destination and shown text of the inside of a wikilink."""
    target, _, shown = inner.partition("|")
    target, shown = target.strip(), shown.strip()
    shown = shown or target
    page, sharp, section = target.partition("#")
    if page and not re.search(r"\.[^./\\]*$", page):
        page += ".md"
    return page + sharp + section, shown


def normal(label: str) -> str:
    return " ".join(label.split()).casefold()


def unescape(text: str) -> str:
    return html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text))


#: Scanners by trigger, first asked first; add to a list to extend the syntax.
SCANNERS: dict[str, list[Callable[[Inline, int], int | None]]] = {
    "\\": [Inline.escaped],
    "`": [Inline.code],
    "[": [Inline.wikilink, Inline.footnote, Inline.bracket],
    "!": [Inline.image],
    "]": [Inline.close_bracket],
    "<": [Inline.angle, Inline.smart],
    ">": [Inline.smart],
    "&": [Inline.entity],
    "^": [Inline.script],
    "~": [Inline.script, Inline.delimiter],
    "*": [Inline.delimiter],
    "_": [Inline.delimiter],
    "=": [Inline.delimiter],
    "+": [Inline.delimiter],
    "$": [Inline.formula],
    ":": [Inline.emoji],
    '"': [Inline.smart],
    "'": [Inline.smart],
    "-": [Inline.smart],
    ".": [Inline.smart],
    "\n": [Inline.line_end],
}
TRIGGERS = re.compile("[" + re.escape("".join(SCANNERS)) + "]")

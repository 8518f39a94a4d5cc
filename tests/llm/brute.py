"""Plain Python answers that the operators are held against."""

from __future__ import annotations

import functools
import hashlib
import html.parser
import math
import re
import statistics
import string
import urllib.parse
from collections import Counter

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
CODE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return CODE_WORD.findall((text or "").translate(LOWER))


def leaks(text: str | None, items: list[tuple[int | None, str | None]], size: int = 10) -> tuple[int, int, list[str]]:
    """Words, hit words and item_ids hit."""
    own = words(text)
    hit, named = set(), set()
    for item_id, item in items:
        w = words(item)
        k = min(size, len(w))
        if not k:
            continue
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(own) - k + 1):
            if tuple(own[i : i + k]) in windows:
                hit.update(range(i, i + k))
                named.add(str(item_id))
    return len(own), len(hit), sorted(named - {"None"})


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text: str | None) -> list[str]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def shingles(text: str | None, size: int = 5) -> Counter:
    w = words(text)
    if 0 < len(w) < size:
        return Counter([tuple(w)])
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_classes(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """Class of each position in rows, as the position of its first member."""
    bags = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, n = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (not bags[i] and not bags[j]) or (n and both * 5 >= n * 4):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(rows))}


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def repeated_bytes(rows: list[tuple[int | None, str | None]], size: int = 100) -> list[tuple[int, int, int, str]]:
    """For rows in order: n_bytes, n_removed, n_spans, digest of the rest."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            part = data[i : i + size]
            if part in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(part)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(data)))
        out.append((len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return out


class Spelling:
    """Class-conditional Kneser-Ney models of words, from texts with their class, with plain dictionaries."""

    def __init__(self, rows, concentration, part, step):
        self.concentration, self.part, self.step = concentration, part, step
        self.n = [Counter(), Counter()]
        for text, toxic in rows:
            for word in self.words(text):
                for before, symbol in self.spelled(word):
                    self.n[toxic][before, symbol] += 1
        self.both = self.n[0] + self.n[1]
        self.types = Counter((before[-2:], symbol) for before, symbol in self.both)
        self.cut = [self.discount(c) for c in (*self.n, self.both, self.types)]

    @staticmethod
    def words(text):
        return [w[k : k + 24] for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()) for k in range(0, len(w), 24)]

    @staticmethod
    def spelled(word):
        return [(word[:k], word[k] if k < len(word) else 256) for k in range(len(word) + 1)]

    @staticmethod
    def discount(counts):
        once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once else 0.5

    @staticmethod
    def discounted(counts, cut, context, symbol, lower, held=0.0):
        here = [counts[context, s] for s in range(257)]
        total = sum(here) + held
        return (max(counts[context, symbol] - cut, 0) + (held + sum(min(n, cut) for n in here)) * lower) / total if total else lower

    def shared(self, before, symbol):
        lower = self.discounted(self.types, self.cut[3], before[-2:], symbol, 1 / 257)
        return self.discounted(self.both, self.cut[2], before, symbol, lower)

    def of_class(self, c, before, symbol):
        if not self.both[before, symbol]:
            return self.shared(before, symbol)
        seen = sum(self.shared(before, s) for s in range(257) if self.both[before, s])
        return seen * self.discounted(self.n[c], self.cut[c], before, symbol, self.shared(before, symbol) / seen, self.concentration)

    @functools.cache  # noqa: B019
    def word(self, word):
        steps = [sum(round(math.log(self.of_class(c, *x) / self.shared(*x)) / self.step) for x in self.spelled(word)) for c in (0, 1)]
        return math.log(self.part + (1 - self.part) * math.exp(steps[1] * self.step)) - math.log(self.part + (1 - self.part) * math.exp(steps[0] * self.step))

    def ratio(self, text):
        told = [self.word(w) for w in self.words(text)]
        return sum(told) / len(told) - statistics.median(told) if told else 0.0


class Links(html.parser.HTMLParser):
    """Base, canonical links and refresh targets of a page."""

    def __init__(self, text):
        super().__init__()
        self.base, self.found = None, []
        self.feed(text or "")

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "base" and self.base is None:
            self.base = a.get("href", "").strip()
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a.get("href", "").strip())
        if tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh":
            target = re.match(r"(?i)[\s0-9.]*[;,\s]\s*(?:url\s*=\s*)?(.*)$", a.get("content", ""))
            self.found.append(target[1].strip().strip("'\"") if target else "")


def url_node(url):
    scheme, mark, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0]
    if not mark or not host:
        return None
    path = rest[len(host) :].partition("#")[0]
    path, query, more = path.partition("?")
    kept: list[str] = []
    parts = path.split("/")[1:]
    for x in parts if "/." in path else []:
        kept = kept if x == "." else kept[:-1] if x == ".." else [*kept, x]
    if "/." in path:
        path = "/" + "/".join([*kept, ""] if parts[-1] in (".", "..") else kept)
    return f"{scheme.lower()}://{host.lower()}{path + query + more or '/'}"


def aliases(pages):
    """The sets of nodes that canonical links and refreshes join."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for url, text in pages:
        links = Links(text)
        base = urllib.parse.urljoin(url, links.base) if links.base else url
        for href in links.found:
            a, b = url_node(url), url_node(urllib.parse.urljoin(base, href)) if href else None
            if a and b:
                up[top(a)] = top(b)
    out: dict = {}
    for x in list(up):
        out.setdefault(top(x), set()).add(x)
    return [s for s in out.values() if len(s) > 1]

"""Rendered HTML without what could run: an allow-list of elements, attributes and link schemes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from docloom.markdown.inline import escape

# What may stay.
ELEMENTS = frozenset(
    "a abbr b blockquote br code col colgroup dd del details div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img input ins kbd li mark ol p pre q s samp section small span strong sub summary sup svg table tbody td tfoot th thead tr u ul use var wbr".split()
)
ATTRIBUTES = frozenset("align alt aria-hidden checked class colspan data-doc data-external data-frag data-lang data-open disabled height href id open rel role rowspan src start style title type viewbox width".split())
DROPPED = frozenset("script style iframe object embed template noscript form textarea select button title".split())
EMPTY = frozenset("br col hr img input wbr use".split())
UNSAFE = re.compile(r"^[\x00-\x20]*(?:javascript|vbscript|data(?!:image/(?:png|gif|jpeg|webp|svg\+xml)))[\x00-\x20]*:", re.I)


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            self.skip += 1
        if self.skip or tag not in ELEMENTS:
            return
        kept = [(k, v or "") for k, v in attrs if k in ATTRIBUTES and not (k in ("href", "src") and UNSAFE.match(v or "")) and not (k == "style" and re.search(r"url\(|expression|@import", v or "", re.I))]
        self.out.append(f"<{tag}" + "".join(f' {k}="{escape(v)}"' for k, v in kept) + ">")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in ELEMENTS and tag not in EMPTY:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data.replace("<", "&lt;"))

    def handle_entityref(self, name: str) -> None:
        if not self.skip:
            self.out.append(f"&{name};")

    def handle_charref(self, name: str) -> None:
        if not self.skip:
            self.out.append(f"&#{name};")


def sanitize(html: str) -> str:
    cleaner = _Cleaner()
    cleaner.feed(html)
    cleaner.close()
    return "".join(cleaner.out)

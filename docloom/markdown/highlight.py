"""Code as HTML: tokens by language where a highlighter is installed, else plain."""

from __future__ import annotations

from functools import cache

from docloom.markdown.inline import escape


@cache
def _lexer(lang: str):
    try:
        from pygments.lexers import get_lexer_by_name
        from pygments.util import ClassNotFound
    except ImportError:
        return None
    try:
        return get_lexer_by_name(lang, stripnl=False, ensurenl=False)
    except ClassNotFound:
        return None


def highlighted(code: str, lang: str) -> str:
    """The inside of a code element: spans with short token classes, or escaped text for a language that is not known."""
    lexer = _lexer(lang.lower()) if lang else None
    if lexer is None:
        return escape(code)
    from pygments.token import STANDARD_TYPES

    out = []
    for kind, text in lexer.get_tokens(code):
        while kind not in STANDARD_TYPES:
            kind = kind.parent
        name = STANDARD_TYPES[kind]
        out.append(f'<span class="{name}">{escape(text)}</span>' if name and text.strip() else escape(text))
    return "".join(out)

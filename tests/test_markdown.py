"""The parser and renderer: constructs that must appear in the HTML of a page of everything, and rules one by one."""

from __future__ import annotations

import random

import pytest

from docloom.markdown import parse, render
from docloom.markdown.sanitize import sanitize
from docloom.markdown.paths import classify_link, is_markdown, resolve_asset

PAGE = """---
title: Trial · by fire
author: Ana
tags: [markdown, math]
---

# A first heading

> "A quote." — somebody[^1]

*soft*, **strong**, ***both***, ~~gone~~, `code`, H<sub>2</sub>O, <kbd>Ctrl</kbd> --- dash.

A link [out](https://example.com), one [inside](#tablas), a bare https://example.org and a mail a@example.com.

## Listas

- one
  - inner
    - deepest
- two

1. first
2. second

- [x] done
- [ ] open

Term
: What it means.

## Tablas

| Name | Use |
|:-----|----:|
| a    | 1   |

```go
func main() {}
```

Euler: $e^{i\\pi} + 1 = 0$.

$$
\\int e^{-x^2}\\,dx
$$

```mermaid
flowchart LR
    A["x"] --> B
```

> [!NOTE]
> With **format**.

> [!TIP]
> t

> [!IMPORTANT]
> i

> [!WARNING]
> w

> [!CAUTION]
> c

:tada: :rocket: :+1:

==resaltado== ++ins++ x^2^ e^10^ H~2~O

[[Arquitectura]], [[Arquitectura|ver el diseño]], [[Tablas#encabezado]], [[#emoji]], [far](other.md#tablas)

## Own id {#mi-ancla}

<details>
<summary>More</summary>

Inside **text**.

</details>

The API of an API.

*[API]: Application Programming Interface

::: tip
x
:::

::: warning Atención especial
y
:::

:::: danger
::: tip
inner
:::
::::

::: {.nota-propia #seccion-x}
z
:::

```markdown
# Título embebido

**resaltado-embebido** and `::: tip`
```

[^1]: The note.
"""

MUST = [
    'class="math math-display"', 'class="math math-inline"', '<pre class="mermaid">', 'class="chroma"', 'class="codeblock"', 'data-lang="go"',
    "<table>", 'class="footnotes"', "<dl>", 'type="checkbox"', "<del>", "<details>", "<summary>", "<kbd>", 'data-external="1"', 'href="#tablas"',
    'id="tablas"', 'id="mi-ancla"', "Arquitectura.md", "ver el diseño", 'href="#emoji"', 'data-frag="tablas"', 'data-frag="encabezado"',
    "alert alert-note", "alert alert-tip", "alert alert-important", "alert alert-warning", "alert alert-caution", 'class="alert-title"', 'class="alert-ico"',
    "\U0001f389", "\U0001f680", "\U0001f44d", "<mark>", "<ins>", "<sup>10</sup>", "<sub>", "<abbr title=",
    '<abbr title="Application Programming Interface">API</abbr>', "callout callout-tip", "callout callout-warning", "callout callout-danger",
    'class="callout-title"', "Atención especial", 'class="nota-propia"', 'id="seccion-x"', 'class="md-embed"', "<h1>Título embebido</h1>",
    "<strong>resaltado-embebido</strong>",
]
ABSENT = ["==resaltado==", "[[Arquitectura]]", ":tada:", "[!NOTE]", "e^10^", "*[API]:", "**resaltado-embebido**"]


@pytest.fixture(scope="module")
def page():
    return render(PAGE, "docs/page.md")


@pytest.mark.parametrize("part", MUST)
def test_contains(page, part):
    assert part in page[0]


@pytest.mark.parametrize("part", ABSENT)
def test_lacks(page, part):
    assert part not in page[0]


def test_scalars(page):
    html, doc = page
    assert doc.title == "Trial · by fire"
    assert [t[1] for t in doc.toc] == ["A first heading", "Listas", "Tablas", "Own id"]
    assert doc.words == len(PAGE.split())
    assert doc.front["tags"] == ["markdown", "math"]
    assert "::: tip" not in html.replace("<code>::: tip</code>", "")


CASES = [
    ("a *b **c** d* e", "<p>a <em>b <strong>c</strong> d</em> e</p>"),
    ("***x***", "<p><em><strong>x</strong></em></p>"),
    ("a_b_c _d_", "<p>a_b_c <em>d</em></p>"),
    ("a\n===\nb\n---", '<h1 id="a">a</h1>\n<h2 id="b">b</h2>'),
    ("# A\n# A\n# !", '<h1 id="a">A</h1>\n<h1 id="a-1">A</h1>\n<h1 id="heading">!</h1>'),
    ("`` a`b ``", "<p><code>a`b</code></p>"),
    ("\\*x\\* &copy; &nope;", "<p>*x* © &amp;nope;</p>"),
    ("a  \nb\\\nc\nd", "<p>a<br>\nb<br>\nc\nd</p>"),
    ("- a\n- b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>"),
    ("3) a\n4) b", '<ol start="3">\n<li>a</li>\n<li>b</li>\n</ol>'),
    ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>"),
    ("    code <x>", '<div class="codeblock"><pre class="chroma"><code>code &lt;x&gt;\n</code></pre></div>'),
    ("~~~ zzz x\na\n~~~~", '<div class="codeblock" data-lang="zzz"><pre class="chroma"><code>a\n</code></pre></div>'),
    ("> a\nb\n\nc", "<blockquote>\n<p>a\nb</p>\n</blockquote>\n<p>c</p>"),
    ("> > a", "<blockquote>\n<blockquote>\n<p>a</p>\n</blockquote>\n</blockquote>"),
    ("> [!note] x", "<blockquote>\n<p>[!note] x</p>\n</blockquote>"),
    ("***", "<hr>"),
    ('[a][r] [r]\n\n[R]: #x "t"', '<p><a href="#x" title="t">a</a> <a href="#x" title="t">r</a></p>'),
    ("![a *b*](x.png)", '<p><img src="/asset?path=d%2Fx.png" alt="a b"></p>'),
    ("<https://a.b> <a@b.c>", '<p><a href="https://a.b">https://a.b</a> <a href="mailto:a@b.c">a@b.c</a></p>'),
    ("see me@x.com, www.a.b.", '<p>see <a href="mailto:me@x.com">me@x.com</a>, <a href="http://www.a.b">www.a.b</a>.</p>'),
    ("$5 and $6", "<p>$5 and $6</p>"),
    ("$a$5", "<p>$a$5</p>"),
    ("$ a$ $b $", "<p>$ a$ $b $</p>"),
    ("$a\\$b$", '<p><span class="math math-inline">a\\$b</span></p>'),
    ("$$a$$ b", '<p><span class="math math-display">a</span> b</p>'),
    ("x\n$$ a\nb $$\ny", '<p>x</p>\n<div class="math math-display">a\nb</div>\n<p>y</p>'),
    ("$$\nopen", '<div class="math math-display">open</div>'),
    ("x^a b^ ^^ ~~y~~ ~z~", "<p>x^a b^ ^^ <del>y</del> <sub>z</sub></p>"),
    ("===x=== ==y== ++z++ +w+", "<p>===x=== <mark>y</mark> <ins>z</ins> +w+</p>"),
    ("[[ ]] [[a", "<p>[[ ]] [[a</p>"),
    ("[[A | b]] [[v1.2]]", '<p><a href="#" data-doc="d/A.md">b</a> <a href="#" data-open="d/v1.2">v1.2</a></p>'),
    ("*[A]: x\n*[AB]: y\nA AB `A` aA", '<p><abbr title="x">A</abbr> <abbr title="y">AB</abbr> <code>A</code> aA</p>'),
    ("*[A]: x\n*[A]: y\nA", '<p><abbr title="y">A</abbr></p>'),
    ("::: a b c\nx\n:::", '<div class="callout callout-a"><p class="callout-title">b c</p>\n<p>x</p>\n</div>'),
    (":::\nx", "<p>:::\nx</p>"),
    ("a[^n] b[^n] c[^m]\n\n[^n]: note", '<p>a<sup id="fnref:1"><a href="#fn:1" class="footnote-ref" role="doc-noteref">1</a></sup> b<sup id="fnref1:1"><a href="#fn:1" class="footnote-ref" role="doc-noteref">1</a></sup> c[^m]</p>'),
    ("```md\n```md\nx", '<div class="md-embed">\n<div class="codeblock" data-lang="md"><pre class="chroma"><code>x\n</code></pre></div>\n</div>'),
    ("", ""),
]


@pytest.mark.parametrize(("source", "html"), CASES)
def test_rule(source, html):
    got = render(source, "d/x.md")[0].rstrip("\n")
    assert got == html or html and got.startswith(html + "\n<div class=\"footnotes\"")


def test_embedded_code_is_rendered_one_level_deep():
    html = render("````md\n# T\n```md\n*x*\n```\n````")[0]
    assert "<h1>T</h1>" in html and html.count("md-embed") == 1 and "*x*" in html


def test_links():
    assert classify_link("d", "") == ("normal", "", "")
    assert classify_link("d", "?q#x") == ("anchor", "", "")
    assert classify_link("d", "HTTPS://x") == ("external", "", "")
    assert classify_link("d/e", "../x/./y.MD?q#s") == ("doc", "d/x/y.MD", "s")
    assert classify_link("/r", "../../x.png#f") == ("open", "/x.png", "")
    assert classify_link("C:\\d", "x/y.md", windows=True) == ("doc", "C:\\d\\x\\y.md", "")
    assert resolve_asset("d", "a b~*é.png") == "/asset?path=d%2Fa+b~%2A%C3%A9.png"
    assert resolve_asset("d", "data:x") == "data:x" and resolve_asset("d", "") == ""
    assert [is_markdown(x) for x in ("a.md", "b.QMD", "c.litcoffee", "md", "d.md/e", "f.tar.text")] == [True, True, False, False, False, True]


@pytest.mark.parametrize(
    ("source", "addresses"),
    [
        ("see first.middle.last@x.org", ["first.middle.last@x.org"]),
        ("a-b_c.d+e@x.org.", ["a-b_c.d+e@x.org"]),
        ("l" * 100 + "@x.org", ["l" * 100 + "@x.org"]),
        ("éab.c@x.org", ["ab.c@x.org"]),
        ("a@x.org_b@y.org *c@z.org*", ["a@x.org", "b@y.org", "c@z.org"]),
        ("..a@x.org.. @x.org a@x a@x@y.org", ["a@x.org", "x@y.org"]),
        ("`a@x.org` $a@x.org$ $$$ a@x.org $$$ b@x.org", ["b@x.org"]),
    ],
)
def test_bare_addresses(source, addresses):
    assert [n.attrs["href"] for n in parse(source).root.walk() if n.kind == "autolink"] == ["mailto:" + a for a in addresses]


@pytest.mark.parametrize("source", ["a." * 100_000, "a@" * 100_000, "@a." * 60_000, "a.b_" * 50_000 + "@", "x@" + "a." * 100_000 + "b", "www." * 40_000])
def test_long_texts_with_signs_of_addresses_end(source):
    assert parse(source).words == 1


def test_any_text_parses():
    r = random.Random(0)
    alphabet = ["\n", "\n\n", " ", "  ", "\t", "*", "**", "_", "`", "```", "~", "~~", "$", "$$", "[", "]", "[[", "]]", "(", ")", "<", ">", "> ", "- ", "1. ", "#", "# ", ":::", ": ", "|", "---", "=", "==", "^", "!", "![", "[^a]", "[^a]: ", "*[k]: v", "\\", "&amp;", "a", "k", "word", "é", "{#x}", "http://x.y", "    "]
    for _ in range(1500):
        source = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        html, doc = render(source, "x.md")
        assert isinstance(html, str) and doc.words == len(source.split())


@pytest.mark.parametrize("source", ["*a " * 5000, "[" * 5000, "> " * 3000 + "x", "- " * 2000 + "x", "`" * 5000 + "x", "$a " * 5000, "a" * 200_000, "_*" * 4000, "<a " * 4000, "\n".join(["| a | b |", "|-|-|", *["| x | y |"] * 3000])])
def test_long_texts_end(source):
    assert render(source)[0]


def test_titles():
    assert parse("---\ntitle: ' '\nTitle: B\n---\n# C").title == "B"
    assert parse("---\ntitle: 5\n---\n# C").title == "C"
    assert parse("## x\n# \n# C *d*").title == "C d"
    assert parse("x", "a/b.c.md").title == "b.c"
    assert parse("# H^2^ $x$ b\nrest").toc == [(1, "H  b", "h--b")]


def test_highlight_escapes_and_keeps_all_text():
    import re

    html = render("```python\nif a < 'b' & c:  # <x>\n    pass\n```")[0]
    assert re.sub(r"<[^>]*>", "", html).strip() == "if a &lt; &#39;b&#39; &amp; c:  # &lt;x&gt;\n    pass"


def test_sanitize():
    dirty = '<p onclick="x()">a<script>alert(1)</script><a href="JaVaScript:x">b</a><img src="data:text/html,x" alt="c"><iframe src="x">d</iframe> &amp; &#39; <unknown>e</unknown></p>'
    assert sanitize(dirty) == '<p>a<a>b</a><img alt="c"> &amp; &#39; e</p>'
    page = render(PAGE, "docs/page.md")[0]
    assert "alert alert-note" in sanitize(page) and "<kbd>" in sanitize(page) and "<script" not in sanitize(page)

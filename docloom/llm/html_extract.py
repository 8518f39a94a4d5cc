"""Main text of HTML pages by a tree-structured graphical model.

Every DOM node and text run has a hidden state: boilerplate, content, or a container of both.
Potentials tie a child's state to its parent's, and each node shows evidence (its tag, the words of
its class and id, link density, length, punctuation). Sum-product messages upwards and downwards
give each node's marginals exactly; text runs whose content marginal is one half or more are the
main text. The potentials maximise the conditional likelihood of labelled pages, by default those of
page_templates: each step moves them from the counts the marginals expect towards those observed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import page_templates
from docloom.llm.common import small_batches, table
from docloom.llm.dom import Page, read

BOILERPLATE, CONTENT, MIXED = range(3)
# Tags and words of class, id and role with evidence of their own.
TAGS = "#root #text html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li a nav header footer aside form blockquote pre table tr td th figure figcaption dl dt dd b strong em i span label details summary dialog address menu search fieldset".split()
WORDS = (
    "nav menu navbar breadcrumb sidebar side aside ad ads advert advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "footer header masthead comment comments reply replies respond discussion disqus form login signup subscribe newsletter search share social related recommended more widget pagination pager toolbar "
    "copyright legal hidden byline meta tags author caption article post entry story content main body text page"
).split()
TAG_ID = {t: i for i, t in enumerate(TAGS)}
WORD_ID = {w: i + 1 for i, w in enumerate(WORDS)}
SPLIT = re.compile(r"[^a-z]+")
#: Sizes of the kinds of evidence: tag, first and second hint word, link density, length, punctuation, place among the page's article elements.
SIZES = (len(TAGS) + 1, len(WORDS) + 2, len(WORDS) + 2, 4, 6, 3, 5)
LENGTHS = np.array([1, 25, 80, 250, 1000])
#: Steps of training, their size, and the pull of every weight to 0.
STEPS, RATE, PULL = 150, 0.15, 1e-3


class Model(NamedTuple):
    step: np.ndarray  # log potential of a parent's state and its child's
    shown: tuple[np.ndarray, ...]  # for each kind of evidence, log potential by state and value


def evidence(page: Page) -> np.ndarray:
    """A row of evidence values for each node."""
    n = len(page.tags)
    parents = np.array(page.parents)
    size = np.array([len(t) for t in page.texts], np.int64)
    points = np.array([sum(map(t.count, ".,;:!?")) if t else 0 for t in page.texts], np.int64)
    linked = np.zeros(n, bool)
    for i, tag in enumerate(page.tags):
        linked[i] = tag == "a" or (i > 0 and linked[parents[i]])
    links = size * linked
    for i in range(n - 1, 0, -1):  # children follow their parents
        p = parents[i]
        size[p] += size[i]
        points[p] += points[i]
        links[p] += links[i]
    out = np.zeros((n, len(SIZES)), np.int64)
    out[:, 0] = [TAG_ID.get(t, len(TAGS)) for t in page.tags]
    for i, hint in enumerate(page.hints):
        if hint:
            found = sorted({WORD_ID[w] for w in SPLIT.split(hint) if w in WORD_ID}) or [len(WORDS) + 1]
            out[i, 1 : 1 + len(found[:2])] = found[:2]
    density = links / np.maximum(size, 1)
    out[:, 3] = np.digitize(density, [0.001, 0.3, 0.7])
    out[:, 4] = np.digitize(size, LENGTHS)
    out[:, 5] = np.digitize(points / np.maximum(size, 1), [0.001, 0.01])
    places = [i for i, t in enumerate(page.tags) if t == "article"]
    out[places, 6] = 3
    out[places[:1], 6] = 1 if len(places) == 1 else 2
    out[[i for i, t in enumerate(page.tags) if t == "main"], 6] = 4
    return out


def states(page: Page, marks: list[bool | None]) -> np.ndarray:
    """Known states from the marks: a node above all marks is a container if it holds content, else boilerplate."""
    out = np.array([BOILERPLATE if not m else CONTENT for m in marks])
    for i in range(len(marks) - 1, 0, -1):
        p = page.parents[i]
        if out[i] != BOILERPLATE and marks[p] is None:
            out[p] = MIXED
    return out


class Forest(NamedTuple):
    """Trees of several pages, with nodes by depth."""

    first: np.ndarray  # first node of each page, and the end
    parents: np.ndarray
    levels: list[np.ndarray]
    seen: np.ndarray


def forest(pages: list[Page]) -> Forest:
    first = np.cumsum([0, *(len(p.tags) for p in pages)])
    parents = np.concatenate([np.array(p.parents) + a for p, a in zip(pages, first, strict=False)])
    depth: list[int] = []
    for p, a in zip(pages, first, strict=False):
        depth.append(0)
        for parent in p.parents[1:]:
            depth.append(depth[a + parent] + 1)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.searchsorted(np.array(depth)[order], np.arange(1, max(depth) + 1)))
    return Forest(first, parents, levels, np.concatenate([evidence(p) for p in pages]))


def fit(pages: list[tuple[Page, list[bool | None]]]) -> Model:
    """The model of labelled pages; a mark tells of each node whether it is content, None above all marks."""
    trees = forest([page for page, _ in pages])
    state = np.concatenate([states(page, marks) for page, marks in pages])
    child = np.concatenate(trees.levels[1:])
    weights = [np.zeros((3, 3)), *(np.zeros((3, s)) for s in SIZES)]
    known = [np.zeros_like(w) for w in weights]
    np.add.at(known[0], (state[trees.parents[child]], state[child]), 1)
    for k in range(len(SIZES)):
        np.add.at(known[k + 1], (state, trees.seen[:, k]), 1)
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for turn in range(1, STEPS + 1):
        nodes, edges = marginals(Model(weights[0], tuple(weights[1:])), trees, with_edges=True)
        expected = [edges, *(np.stack([np.bincount(trees.seen[:, k], nodes[:, s], SIZES[k]) for s in range(3)]) for k in range(len(SIZES)))]
        for w, a, b, m, v in zip(weights, known, expected, mean, square, strict=True):
            slope = (a - b) / len(pages) - PULL * w
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            w += RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Model(weights[0], tuple(weights[1:]))


@cache
def default_model() -> Model:
    return fit(labelled_pages())


def labelled_pages(count: int = 900) -> list[tuple[Page, list[bool | None]]]:
    """The pages of page_templates, each node marked as its nearest marked element."""
    return [marked(html) for html in page_templates.pages(count)]


def marked(html: str) -> tuple[Page, list[bool | None]]:
    page = read(html)
    marks: list[bool | None] = []
    for i, hint in enumerate(page.hints):
        marks.append(True if "label-content" in hint else False if "label-other" in hint else marks[page.parents[i]] if i else None)
    return page._replace(hints=[h.replace("label-content", "").replace("label-other", "").strip() for h in page.hints]), marks


def scaled(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of logs as numbers of 1 at most, and the logs of their scales."""
    top = logs.max(axis=1, keepdims=True)
    return np.exp(logs - top), top


def marginals(model: Model, trees: Forest, with_edges: bool = False):
    """Probabilities of the states of every node, by messages up and then down, a depth at a time; with_edges also the expected counts of parent's and child's states."""
    own = sum(w.T[trees.seen[:, k]] for k, w in enumerate(model.shown))
    tie = np.exp(model.step)
    up, sent = own.copy(), np.zeros_like(own)
    for at in trees.levels[:0:-1]:
        below, scale = scaled(up[at])
        sent[at] = np.log(below @ tie.T) + scale
        np.add.at(up, trees.parents[at], sent[at])
    belief, edges = up.copy(), np.zeros((3, 3))
    for at in trees.levels[1:]:
        above, scale = scaled(belief[trees.parents[at]] - sent[at])
        belief[at] = up[at] + np.log(above @ tie) + scale
        if with_edges:
            below, _ = scaled(up[at])
            edges += tie * ((above / ((above @ tie) * below).sum(axis=1, keepdims=True)).T @ below)
    nodes, _ = scaled(belief)
    nodes /= nodes.sum(axis=1, keepdims=True)
    return (nodes, edges) if with_edges else nodes


def texts(model: Model, pages: list[Page]) -> list[str]:
    """Main text of each page: its content runs, joined by block."""
    if not pages:
        return []
    trees = forest(pages)
    content = marginals(model, trees)[:, CONTENT] >= 0.5
    out = []
    for p, a in zip(pages, trees.first, strict=False):
        blocks: dict[int, list[str]] = {}
        for i, tag in enumerate(p.tags):
            if tag == "#text" and content[a + i]:
                blocks.setdefault(p.blocks[i], []).append(p.texts[i])
        joined = (" ".join("".join(b).split()) for b in blocks.values())
        out.append("\n".join(b for b in joined if b))
    return out


#: Pages whose trees are solved together.
TOGETHER = 64


def extractor(model: Model):
    """Batches of (page_id, url, html) to (page_id, url, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                found = texts(model, [read(h or "") for h in part.column(2).to_pylist()])
                yield pa.record_batch([part.column(0), part.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text) for every row of pages(page_id, url, html).

    Within a block, white space is one space; blocks are joined by a line break, in page order. A
    null or empty page, or one without content, has empty text; plain text without markup is judged
    like any text run; repeated rows are answered each; other columns are ignored; an empty table
    gives no rows. The model is some kilobytes, whatever the number of pages.
    """
    small_batches(pages.sparkSession)
    model = model or default_model()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extractor(model), "page_id long, url string, text string")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

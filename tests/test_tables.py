"""Sources, derived tables, streams, and the entry point."""

from __future__ import annotations

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docloom.functions import expr as X
from docloom.functions import lines as L
from docloom.functions import sql
from docloom.operators import tables as T
from docloom.plans import catalog
from docloom.plans.synthetic import documents
from docloom.sources import files, sinks
from docloom.streaming import changes
from tests.test_markdown import PAGE

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def nodes(spark):
    docs = spark.createDataFrame([(1, "docs/a.md", PAGE), (2, "b.md", None), (3, None, ""), (4, "c.md", "text $x$ only")], "doc_id long, path string, md string")
    return T.parse_nodes(docs).cache()


def test_nodes_are_ordered_trees(nodes):
    rows = nodes.orderBy("doc_id", "pos").collect()
    for doc_id in (1, 2, 3, 4):
        own = [r for r in rows if r.doc_id == doc_id]
        assert [r.pos for r in own] == list(range(len(own)))
        assert own[0].parent == -1 and all(0 <= r.parent < r.pos for r in own[1:])


def test_tables(nodes):
    assert [r.id for r in T.headings(nodes).orderBy("pos").collect()] == ["a-first-heading", "listas", "tablas", "mi-ancla"]
    assert {r.doc_id: len(r.toc) for r in T.toc(nodes).collect()} == {1: 4, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.title for r in T.titles(nodes).collect()} == {1: "Trial · by fire", 2: "b", 3: "", 4: "c"}
    assert {r.role for r in T.code_blocks(nodes).collect()} == {"code", "diagram", "embed"}
    assert sorted((r.tex, r.display, r.is_block) for r in T.formulas(nodes).where("doc_id = 4").collect()) == [("x", False, False)]
    assert [tuple(r) for r in T.abbreviation_definitions(nodes).collect()] == [(1, "API", "Application Programming Interface")]
    assert T.abbreviation_uses(nodes).first().uses == 2
    assert T.alerts(nodes).count() == 5 and T.containers(nodes).count() == 5
    assert tuple(T.footnotes(nodes).first()) == (1, "1", 1, 1)
    assert tuple(T.tasks(nodes).first()) == (1, 1, 1)
    assert {r.href for r in T.autolinks(nodes).collect()} == {"https://example.org", "mailto:a@example.com"}
    assert T.front_matter(nodes).where("key = 'author'").first().value == "Ana"
    assert {(r.link_kind, r.path) for r in T.links(nodes).where("fragment <> ''").collect()} == {("doc", "docs/Tablas.md"), ("doc", "docs/other.md")}
    assert T.images(nodes).count() == 0
    assert T.find_in_text(nodes, " API ").first().hits == 2
    assert {r.kind for r in T.scripts(nodes).collect()} == {"sup", "sub", "mark", "ins", "del"}


def test_nodes_of_some_kinds(spark, nodes):
    docs = spark.createDataFrame([(1, "docs/a.md", PAGE), (2, "b.md", None), (4, "c.md", "text $x$ only")], "doc_id long, path string, md string")
    some = T.parse_nodes(docs, kinds=frozenset(("autolink", "heading", "math"))).collect()
    assert sorted(map(repr, some)) == sorted(map(repr, nodes.where("kind IN ('autolink', 'heading', 'math')").collect())) and len(some) > 5


def test_render_gives_error_rows(spark):
    docs = spark.createDataFrame([(1, "# A"), (2, None)], "doc_id long, md string")
    got = {r.doc_id: r for r in T.render_documents(docs).collect()}
    assert got[1].ok and got[1].html == '<h1 id="a">A</h1>\n' and got[1].toc[0].id == "a"
    assert not got[2].ok and got[2].error and got[2].toc == []


def test_expressions(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert one(X.word_count(F.lit("a b c　d\u0085e")))[0] == 5 and one(X.word_count(F.lit(None)))[0] == 0
    cleaned = [one(X.clean_path(F.lit(p)))[0] for p in ("a/../../b", "/a/../../b", "./a//b/.", "a/..", "../../x")]
    assert cleaned == ["../b", "/b", "a/b", ".", "../../x"]
    assert one(X.html_escape(F.lit("&<>'\"")))[0] == "&amp;&lt;&gt;&#39;&#34;"
    assert one(X.capitalize(F.lit("élan")))[0] == "Élan"
    assert one(X.query_escape(F.lit("a+b~*é/\\:x y")))[0] == "a%2Bb~%2A%C3%A9%2F%5C%3Ax+y"
    assert tuple(one(X.container_info(F.lit("{.a b #x #y}")))[0]) == (None, None, "a b", "y")
    assert tuple(one(X.container_info(F.lit("Tip  My title ")))[0])[:2] == ("tip", "My title")
    assert one(X.wrapped_step(F.lit(0), -1, F.lit(3)))[0] == 2 and one(X.wrapped_step(F.lit(0), 1, F.lit(0)))[0] is None
    p = one(X.preferences(F.lit('{"rscale":-1,"tocWidth":5000,"window":{"w":10,"h":10}}')))[0]
    assert (p["scale"], p.toc_open, p.toc_width, p.window) == (1.0, True, 1200, None)


def test_lines_ignore_fenced_headings(spark):
    docs = spark.createDataFrame([(1, "# a\n```\n# b\n```\n## c ##\n~~~\n# d"), (2, None), (3, "")], "doc_id long, md string")
    assert [tuple(r) for r in L.headings(L.split_lines(docs)).orderBy("line_no").collect()] == [(1, 0, 1, "a"), (1, 4, 2, "c")]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "sub" / "B.MARKDOWN").write_text("x" * 100)
    (tmp_path / "c.txt").write_text("no")
    got = {os.path.basename(r.path): r for r in files.read_files(spark, str(tmp_path), max_bytes=50).collect()}
    assert set(got) == {"a.md", "B.MARKDOWN"}
    assert got["a.md"].md == "# A" and got["a.md"].error is None and got["a.md"].mtime_ms > 0
    assert got["B.MARKDOWN"].md is None and got["B.MARKDOWN"].error
    raw = files.from_text(spark.createDataFrame([(" ", "x"), ("n.md", None), ("m.md", "y" * 20)], "name string, md string"), "name", "md", 10)
    assert [tuple(r)[:2] for r in raw.collect()] == [("document.md", "x"), ("n.md", ""), ("m.md", None)]
    images = spark.createDataFrame([(str(tmp_path / "c.txt"),), ("/nowhere",)], "file string")
    assert sorted((r.length or 0) for r in files.read_assets(spark, images, str(tmp_path)).collect()) == [0, 2]
    sinks.write_json(raw, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert '"md":null' in sinks.as_json(raw).collect()[2].json
    sinks.write_rendered(raw, str(tmp_path / "rendered"))
    assert spark.read.parquet(str(tmp_path / "rendered")).count() == 3


def test_preferences_file(tmp_path):
    path = str(tmp_path / "p.json")
    assert sinks.write_preferences(path, {"tocWidth": 9999, "rscale": -2, "window": {"w": 300, "h": 200}}) == {"rscale": 1.0, "tocOpen": True, "tocWidth": 1200, "window": {"w": 300, "h": 200}}
    assert os.listdir(tmp_path) == ["p.json"]


def test_sql(spark):
    sql.register(spark)
    rows = spark.sql("SELECT p.kind, p.text FROM VALUES ('# A *b*'), (null) AS d(md), LATERAL parse_markdown(d.md) p WHERE p.kind IN ('heading', 'em')").collect()
    assert sorted(map(tuple, rows)) == [("em", "b"), ("heading", "A b")]
    assert spark.sql("SELECT markdown_title('# T'), sanitize_html(render_markdown('x <script>y</script> [a](javascript:z)'))").first()[0] == "T"
    sql.views(spark.createDataFrame([(1, "# A\n\n[x](y.md)")], "doc_id long, md string"))
    assert spark.sql("SELECT h.text, l.path FROM headings h JOIN links l USING (doc_id)").first() == ("A", "y.md")


def test_change_feed_gives_later_edits_only(tmp_path):
    name = tmp_path / "a.md"
    name.write_text("1")
    reader = changes.ChangeReader(str(tmp_path))
    start = reader.initialOffset()
    rows, same = reader.read(start)
    assert list(rows) == []
    for text in ("2", "3"):
        name.write_text(text)
    os.utime(name, ns=(time.time_ns(), time.time_ns() + 10_000_000))
    rows, end = reader.read(same)
    assert [r[0] for r in rows] == [str(name)]
    assert [r[0] for r in reader.readBetweenOffsets(start, end)] == [str(name)]
    name.unlink()
    assert list(reader.read(end)[0]) == []


def test_stream_renders_again_what_a_batch_renders(spark, tmp_path):
    docs, done = tmp_path / "docs", []
    docs.mkdir()
    (docs / "a.md").write_text("# one")
    (docs / "b.md").write_text("# still")
    (docs / "gone.md").write_text("# gone")
    query = changes.rerender(changes.watch(spark, str(docs)), lambda df, n: done.extend(df.collect()), str(tmp_path / "checkpoint"))
    try:
        limit = time.time() + 60
        n = 0
        while not done and time.time() < limit:
            n += 1
            (docs / "a[1]{x}.md").write_text(f"# two {n}")
            (docs / "gone.md").unlink(missing_ok=True)
            time.sleep(1.5)
    finally:
        query.stop()
    assert done and {r.title.split()[0] for r in done} == {"two"} and all(r.path.endswith("a[1]{x}.md") for r in done)


def test_open_events(spark):
    events = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, None), ("u", 4, "b"), ("v", 1, "c")], "who string, seq long, path string")
    assert sorted((r.who, r.path) for r in changes.latest(events, ["who"]).collect()) == [("u", "b"), ("v", "c")]
    assert [r.seq for r in changes.without_repeats(events, "who").where("who = 'u'").orderBy("seq").collect()] == [1, 3, 4]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_whole_queries_answer_every_line(spark):
    from docloom.plans import outline

    texts = {1: "intro\n# A #\nx^2^ y\n```\n# no ==m==\n```\n## B\nH~2~O and ==m== ++i++", 2: "no heading", 3: "\n# C"}
    lines = outline.L.split_lines(spark.createDataFrame(list(texts.items()), "doc_id long, md string"))
    got = {(r.doc_id, r.line_no): r.section for r in outline.sections_of_lines(lines).collect()}
    assert got == {**{(1, i): "A" for i in range(6)}, (1, 6): "B", (1, 7): "B", (2, 0): None, (3, 0): "C", (3, 1): "C"}
    assert sorted(tuple(r) for r in outline._marked(lines, **outline.SCRIPTS).collect()) == [(1, 2, "2", ""), (1, 7, "", "2")]
    assert sorted(tuple(r) for r in outline._marked(lines, **outline.MARKS).collect()) == [(1, 7, "m", "i")]
    assert catalog.queries()["active_section"](spark, SF).count() == outline._lines(spark, SF).count()


def test_addresses_in_formulas_code_and_html(spark, tmp_path):
    texts = {
        1: "Enèpa### ètreon$$$ est&&& enpa.68@mail7.example.com### rean$$$ a@b.org",
        2: "`in.code@b.org`\n\n    indented@b.org\n\n```\nfenced@b.org\n```\n\n<p title='raw@b.org'>\n\n^up@b.org^ [x](mailto:link@b.org)",
        3: "$$\nblock@b.org\n$$\n\nfirst.middle.last+tag@b.org, and again first.middle.last+tag@b.org $a@b.org$ a@b.org",
        4: "éab.c@b.org a@b.org_c@d.org ..x@b.org.. @b.org a@b a@b@c.org -@b.org",
        5: "",
        6: None,
    }
    rows = [(i, t, "en", "web" if i % 2 else None) for i, t in texts.items()] + [(1, texts[3], None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.connect().execute(catalog.oracle_sql()["parsed_autolinks"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in catalog.queries()["parsed_autolinks"](spark, str(tmp_path)).select("doc_id", "href", "shown").collect()]
    assert sorted(got) == sorted(want) and len(want) == 7 + 2 + 6 + 5 + 5 + 5
    alone = T.autolinks(T.parse_nodes(spark.createDataFrame(list(texts.items()), "doc_id long, md string")))
    assert sorted((r.doc_id, r.shown) for r in alone.where("doc_id <= 2").collect()) == [(1, "a@b.org")]


def test_autolinks_keep_what_the_sql_does_not_list(spark, tmp_path):
    text = "https://a.org/x and www.b.org, <tel:1> <a!b@c.org> https://u@d.org/ `e@f.org`"
    spark.createDataFrame([(7, text, "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(r.shown for r in catalog.queries()["parsed_autolinks"](spark, str(tmp_path)).collect())
    assert got == sorted(["https://example.org/7", "https://a.org/x", "www.b.org", "tel:1", "a!b@c.org", "https://u@d.org/", "b@c.org", "u@d.org", "e@f.org"])


def test_parser_alone_links_the_addresses_of_the_test_texts(spark, duck):
    want = duck.execute(catalog.oracle_sql()["parsed_autolinks"]).fetchall()
    alone = T.autolinks(T.parse_nodes(documents(spark, SF))).select("doc_id", "href", "shown")
    assert sorted(map(tuple, alone.collect())) == sorted(want)


def test_addresses_of_long_texts(spark):
    texts = ["a" * 1_000_000, "a." * 500_000, "a@" * 500_000, "x@" + "a." * 500_000 + "b", "._" * 500_000 + "a@b.org"]
    found = T.addresses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, md string")).collect()
    assert sorted((r.doc_id, r.shown) for r in found) == [(3, texts[3]), (4, "a@b.org")]


def test_files_that_are_not_utf8_or_too_large(spark, tmp_path):
    for name, data in (("good.md", "# é".encode()), ("bad.md", b"# caf\xe9 \xff\n"), ("large.md", b"x" * 5000)):
        (tmp_path / name).write_bytes(data)
    rows = files.read_files(spark, str(tmp_path), max_bytes=1000).selectExpr("xxhash64(path) AS doc_id", "path", "md", "error")
    got = {r.path.rsplit("/", 1)[1]: (r.md, r.error) for r in rows.collect()}
    assert got == {"good.md": ("# é", None), "bad.md": ("# caf\ufffd \ufffd\n", None), "large.md": (None, "larger than 1000 bytes")}
    assert {r.text for r in T.headings(T.parse_nodes(rows.where("error IS NULL"))).collect()} == {"é", "caf\ufffd \ufffd"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Hand cases of the semantics that the test tables can't show."""

from __future__ import annotations

import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions import text as X
from tessera.operators import chunking, cluster, dedup, diff, layout, search, tabular, tokens, views
from tessera.operators import entities as E
from tessera.operators.graph import connected_components
from tessera.operators.sqlfacade import Database, Refused, quote
from tessera.sources import html, markdown, nodes, plain, serialize


def values(spark, items, kind="string"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, v {kind}")


def column(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_normalize_text(spark):
    df = values(spark, ["A  B", "ﬁne", "ＡＢＣ", "  x \n y ", None])
    assert column(df, N.normalize_text(F.col("v"))) == ["a b", "fine", "abc", "x y", None]
    assert column(values(spark, ["Hi, there!"]), N.normalize_text(F.col("v"), drop_punctuation=True)) == ["hi there"]


def test_normalize_entity(spark):
    df = values(spark, ["Orion Group Ltd.", "Rivera SA de CV", "Global Partners", "Acme Corp., Inc.", "K.K.", "Plain"])
    assert column(df, N.normalize_entity(F.col("v"))) == ["orion", "rivera", "global partners", "acme", "k.k.", "plain"]


def test_normalize_date(spark):
    df = values(spark, ["03/04/2024", "2024-05-06T07:08:09", "Soon", "5 March 2020", "Mar 5, 2020", "2024-01-02", "13/45/2024"])
    assert column(df, N.normalize_date(F.col("v"))) == ["2024-03-04", "2024-05-06T07:08:09", "soon", "2020-03-05", "2020-03-05", "2024-01-02", "13/45/2024"]


def test_normalize_number(spark):
    df = values(spark, ["$1,000.50", "USD 20", "1E+6", "n/a", "13.500", "-0", "€ 7"])
    assert column(df, N.normalize_number(F.col("v"))) == ["1000.5", "20", "1000000", "n/a", "13.5", "0", "7"]


def test_coerce_value(spark):
    df = values(spark, ["$1,234", "12.5%", "€3.50", "1,2,3", " ", "abc", "1_000", "nan", "7%x"])
    got = column(df, N.coerce_value(F.col("v")))
    assert [(r.kind, r.value) for r in got] == [("integer", "1234"), ("float", "0.125"), ("float", "3.5"), ("integer", "123"), ("null", None), ("text", "abc"), ("integer", "1000"), ("float", "NaN"), ("text", "7%x")]


def test_safe_and_joined_urls(spark):
    df = values(spark, ["javascript:x", " JaVa\tScript:x", "java&#x0a;script:x", "javascript%3Ax", "data:a", "https://ok/", "/rel"])
    assert column(df, X.safe_url(F.col("v"))) == ["#"] * 5 + ["https://ok/", "/rel"]
    df = values(spark, ["/a", "b", "//c/d", "https://e/", "../f"])
    assert column(df, X.resolve_url(F.col("v"), F.lit("https://h.example/x/y"))) == ["https://h.example/a", "https://h.example/x/b", "//c/d", "https://e/", "https://h.example/f"]


def test_xbrl(spark):
    df = values(spark, ["<?xml version='1.0'?><html xmlns:ix=\"u\"><ix:header>h</ix:header><div style=\"display:none\">z</div><ix:nonNumeric a='1'>42</ix:nonNumeric></html>"])
    assert column(df, X.strip_inline_xbrl(F.col("v"))) == ["<html>42</html>"] and column(df, X.looks_like_xbrl(F.col("v"))) == [True]


def test_sentences():
    t = "Mr. Fox ran. It rained!  \"Why?\" He left at 5 p.m. today.\nNew line"
    assert [t[a:b] for a, b in X.sentence_spans(t)][:3] == ["Mr. Fox ran.", "It rained!", '"Why?"']
    assert X.sentence_spans("") == [] and X.sentence_spans("  ") == []


@given(st.text(max_size=200))
@settings(max_examples=100, deadline=None)
def test_sentences_cover_all_but_white_space(t):
    spans = X.sentence_spans(t)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert "".join("".join(t[a:b] for a, b in spans).split()) == "".join(t.split())


def test_types_and_stats(spark):
    rows = [(k, v, i) for i, (k, v) in enumerate([("a", "1"), ("a", "2.5"), ("b", "x"), ("b", "1"), ("c", None), ("d", "4")])]
    c = N.coerce_value(F.col("v"))
    df = spark.createDataFrame(rows, "k string, v string, i int").select("k", c["kind"].alias("kind"), c["value"].alias("value"))
    assert dict(tabular.infer_types(df, "k").collect()) == {"a": "FLOAT", "b": "TEXT", "c": "NULL", "d": "INTEGER"}
    w = lambda *t: spark.range(1).select(tabular.widen(F.array(*map(F.lit, t)))).first()[0]
    assert [w("INTEGER", "DECIMAL"), w("FLOAT", "DECIMAL"), w("DATE", "DATETIME"), w("BOOLEAN", "INTEGER"), w("NULL", "NULL")] == ["DECIMAL", "FLOAT", "DATETIME", "TEXT", "NULL"]
    s = tabular.column_stats(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")).first()
    assert (s.nulls, s.filled, s.min_value, s.max_value, s.distinct_values) == (1, 3, "1.0", "3.0", 3)


def test_validate_and_pivot(spark):
    rows = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "b", "c"])], "row_ord int, cells array<string>")
    assert tabular.validate(rows, ["a", "a"], declared=1).count() == 3
    cells = spark.createDataFrame([("d1", "x", "1", None, 0), ("d1", "x", "1", "2", 1), ("d2", "y", "3", None, 2)], "doc_id string, column_id string, ai_value string, reviewed_value string, ord long")
    got = {r.doc_id: (r.x, r.y) for r in tabular.from_cells(cells, ["x", "y"]).collect()}
    assert got == {"d1": ("2", None), "d2": (None, "3")}
    t = spark.createDataFrame([(0, "Red"), (1, "Redwood"), (2, None)], "k int, c string")
    assert [(r.row_key, r.score) for r in tabular.search_tabular(t, "t", "red", "k", ["c"]).orderBy("row_key").collect()] == [(0, 2.0), (1, 1.0)]


@pytest.mark.parametrize("bad", ["DROP TABLE t", "SET a=1", "SELECT * FROM parquet.`/etc`", "SELECT * FROM other", "ADD JAR x", "CREATE TABLE q AS SELECT 1", "SELECT java_method('java.lang.System','exit')", "", "INSERT INTO t SELECT 1", "SELECT * FROM t WHERE k IN (SELECT k FROM secret)", "SELECT (SELECT max(k) FROM secret)", "WITH a AS (SELECT * FROM secret) SELECT * FROM a", "SELECT * FROM t; DROP TABLE t"])
def test_refused_sql(spark, bad):
    db = Database(spark)
    db.register("t", spark.range(3).toDF("k"))
    with pytest.raises(Refused):
        db.query(bad)


def test_sql_facade(spark):
    db = Database(spark)
    db.register("t", spark.range(12_000).toDF("copy_count"))
    db.register("odd name", spark.range(2), prefix="p`q")
    assert db.query("SELECT max(copy_count) m FROM t").first().m == 11_999
    df, more = db.execute("SELECT * FROM t ORDER BY copy_count DESC", max_rows=20_000)
    assert df.count() == 10_000 and more and df.first()[0] == 11_999
    assert [r.name for r in db.list_tables().collect()] == ["p`q_odd name", "t"]
    assert db.describe_table("t")["row_count"] == 12_000 and quote("a`b") == "`a``b`"
    assert db.query("WITH x AS (SELECT * FROM t WHERE copy_count < 3) SELECT count(*) n FROM x WHERE EXISTS (SELECT 1 FROM t)").first().n == 3


def test_plain_text(spark):
    got = plain.paragraphs(values(spark, ["a\n\n \n\n b \nc"]).withColumnsRenamed({"i": "doc_id", "v": "text"})).collect()
    assert [r.text for r in got] == ["a", "b \nc"]


def kinds(ns):
    return [n.type for n in ns]


def test_html_tree():
    t = html.parse_html("<title>T</title><p>A</p><nav>x</nav><p>B<b>c</b></p><p>Brand</p><p>®</p><div class='sr-only'>no</div><h2>H</h2><hr>loose <i>text</i>")
    assert t.meta == {"title": "T"} and [n.text() for n in t.body] == ["A", "Bc", "Brand®", "H", "", "loose text"]
    t = html.parse_html("<table><caption>C</caption><thead><tr><th>a<th>b</thead><tr><td colspan=2>1</table>")
    assert t.body[0].attrs == {"caption": "C"} and [s.attrs["section"] for s in t.body[0].children] == ["head", "body"]
    assert t.body[0].children[1].children[0].children[0].attrs == {"colspan": "2"}
    p = html.parse_html("<p><a href='javascript:x'>l</a><img src='data:x'><a href='/vote?x'>up</a><a href='q'>r</a></p>", base="https://h.example/d/").body[0]
    assert kinds(p.children) == ["span", "link"] and p.children[1].attrs["url"] == "https://h.example/d/q"
    assert kinds(html.parse_html("<pre>a\n\nb</pre>", pre="prose").body) == ["paragraph", "paragraph"]
    assert kinds(html.parse_html("<ul><li>a<ul><li>b</ul><li>c</ul><dl><dt>t<dd>d</dl><blockquote>q</blockquote>").body) == ["bullet_list", "definition_list", "blockquote"]


@given(st.text(alphabet="<>/abpultdr &;=\"'!-\n", max_size=120))
@settings(max_examples=200, deadline=None)
def test_parsers_never_fail(t):
    html.parse_html(t)
    markdown.parse_markdown(t)


def test_markdown_tree():
    t = markdown.parse_markdown("---\ntitle: X\nauthor: Y\n---\n# H *w*\n\np **b** `c`\n\n- a\n- [x] b\n  - c\n\n1. one\n2. two\n\n> [!NOTE] t\n> hi\n\n| a | b |\n|---|:-:|\n| 1 | 2\\|3 |\n\n```py\nx\n```\n\nT\n: D\n\n$$\ny\n$$\n\nS\n===\n\n<div>raw</div>\n\n---\n\nq[^1]\n\n[^1]: note\n")
    assert t.meta == {"title": "X", "authors": "Y"} and list(t.footnotes) == ["1"]
    assert kinds(t.body) == ["heading", "paragraph", "bullet_list", "ordered_list", "admonition", "table", "codeblock", "definition_list", "math_block", "heading", "raw_block", "thematic_break", "paragraph"]
    assert t.body[2].children[1].attrs == {"checked": "true"} and t.body[5].children[1].children[0].children[1].text() == "2|3"
    i = markdown.inlines("a *b* __c__ ~~d~~ ![e](f) <http://g> \\*h\\* x<sup>2</sup> $y$ z  \nw")
    assert kinds(i) == ["text", "emphasis", "text", "strong", "text", "strikethrough", "text", "image", "text", "link", "text", "superscript", "text", "math", "text", "line_break", "text"]


def test_node_tables(spark):
    df = values(spark, ["<h1 class='t'>A</h1><p>b <a href='/u'>c</a><br>d</p><table><tr><td>e</td></tr></table>", None]).withColumnsRenamed({"i": "doc_id", "v": "html"})
    n = nodes.parse(df, html.parse_html, "doc_id", "html").cache()
    b = nodes.block_table(n).orderBy("body_index").collect()
    assert [(r.node_type, r.text) for r in b] == [("heading", "A"), ("paragraph", "b c\nd"), ("table", "e")]
    assert nodes.find_by_type(n, "link").first().attrs == {"url": "/u"} and nodes.find_first(n, F.col("kind") == "block").first().ref == "#/body/0"
    assert [r.ref for r in nodes.subtree(n, "#/body/1").orderBy("path").collect()][:2] == ["#/body/1", "#/body/1/children/0"]
    other = nodes.parse(df.withColumn("html", F.replace("html", F.lit("<h1 class='t'>"), F.lit("<h1>"))), html.parse_html, "doc_id", "html")
    assert nodes.content_hash(n).first() == nodes.content_hash(other).first()
    marks = spark.createDataFrame([(0, "a", "#/body/0", 3, 7), (0, "b", "#/body/0", None, None), (0, "c", "#/gone", 0, 1)], "doc_id long, ann_id string, node_ref string, start int, end int")
    points = spark.createDataFrame([(0, "#/body/0", 3), (0, "#/body/0", 7)], "doc_id long, node_ref string, offset int")
    assert sorted((r.ann_id, r.offset) for r in nodes.annotations_at(marks, points).collect()) == [("a", 3), ("b", 3), ("b", 7)]
    assert [r.ann_id for r in nodes.dangling(marks, n).collect()] == ["c"]


def test_serialisers(spark):
    empty = F.create_map().cast("map<string,string>")
    b = spark.createDataFrame([(1, 0, "heading", 2, "A *b*"), (1, 1, "paragraph", None, "<x> & # y\n# z"), (1, 2, "codeblock", None, "a ``` b"), (1, 3, "raw_block", None, "<script>")], "doc_id long, body_index int, node_type string, heading_depth int, text string").withColumn("attrs", empty).withColumn("page", F.lit(3))
    assert serialize.document(b, "markdown").first().markdown == "## A \\*b\\*\n\n\\<x> & # y\n\\# z\n\n````\na ``` b\n````\n"
    h = serialize.document(b, "html").first().html
    assert '<h2 data-page="3">A *b*</h2>' in h and "&lt;x&gt; &amp;" in h and "script" not in h
    marks = spark.createDataFrame([(1, 0, 2, 5), (1, 1, None, None)], "doc_id long, body_index int, start int, end int")
    got = {r.body_index: r.text for r in serialize.redact(b, marks).collect()}
    assert got[0] == "A [REDACTED]" and got[1] == "[REDACTED]" and got[2] == "a ``` b"
    t = spark.createDataFrame([(1, 'a,"b"', True, bytearray(b"\x01\xff"))], "k int, s string, f boolean, x binary")
    assert t.select(serialize.csv_line(t.dtypes)).first()[0] == '1,"a,""b""",true,01ff'
    assert "*3 more rows*" in serialize.markdown_table(spark.range(5), "id", max_rows=2).first().markdown


def blocks(spark, spec):
    rows = [(1, i, "heading" if d else "paragraph", d or None, f"t{i}", p) for i, (d, p) in enumerate(spec)]
    return spark.createDataFrame(rows, "doc_id long, body_index int, node_type string, heading_depth int, text string, page int")


def test_sections_and_pages(spark):
    b = blocks(spark, [(1, None), (0, 2), (2, None), (0, 3), (2, None), (0, None), (1, None)])
    s = {r.start: (r.depth, r.parent, r.direct_end, r.end) for r in views.sections(b).collect()}
    assert s == {0: (1, None, 2, 6), 2: (2, 0, 4, 4), 4: (2, 0, 6, 6), 6: (1, None, 7, 7)}
    p = {r.body_index: r.path for r in views.heading_path(b).collect()}
    assert p[3] == ["t0", "t2"] and p[5] == ["t0", "t4"] and p[6] == ["t6"]
    assert [r.page for r in views.pages(b).orderBy("body_index").collect()] == [1, 2, 2, 3, 3, 3, 3]
    assert {r.start: (r.first_page, r.last_page) for r in views.section_pages(b).collect()}[0] == (1, 3)
    pre = views.sections(blocks(spark, [(0, None), (3, None), (1, None)])).collect()
    assert {(r.start, r.depth) for r in pre} == {(0, 0), (1, 3), (2, 1)}
    assert [(r.depth, r.end) for r in views.sections(blocks(spark, [(0, None), (0, None)])).collect()] == [(0, 2)]
    assert [r.body_index for r in views.heading_proximate(b).orderBy("body_index").collect()] == [1, 3, 5]
    t = spark.createDataFrame([(1, 3)], "doc_id long, target int")
    assert [r.body_index for r in views.context_window(b, t, 2, 2).orderBy("body_index").collect()] == [1, 2, 3, 4, 5]
    assert [r.body_index for r in views.context_window(b, t, 2, 2, clamp=True).orderBy("body_index").collect()] == [2, 3]


def test_ngrams_and_head(spark):
    b = blocks(spark, [(0, None)]).withColumn("text", F.lit("The cap on the cap"))
    assert {r.ngram: r.n for r in tokens.top_ngrams(tokens.whole(b)).collect()} == {"cap": 2, "cap cap": 1}
    assert [(r.ngram, r.n, r.rank) for r in tokens.bottom_ngrams(tokens.whole(b)).collect()] == [("cap", 2, 1)]
    # no window spans two blocks
    two = tokens.top_ngrams(spark.createDataFrame([(1, ["red fox", "fox red", None]), (2, None)], "doc_id long, blocks array<string>"))
    assert [(r.ngram, r.n) for r in two.orderBy("rank").collect()] == [("fox", 2), ("red", 2), ("fox red", 1), ("red fox", 1)]
    assert column(values(spark, ["One, two three. Four"]), tokens.head("v", 2)) == ["One, two"]


def test_entities_and_salience(spark):
    df = values(spark, ["Paid $5,000 and 12.5% on March 3, 2021 within thirty (30) days of 2020-01-02"])
    counts = {k: column(df, F.size(E.values_expr(F.col("v"), k)))[0] for k in E.TYPES}
    assert counts["money"] == 1 and counts["percent"] == 1 and counts["date"] == 2 and counts["duration"] == 1
    s = lambda text, n, i, total, near: spark.range(1).select(E.salience(F.lit(text), F.lit(n), F.lit(i), F.lit(total), F.lit(near))).first()[0]
    assert s("x" * 100, 1, 5, 10, False) == pytest.approx(0.45) and s("x" * 30, 3, 0, 1, False) == pytest.approx(0.9) and s("x" * 400, 3, 0, 1, False) == pytest.approx(0.8)
    text = "é paid 7 and 12"
    df = values(spark, [text])
    assert [(m.start, m.end) for m in column(df, E.matches("number")("v"))[0]] == [(7, 8), (13, 15)]


def test_search(spark):
    p = spark.createDataFrame([(1, 0, "cat catalog cat"), (1, 1, "dog house"), (2, 0, "house cat")], "doc_id long, row int, text string")
    assert {(r.doc_id, r.row): r.score for r in search.term_frequency(p, "cat").collect()} == {(1, 0): 3.0, (2, 0): 1.0}
    assert {(r.doc_id, r.row): r.score for r in search.term_frequency(p, "dog is house").collect()} == {(1, 1): 2.0, (2, 0): 1.0}
    with pytest.raises(ValueError):
        search.bm25(p, "  ")
    one, many = search.bm25(p, "cat"), search.bm25(p, "cat", per_document=True)
    assert one.count() == 2 and one.orderBy("doc_id").first().score != many.orderBy("doc_id").first().score
    top = search.top(one, 1, "doc_id").collect()
    assert len(top) == 1 and top[0].total_matches == 2
    post = search.postings(p.withColumn("row", F.col("doc_id") * 10 + F.col("row")))
    sizes = spark.createDataFrame([(3, 7 / 3)], "N long, avg double")
    q = spark.createDataFrame([(7, "cat")], "qid int, text string")
    a = sorted(round(r.score, 9) for r in search.bm25_indexed(post, sizes, q).collect())
    assert a == sorted(round(r.score, 9) for r in one.collect())


def test_components_against_union_find(spark):
    rng = random.Random(1)
    e = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)]
    root = {x: x for p in e for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {x: find(x) for p in e if p[0] != p[1] for x in p}


def test_dedup_levels(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(0, "Hello  World"), (1, "hello world"), (2, "Hello world!"), (3, base), (4, base + " tail"), (5, None), (6, " "), (7, "short text"), (8, base.replace("w30 ", "x "))]
    d = spark.createDataFrame(rows, "ord long, text string").withColumn("content", F.encode("text", "utf-8"))
    c = dedup.text_hash(d)
    assert sorted((r.canonical, r.member) for r in c.collect()) == [(0, 0), (0, 1)]
    r = dedup.report(dedup.run(d.where("ord < 3"), dedup.FAST), d.where("ord < 3")).first()
    assert (r.clusters, r.unique, r.rate) == (1, 2, round(1 / 3, 6))
    assert {r.member for r in dedup.minhash(d).collect()} == {3, 4, 8}
    got = dedup.run(d, dedup.STANDARD)
    assert {(r.level, r.member) for r in got.collect()} == {("text", 0), ("text", 1), ("minhash", 3), ("minhash", 4), ("minhash", 8)}
    assert {r.canonical for r in dedup.recanonicalize(got, d, "longest").where("level = 'minhash'").collect()} == {4}
    assert dedup.binary_hash(d.union(d.withColumn("ord", F.col("ord") + 10)), "md5").count() == 16
    assert dedup.binary_hash(d, "blake2b").count() == 0


def test_vector_levels(spark):
    v = [(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for i, a in enumerate((0, 25, 50, 180))]
    df = spark.createDataFrame(v, "id long, v array<double>")
    assert sorted(r.member for r in dedup.semantic_graph(df, 0.85).collect()) == [0, 1, 2]
    assert sorted(r.member for r in dedup.semantic(df, 0.1).collect()) == [0, 1]
    assert dedup.average_linkage(np.array([x for _, x in v]), 0.3)[3] == 3
    px = [(0, list(range(64))), (1, [*range(63), 0]), (2, list(range(64, 0, -1)))]
    h = spark.createDataFrame(px, "id long, p array<int>").select("id", dedup.average_hash(F.col("p")).alias("h"))
    assert [(r.a, r.b, r.distance) for r in dedup.hamming_pairs(h, 5).collect()] == [(0, 1, 2)]  # the mean moves past a second pixel
    grey = spark.createDataFrame([(0, [i % 9 for i in range(72)]), (1, [8 - i % 9 for i in range(72)])], "id int, p array<int>")
    assert [r[0] for r in grey.orderBy("id").select(dedup.difference_hash(F.col("p"))).collect()] == [0, -1]


def test_cluster_labels(spark):
    t = spark.createDataFrame([(0, 0, "solar panel energy grid"), (1, 0, "solar energy storage"), (2, 0, "wind energy solar"), (3, 1, "pasta sauce recipe"), (4, 1, "tomato pasta sauce"), (5, 1, "pasta basil")], "ord long, cluster_id long, text string")
    for d in (0.0, 0.4):
        got = cluster.label_clusters(t, 2, diversity=d).collect()
        a, b = ({r.term for r in got if r.cluster_id == c} for c in (0, 1))
        assert len(a) == len(b) == 2 and not a & b
    assert {r.cluster_id: r["size"] for r in cluster.exemplars(t).collect()} == {0: 3, 1: 3}


def test_chunks_by_tokens_and_outline(spark):
    b = spark.createDataFrame([(1, i, "paragraph", None, "one two three. Four five six. Seven eight nine.") for i in range(3)] + [(1, 3, "codeblock", None, "x " * 30)], "doc_id long, body_index int, node_type string, heading_depth int, text string")
    got = chunking.chunk(b, most=0, max_tokens=6).orderBy("piece").collect()
    assert [len(r.text.split()) for r in got] == [6, 3, 6, 3, 6, 33]  # code joins the chunk before it
    assert chunking.chunk(b, most=0).count() == 1 and chunking.chunk(b, most=0, max_tokens=100).count() == 1
    assert chunking.chunk(b, most=0, max_tokens=6, count=lambda t: 1).count() == 1
    lines = spark.createDataFrame([(1, 0, "INTRODUCTION"), (1, 1, "text one."), (1, 2, "1.2 Scope"), (1, 3, "text two.")], "doc_id long, body_index int, text string")
    got = chunking.from_outline(lines).orderBy("section").collect()
    assert [(r.first_block, r.last_block, r.breadcrumb) for r in got] == [(0, 1, "INTRODUCTION"), (2, 3, "INTRODUCTION > 1.2 Scope")]


def test_chunk_packing():
    p, c = (0, "paragraph", "x" * 6), (1, "codeblock", "y" * 8)
    assert chunking.pack([p, c, (2, "paragraph", "zz")], 10) == [[p, c], [(2, "paragraph", "zz")]]
    long = ". ".join("Sentence number " + str(i) for i in range(20)) + "."
    parts = chunking.pack([(0, "heading", "H"), (1, "paragraph", long), (2, "paragraph", "end")], 120)
    assert all(sum(len(t) for _, _, t in x) <= 121 for x in parts) and " ".join(t for x in parts for _, k, t in x if k != "heading").replace(" end", "") == long
    a = [(i, "paragraph", "p" * 5) for i in range(4)]
    assert [len(x) for x in chunking.pack(a, 11, overlap=1)] == [2, 2, 2]


@given(st.lists(st.text(alphabet="ab c.\n", max_size=12), max_size=6), st.lists(st.text(alphabet="ab c.\n", max_size=12), max_size=6))
@settings(max_examples=200, deadline=None)
def test_taking_all_changes_gives_the_revision(orig, rev):
    rows = diff.compare_blocks(orig, rev)

    def read(stays):
        out = {}
        for block, _, change, _, text in rows:
            if change in stays:
                out[block] = out.get(block, "") + text
        return list(out.values())

    norm = lambda xs: [" ".join(x.split()) for x in xs]
    assert read(diff._STAYS["accept"]) == rev
    assert norm(read(diff._STAYS["reject"])) == norm(orig)


def test_moves_and_times(spark):
    a, b, c = "the first long paragraph of text here", "something else entirely different", "third block closes the document"
    rows = diff.compare_blocks([a, b, c], [b, c, a])
    assert sorted(r[2] for r in rows) == ["keep", "keep", "move_from", "move_to"] and len({r[3] for r in rows if r[3]}) == 1
    pieces = spark.createDataFrame([(1, 0, 0, "ins", None, "x", "u", "2024-01-01"), (1, 1, 0, "ins", None, "y", "v", None), (1, 2, 0, "del", None, "z", "u", "2024-01-09")], "pair_id long, block int, piece int, change string, move string, text string, author string, date string").withColumn("date", F.to_timestamp("date"))
    t = F.lit("2024-01-05").cast("timestamp")
    assert sorted(r.text for r in diff.at_time(pieces, t).collect()) == ["x", "z"]
    assert sorted((r.text, r.change) for r in diff.by_author(pieces, "u", "accept").collect()) == [("x", "keep"), ("y", "ins")]
    assert diff.view(pieces, "markup").first().blocks == ["{+x+}", "{+y+}", "{-z-}"]


def test_word_diff_is_minimal_enough():
    got = diff.word_diff("the cat sat", "the dog sat")
    assert got == [("keep", "the "), ("del", "cat"), ("ins", "dog"), ("keep", " sat")]
    assert difflib.SequenceMatcher(None, "a", "a").ratio() == 1


def xs(spark, v):
    return spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "k long, id long, x double")


def test_layout_values(spark):
    g = layout.cluster_1d(xs(spark, [1, 2, 10, 11.5]), 1.5, "k")
    assert [(r.centroid, r["size"]) for r in layout.centroids(g, "k").orderBy("g").collect()] == [(1.5, 2), (10.75, 2)]
    o = layout.otsu(xs(spark, [1, 1, 1, 10, 10]), "k").first()
    assert (o.threshold, o.below, o.above) == (5.5, 3, 2)
    assert [r.mode for r in layout.modes(xs(spark, [1, 1, 1, 2, 5, 5]), 1.0, "k").orderBy("mode").collect()] == [1.5, 5.5]
    rng = np.random.default_rng(3)
    for _ in range(10):
        x = np.sort(rng.normal(size=9))
        best = min(((c1, c2) for c1 in range(1, 8) for c2 in range(c1 + 1, 9)), key=lambda c: sum(((p - p.mean()) ** 2).sum() for p in np.split(x, c)))
        assert layout.jenks(x, 3) == [x[best[0] - 1], x[best[1] - 1], x[-1]]


def boxes(spark, rows):
    return spark.createDataFrame([(p, i, float(a), float(b), float(c), float(d), t, 10.0) for i, (p, a, b, c, d, t) in enumerate(rows)], "page long, ord long, left double, top double, right double, bottom double, text string, font_size double")


def test_layout_pages(spark):
    b = boxes(spark, [(1, 0, 0, 40, 10, "a"), (1, 60, 1, 100, 11, "b"), (1, 0, 30, 40, 40, "c"), (1, 60, 30, 100, 40, "d")])
    assert [(r.line, r.position, r.ord) for r in layout.group_into_lines(b).orderBy("line", "position").collect()] == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)]
    p = layout.projection_profile(b, "x")
    assert p.count() == 100 and p.where("weight = 0").count() == 20
    v = layout.find_valleys(p).first()
    assert (v.start, v.end, v.center) == (40, 60, 50)
    assert [(r.n, r.left, r.right) for r in layout.detect_columns(b).orderBy("n").collect()] == [(1, 0.0, 40.0), (2, 60.0, 100.0)]
    assert [r.region for r in layout.xy_cut(b).orderBy("ord").collect()] == [0, 1, 2, 3]
    h = boxes(spark, [(p, 0, y, 50, y + 5, t) for p in range(1, 5) for y, t in ((0, f"Page {p}" if p < 3 else f"other {chr(96 + p)}"), (50, f"body {p}"), (95, "foot"))])
    # page numbers differ, so they aren't the same text; the foot is
    assert {(r.zone, r.ord) for r in layout.headers_footers(h).collect()} == {("footer", 2), ("footer", 5), ("footer", 8), ("footer", 11)}
    assert layout.headers_footers(h.where("page = 1")).count() == 0
    lines = spark.createDataFrame([(1, i, float(t), float(t + 10)) for i, t in enumerate((0, 12, 24, 60, 72))], "page long, line long, top double, bottom double")
    assert [r.line for r in layout.paragraph_breaks(lines).where("breaks").collect()] == [3]
    for method, want in (("relative", [3]), ("jenks", [3])):
        assert [r.line for r in layout.paragraph_breaks(lines, method).where("breaks").collect()] == want
    even = spark.createDataFrame([(1, i, float(12 * i), float(12 * i + 10)) for i in range(6)], "page long, line long, top double, bottom double")
    assert layout.paragraph_breaks(even).where("breaks").count() == 0
    # most gaps large: no meaningful split for Otsu, one for Jenks
    wide = spark.createDataFrame([(1, i, float(t), float(t + 10)) for i, t in enumerate((0, 12, 40, 68, 96, 124, 152))], "page long, line long, top double, bottom double")
    assert layout.paragraph_breaks(wide).where("breaks").count() == 0
    grid = boxes(spark, [(1, 0, 0, 90, 10, "title"), *[(1, x + d, y, x + 20, y + 10, "c") for y in (20, 40, 60) for x, d in ((0, 0), (40, 1), (80, 0))], (1, 13, 80, 90, 90, "text")])
    assert [tuple(r) for r in layout.table_regions(layout.group_into_lines(grid)).collect()] == [(1, 0.0, 20.0, 100.0, 70.0)]


def test_font_sizes(spark):
    def roles(sizes, **how):
        b = spark.createDataFrame([(1, float(x)) for x in sizes], "doc long, font_size double")
        return {r["size"]: r.role for r in layout.classify_font_sizes(b, "doc", **how).collect()}

    assert roles([10] * 9 + [18]) == {10.0: "body", 18.0: "heading"}
    assert roles([10, 10.3]) == {10.0: "body", 10.3: "body"}
    assert roles([7] * 3 + [10] * 9 + [18, 0]) == {7.0: "footnote", 10.0: "body", 18.0: "heading", 0.0: "body"}
    assert roles([7, 10, 14, 20, 21]) == {7.0: "footnote", 10.0: "body", 14.0: "subheading", 20.0: "heading", 21.0: "heading"}
    assert roles([1, 2, 3, 4, 5], k=5) == {float(i + 1): f"class_{i}" for i in range(5)}


def test_natural_breaks_match_brute_force():
    from itertools import combinations

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(40):
        m, k = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        x, n = np.sort(rng.choice(60, m, replace=False)).astype(float), rng.integers(1, 6, m).astype(float)

        def cost(label):
            return sum(((x[label == c] - np.average(x[label == c], weights=n[label == c])) ** 2 * n[label == c]).sum() for c in set(label))

        got = layout.natural_breaks(x, n, k)
        want = min(cost(np.searchsorted(np.array(c), np.arange(m), "right")) for c in combinations(range(1, m), min(k, m) - 1))
        assert abs(cost(got) - want) < 1e-9 and len(set(got)) == min(k, m)


def test_builder_and_views(spark):
    from tessera.operators import introspect
    from tessera.sources import builder, nodes, serialize

    b = builder.Builder(title="T").heading(1, "A ", builder.bold("b")).paragraph("see", builder.footnote_ref("n1"), " and ", builder.link("http://x", "y")).footnote("n1", "note")
    b.table([["h1", "h|2"], ["a", "1|2"], ["b\nc"]], caption="C").begin("blockquote").paragraph("quoted").end().code_block("x = 1", "py").image("i.png", "alt").thematic_break()
    t = nodes.block_table(builder.documents(spark, {1: b.build()})).orderBy("body_index").collect()
    assert [(r.node_type, r.text) for r in t][:2] == [("heading", "A b"), ("paragraph", "see and y")]
    n = builder.documents(spark, {1: b.build()})
    assert nodes.find_by_type(n, "footnote_ref").count() == 1 and nodes.walk(n).where("ref LIKE '#/footnotes/n1%'").count() == 2
    cells = nodes.table_cells(n)
    assert [tuple(r)[2:] for r in introspect.tables_summary(cells).collect()] == [("C", 3, 2)]
    assert serialize.table_texts(cells).first().text == "| h1  | h\\|2 |\n| --- | ---- |\n| a   | 1\\|2 |\n| b c |      |"
    assert serialize.table_texts(cells, "html").first().text == "<table><tr><th>h1</th><th>h|2</th></tr><tr><td>a</td><td>1|2</td></tr><tr><td>b\nc</td><td></td></tr></table>"
    with pytest.raises(ValueError):
        builder.Builder().heading(7, "x")
    with pytest.raises(ValueError):
        builder.Builder().begin("div").build()
    with pytest.raises(ValueError):
        builder.Builder().end()
    boxes_ = spark.createDataFrame([(1.0, 0.0)], "w double, h double")
    with pytest.raises(Exception, match="positive"):
        boxes_.select(introspect.normalize_box(*[F.lit(1.0)] * 4, F.col("w"), F.col("h"))).collect()


def test_search_errors_and_index(spark, tmp_path):
    from tessera.operators import search

    b = blocks(spark, [(0, 1), (1, None)])
    for bad in ({"query": " "}, {"query": "x", "level": "word"}, {"query": "x", "retrieval": "magic"}, {"query": "x", "retrieval": "hybrid"}):
        with pytest.raises(ValueError):
            search.search_document(b, **bad)
    p = spark.createDataFrame([(1, 0, "red fox"), (1, 1, "the dog"), (2, 0, "red red dog"), (3, 0, "")], "doc_id long, n int, text string")
    c = search.Corpus.build(p, str(tmp_path / "index"))
    got = c.search("RED", 5, preview_length=3).orderBy("row").collect()
    assert [(r.row, r.doc_id, r.text) for r in got] == [(0, 1, "red..."), (2, 2, "red...")]
    want = {(r.doc_id, r.row): r.score for r in search.bm25(p.withColumnRenamed("n", "row"), "red").collect()}
    assert {(r.doc_id, r.n): r.score for r in got} == {k: round(v, 4) for k, v in want.items()}
    assert c.document_of(3) == 3 and c.search("nothing").count() == 0
    with pytest.raises(IndexError):
        c.document_of(4)
    again = search.Corpus(spark, str(tmp_path / "index"))
    assert again.search("dog").count() == 2


def test_perceptual_hashes(spark):
    import numpy as np

    from tessera.operators import dedup

    rng = np.random.default_rng(2)
    image = rng.random((32, 32)).cumsum(axis=0).cumsum(axis=1)
    rows = [(0, image.ravel().tolist()), (1, (image * 1.5 + 3).ravel().tolist()), (2, rng.random(1024).tolist()), (3, None), (4, [1.0])]
    h = {r.i: r.h for r in spark.createDataFrame(rows, "i long, p array<double>").select("i", dedup.dct_hash(F.col("p")).alias("h")).collect()}
    assert h[0] == h[1] and h[3] is None and h[4] is None and bin((h[0] ^ h[2]) & (1 << 64) - 1).count("1") > 10
    # the fourth page isn't compared; two documents share one page of three
    pages = spark.createDataFrame([(1, 0, 0), (1, 1, 1 << 20), (1, 2, 77), (1, 3, -1), (2, 0, 3), (2, 1, -9999999999), (3, 0, -1), (4, 0, None)], "ord long, page int, h long")
    assert {(r.canonical, r.member) for r in dedup.perceptual(pages, 2).collect()} == {(1, 1), (1, 2)}
    assert dedup.perceptual(pages, 2, overlap=3).count() == 0


def test_streams(spark, tmp_path):
    from tessera.streaming import events as S

    d = str(tmp_path)
    rows = [(1, "2024-01-01 00:01:00", "A"), (2, "2024-01-01 00:02:00", "a"), (3, "2024-01-01 00:03:00", "b")]
    spark.createDataFrame(rows, "id int, ts string, text string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{d}/texts.parquet")
    df = spark.readStream.schema("id int, ts timestamp, text string").parquet(f"{d}/texts.parquet")
    assert sorted(r.text.lower() for r in S.drain(S.distinct_text(df)).collect()) == ["a", "b"]


def test_extracted_tables(spark):
    page = "<table><caption>Prices</caption><thead><tr><th>item<th>price</thead><tr><td>a<td>$1,200<tr><td>b<td>3.5<tr><td>c</table><table><tr><td>1<td>2</table>"
    n = nodes.parse(values(spark, [page]).withColumnsRenamed({"i": "doc_id", "v": "html"}), html.parse_html, "doc_id", "html")
    got = {(r.name, r.header): (r.type, list(r["values"])) for r in nodes.tabular(nodes.table_cells(n)).collect()}
    assert got == {("Prices", "item"): ("TEXT", ["a", "b", "c"]), ("Prices", "price"): ("FLOAT", ["1200", "3.5", None]), ("table_2", "col_1"): ("INTEGER", ["1"]), ("table_2", "col_2"): ("INTEGER", ["2"])}


def test_stored_tables(spark, tmp_path, monkeypatch):
    from tessera.sources import store

    df = spark.createDataFrame([(1, None, 2.5), (2, "é", None)], "a int, b string, c double")
    assert store.from_artifact(spark, store.to_artifact(df, "t")).collect() == df.collect()
    assert store.load(spark, store.store(df, f"{tmp_path}/t")).count() == 2 and store.unique_name("A b/c").startswith("A-b-c-")
    monkeypatch.setattr(store, "CAP", 10)
    with pytest.raises(ValueError):
        store.to_artifact(df, "t")
    with pytest.raises(ValueError):
        store.from_artifact(spark, '{"mime": "x"}')


def test_nearest_of_every_vector(spark, monkeypatch, tmp_path):
    from tessera.plans import registry

    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (300, 6)).astype(np.float32)
    v[::9] = v[0] = 1  # ties
    v[5] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for i, a in enumerate(v.astype(float)):
        s = [(-round(float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), 6), j) for j, b in enumerate(v.astype(float)) if a.any() and b.any()]
        want |= {(i, n + 1): (j, -x) for n, (x, j) in enumerate(sorted(s)[:10])}
    want[901, 1] = (901, 1.0)
    for most in (search.SLAB_BYTES, 3000):
        monkeypatch.setattr(search, "SLAB_BYTES", most)
        got = {(r.qid, r.rank): (r.vec_id, r.score) for r in registry.QUERIES["search_vectors_all"](spark, str(tmp_path)).collect()}
        assert got == want
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search.nearest_join(none.selectExpr("vec_id qid", "embedding q"), none, 3).count() == 0


def test_dates_and_numbers_of_all_orders(spark, tmp_path):
    from datetime import date

    from tessera.plans import registry

    prices = [1234.5, 20.0, 100.0, 1000000.0, 7.05, 0.1, 99.99, 12345.67]
    spark.createDataFrame([(i, p, date(2020, 1, i + 1)) for i, p in enumerate(prices)], "o_orderkey long, o_totalprice double, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: (r.day, r.price) for r in registry.QUERIES["normalize_date_number"](spark, str(tmp_path)).collect()}
    assert got == {i: (f"2020-01-0{i + 1}", p) for i, p in enumerate(["1234.5", "20", "100", "1000000", "7.05", "0.1", "99.99", "12345.67"])}


def test_average_linkage_is_the_greedy_one():
    import numpy as np

    from tessera.operators.dedup import average_linkage

    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.normal(size=(rng.integers(1, 25), 5))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        most = float(rng.uniform(0.1, 1.0))
        groups = [[i] for i in range(len(x))]
        far = lambda g, h: np.mean([1 - x[i] @ x[j] for i in g for j in h])
        while len(groups) > 1:
            d, a, b = min((far(g, h), a, b) for a, g in enumerate(groups) for b, h in enumerate(groups) if a < b)
            if d > most:
                break
            groups[a] += groups.pop(b)
        label = average_linkage(x, most)
        assert sorted(sorted(g) for g in groups) == sorted(sorted(np.flatnonzero(np.array(label) == k).tolist()) for k in set(label))


def test_moves_among_many_blocks():
    """300 x 300 blocks that changed sides: every one is a move, none is given up for their number."""
    from tessera.operators.diff import compare_blocks

    words = [f"clause {i} about the matter number {i * 7919 % 1009} in full" for i in range(300)]
    rows = compare_blocks(words[:1] + words[1:], [f"new text {i} without anything alike at all {i}" * 3 for i in range(3)] + words[150:] + words[:150])
    assert sum(c == "move_from" for _, _, c, _, _ in rows) == sum(c == "move_to" for _, _, c, _, _ in rows) == 150
    from difflib import SequenceMatcher

    a, b = ["alpha beta gamma delta", "one two three", ""], ["zzz", "one two threes", "alpha beta gamma deltas", ""]
    got = {m: t for _, _, c, m, t in compare_blocks(["keep me", *a], [*b, "keep me"]) if c == "move_from"}
    assert all(max(SequenceMatcher(None, t, y).ratio() for y in b) >= 0.8 for t in got.values()) and len(got) == 2


def test_bands_find_pairs_at_any_threshold():
    from tessera.operators.dedup import PERMS, bands_for

    for percent in (30, 50, 70, 80, 95):
        bands, rows = bands_for(percent)
        assert bands * rows <= PERMS and 1 - (1 - (percent / 100) ** rows) ** bands >= 0.99


def test_cosine_pairs_over_slabs(spark, monkeypatch):
    import numpy as np

    from tessera.operators import search

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(70, None), (None, x[0].tolist()), (71, [0.0] * 6), (72, [1.0, 2.0])]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.5}
    for most in (search.SLAB_BYTES, 500):
        monkeypatch.setattr(search, "SLAB_BYTES", most)
        got = search.cosine_pairs(spark.createDataFrame(rows, "id long, v array<double>"), 0.5).collect()
        assert {(r.a, r.b) for r in got} == want and all(abs(r.score - s[r.a, r.b]) < 1e-9 for r in got) and len(got) == len(want)


def test_tables_in_the_shared_folder(spark):
    import os

    from tessera import session

    before = session.made()
    a, b = session.materialize(spark.range(5), "a"), session.materialize(spark.range(0), "b")
    paths = session.made(a) | session.made(b)
    assert len(paths) == 2 and session.made() == before | paths and a.count() == 5 and b.count() == 0
    session.release(a, b)
    assert session.made() == before and not any(os.path.exists(p.removeprefix("file:")) for p in paths)
    assert session.made(spark.range(3)) == set()

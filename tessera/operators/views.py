"""Ordered views of a block table (doc_id, body_index, node_type, heading_depth, text, page): pages, sections, paths, windows.

Everything is a window partitioned by document; the parent of a heading is the nearest earlier heading of a smaller depth,
found by six running columns, one a depth, that a later heading of a smaller or equal depth makes void.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import sentences

def _frame(start: int, end: int):  # noqa: ANN202
    return Window.partitionBy("doc_id").orderBy("body_index").rowsBetween(start, end)


def _upto():  # noqa: ANN202
    return _frame(Window.unboundedPreceding, 0)


def _past():  # noqa: ANN202
    return _frame(Window.unboundedPreceding, -1)


def _ahead():  # noqa: ANN202
    """All blocks after this one: a growing frame over the reverse order, which Spark keeps up row by row."""
    return Window.partitionBy("doc_id").orderBy(F.desc("body_index")).rowsBetween(Window.unboundedPreceding, -1)


def pages(blocks: DataFrame) -> DataFrame:
    """Page of every block: its own, else the last one before it, else 1."""
    return blocks.withColumn("page", F.coalesce(F.last("page", ignorenulls=True).over(_upto()), F.lit(1)))


def _heading(d: int) -> Column:
    return F.when((F.col("node_type") == "heading") & (F.col("heading_depth") == d), F.col("body_index"))


def heading_stack(blocks: DataFrame, inclusive: bool = True) -> DataFrame:
    """Adds h1..h6: the headings that a block stands under (root first, null where the level is skipped)."""
    w = _upto() if inclusive else _past()
    got = blocks
    for d in range(1, 7):
        got = got.withColumn(f"__l{d}", F.last(_heading(d), ignorenulls=True).over(w))
    for d in range(1, 7):
        above = F.greatest(*[F.coalesce(F.col(f"__l{k}"), F.lit(-1)) for k in range(1, d)], F.lit(-1)) if d > 1 else F.lit(-1)
        got = got.withColumn(f"h{d}", F.when(F.col(f"__l{d}") > above, F.col(f"__l{d}")))
    return got.drop(*[f"__l{d}" for d in range(1, 7)])


def sections(blocks: DataFrame) -> DataFrame:
    """doc_id, start, depth, title, parent, direct_end (exclusive), end (with subsections): one row a section.

    What stands before the first heading is a section of depth 0; a document without headings is one such section.
    """
    heads = heading_stack(blocks, inclusive=False).where("node_type = 'heading'")
    own = F.col("heading_depth")
    parent = F.greatest(*[F.when(F.lit(d) < own, F.col(f"h{d}")) for d in range(1, 7)])
    last = blocks.groupBy("doc_id").agg((F.max("body_index") + 1).alias("size"), F.min("body_index").alias("first"))
    heads = heads.join(last, "doc_id")
    after = [F.coalesce(F.min(F.when(F.col("heading_depth") <= d, F.col("body_index"))).over(_ahead()), F.col("size")) for d in range(1, 7)]
    end = F.element_at(F.array(*after), own)
    out = heads.select("doc_id", F.col("body_index").alias("start"), own.alias("depth"), F.col("text").alias("title"), parent.alias("parent"), F.coalesce(F.min("body_index").over(_ahead()), F.col("size")).alias("direct_end"), end.alias("end"))
    firsts = heads.groupBy("doc_id").agg(F.min("body_index").alias("h"))
    pre = last.join(firsts, "doc_id", "left").where("h IS NULL OR h > first")
    stop = F.coalesce("h", "size")
    return out.unionByName(pre.select("doc_id", F.col("first").alias("start"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("parent"), stop.alias("direct_end"), stop.alias("end")))


def section_pages(blocks: DataFrame) -> DataFrame:
    """First and last page of every section, its subsections included."""
    # a block is in the sections of the headings above it, six at most: no range join
    got = heading_stack(pages(blocks)).withColumn("first", F.min("body_index").over(Window.partitionBy("doc_id")))
    above = [F.when(F.col(f"h{d}").isNotNull(), F.struct(F.col(f"h{d}").alias("start"), F.lit(d).alias("depth"))) for d in range(1, 7)]
    pre = F.when(F.coalesce(*[F.col(f"h{d}") for d in range(1, 7)]).isNull(), F.struct(F.col("first").alias("start"), F.lit(0).alias("depth")))
    held = got.select("doc_id", "page", F.explode(F.array(pre, *above)).alias("s")).where("s IS NOT NULL")
    return held.groupBy("doc_id", "s.start", "s.depth").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def heading_path(blocks: DataFrame, inclusive: bool = True) -> DataFrame:
    """doc_id, body_index, section_title and path (titles of all headings above, root first) of every block."""
    got = heading_stack(blocks, inclusive)
    for d in range(1, 7):  # the title of the heading a column points at is a running value as well
        got = got.withColumn(f"__t{d}", F.last(F.when((F.col("node_type") == "heading") & (F.col("heading_depth") == d), F.col("text")), ignorenulls=True).over(_upto() if inclusive else _past()))
    path = F.filter(F.array(*[F.when(F.col(f"h{d}").isNotNull(), F.col(f"__t{d}")) for d in range(1, 7)]), lambda x: x.isNotNull())
    return got.select("doc_id", "body_index", F.try_element_at(path, F.lit(-1)).alias("section_title"), path.alias("path"))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """Paragraphs with text, numbered densely, with page and section title."""
    titles = heading_path(blocks).select("doc_id", "body_index", "section_title")
    got = pages(blocks).where((F.col("node_type") == "paragraph") & (F.trim("text") != "")).join(titles, ["doc_id", "body_index"])
    return got.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("body_index")) - 1).alias("n"), "body_index", "page", "section_title", "text")


def sentence_units(blocks: DataFrame) -> DataFrame:
    """Sentences of paragraphs with code point offsets, numbered densely in the document."""
    p = paragraphs(blocks)
    s = p.select("doc_id", "body_index", "page", "section_title", F.posexplode(sentences("text")).alias("k", "s")).select("doc_id", "body_index", "page", "section_title", "k", "s.*")
    return s.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("body_index", "k")) - 1)


def heading_proximate(blocks: DataFrame) -> DataFrame:
    """First paragraph under the body after a heading."""
    since = F.sum(F.when(F.col("node_type") == "heading", 1).otherwise(0)).over(_upto())
    got = blocks.withColumn("g", since).where("node_type = 'paragraph' AND g > 0")
    return got.groupBy("doc_id", "g").agg(F.min("body_index").alias("body_index")).select("doc_id", "body_index")


def context_window(blocks: DataFrame, targets: DataFrame, before: int, after: int, clamp: bool = False) -> DataFrame:
    """Blocks around each (doc_id, target); with clamp the window shrinks to the direct blocks of the target's section."""
    t = targets.withColumn("lo", F.col("target") - before).withColumn("hi", F.col("target") + after)
    if clamp:
        s = sections(blocks).where("depth > 0").select(F.col("doc_id").alias("d"), "start", "direct_end")
        t = t.join(s, (t["doc_id"] == s["d"]) & (t["target"] >= s["start"]) & (t["target"] < s["direct_end"]), "left")
        t = t.select("doc_id", "target", F.greatest("lo", "start").alias("lo"), F.least("hi", F.col("direct_end") - 1).alias("hi"))
    # the places of a window are listed, so that the join is one of equal keys
    places = t.withColumn("lo", F.greatest("lo", F.lit(0))).where("lo <= hi").select("doc_id", "target", "lo", F.explode(F.sequence("lo", "hi")).alias("body_index"))
    return places.join(blocks.select("doc_id", "body_index", "text"), ["doc_id", "body_index"]).select("doc_id", "target", "body_index", (F.col("body_index") - F.col("lo")).alias("position"), "text")


def outline(blocks: DataFrame) -> DataFrame:
    return blocks.where("node_type = 'heading'").select("doc_id", "body_index", F.col("heading_depth").alias("depth"), F.col("text").alias("title"))


#: A line with an ATX mark.
MARKED = r"^#{1,6}\s"


def infer_headings(lines: DataFrame, flat: bool = False) -> DataFrame:
    """Label lines (doc_id, body_index, text) and promote headings: depth by ATX marks, else keywords, else numbering, else 1.

    flat: only capitals and numbering promote, all to depth 1; marks and keywords mean nothing.
    """
    t = F.trim("text")
    atx = F.lit(0) if flat else F.length(F.regexp_extract(t, r"^(#{1,6})\s", 1))
    numeric = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)[.)]?\s+\S", 1)
    level = F.lit(1) if flat else F.size(F.split(numeric, r"\."))
    keyword = F.lit(None).cast("int") if flat else F.when(t.rlike(r"(?i)^(article|part|chapter)\s+([ivxlc]+|\d+)\b"), 1).when(t.rlike(r"(?i)^(section|§)\s*\d+"), 2).when(t.rlike(r"(?i)^(exhibit|schedule|appendix|annex)\s+\w+"), 1)
    short = (F.length(t) <= 80) & (F.length(t) > 0) & ~t.rlike(r"[.;,:]\z")  # $ would also match before a carriage return
    caps = short & t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    label = (
        F.when(t == "", "blank").when(atx > 0, "heading").when(keyword.isNotNull() & short, "heading").when((numeric != "") & short, "numbered_heading").when(caps, "title")
        .when(t.rlike(r"^([-*•]|\([a-z0-9]+\))\s"), "list_item").when(t.rlike(r"^\|.*\|$"), "table_row").otherwise("body")
    )
    head = label.isin("heading", "numbered_heading", "title")
    depth = F.least(F.greatest(F.coalesce(F.when(atx > 0, atx), keyword, F.when(numeric != "", level), F.lit(1)), F.lit(1)), F.lit(6))
    return lines.withColumn("label", label).withColumn("node_type", F.when(head, "heading").otherwise("paragraph")).withColumn("heading_depth", F.when(head, depth)).withColumn("text", F.when(atx > 0, F.regexp_replace(t, r"^#{1,6}\s+", "")).otherwise(F.col("text")))

"""Projections of stored documents and tables: boxes, annotation bodies, tables, notes, sections, pages, transforms, profiles.

Everything is a filter, a join on keys or an aggregate over the node, block or annotation tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tabular import logical_type
from tessera.operators.views import pages, sections

#: Fields of an annotation's body by its type; other types keep their raw JSON.
BODIES = {
    "comment": "text string, author string, resolved boolean",
    "tracked_change": "change string, author string, date string, old_text string, new_text string",
    "redaction": "reason string",
    "defined_term": "term string, definition string",
    "cross_reference": "target string, label string",
    "extracted_cell": "column_id string, value string, confidence double",
    "external_citation": "citation string, url string",
    "entity": "text string, label string, confidence double",
    "sentiment": "label string, score double",
    "classification": "label string, score double",
    "heading_candidate": "depth int, confidence double",
    "boilerplate": "kind string, confidence double",
    "table_row": "row int, cells array<string>",
    "metadata": "key string, value string",
}


def normalize_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A box of page units as left, top, width, height in 0 to 1; pages without a size are an error."""
    bad = F.raise_error(F.format_string("page dimensions must be positive, got %s x %s", width.cast("string"), height.cast("string")))
    ok = (width > 0) & (height > 0)
    parts = {"left": left / width, "top": top / height, "width": (right - left) / width, "height": (bottom - top) / height}
    return F.when(~F.coalesce(ok, F.lit(False)), bad.cast("struct<left:double,top:double,width:double,height:double>")).otherwise(F.struct(*[c.cast("double").alias(k) for k, c in parts.items()]))


def parse_bodies(annotations: DataFrame, kind: str) -> DataFrame:
    """Annotations of one type with `typed`: the body by its schema; a body that doesn't fit gives null fields."""
    got = annotations.where(F.col("type") == kind)
    return got.withColumn("typed", F.from_json("body", BODIES[kind])) if kind in BODIES else got.withColumn("typed", F.col("body"))


def annotations_by_type(annotations: DataFrame, kind: str | None = None) -> DataFrame:
    """ann_id, type, targets in order and body; a row of `annotations` is a target."""
    some = annotations if kind is None else annotations.where(F.col("type") == kind)
    targets = F.array_sort(F.collect_list(F.struct("node_ref", "start", "end")))
    return some.groupBy("doc_id", "ann_id", "type").agg(targets.alias("targets"), F.min("body").alias("body"))


def tables_summary(cells: DataFrame) -> DataFrame:
    """doc_id, table_n, name, rows, cols of extracted cells, see nodes.table_cells."""
    return cells.groupBy("doc_id", "table_n", "name").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def document_summary_text(blocks: DataFrame, titles: DataFrame, most: int = 500) -> DataFrame:
    """Title, number of blocks and the text's beginning, as one text a document."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("body_index", "text")))), lambda x: x["text"]), "\n\n")
    got = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), text.alias("t")).join(titles, "doc_id", "left")
    shown = F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("..."))).otherwise(F.col("t"))
    return got.select("doc_id", F.concat(F.coalesce("title", F.lit("Untitled")), F.lit(" ("), F.col("n"), F.lit(" blocks)\n\n"), shown).alias("summary"))


def resource_views(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """One row a document and view: outline and metadata as JSON texts, keyed by their name."""
    head = F.array_sort(F.collect_list(F.when(F.col("node_type") == "heading", F.struct("body_index", F.col("heading_depth").alias("depth"), "text"))))
    outline = blocks.groupBy("doc_id").agg(F.to_json(F.transform(head, lambda x: F.struct(x["depth"].alias("depth"), x["text"].alias("text")))).alias("payload"))
    metadata = meta.select("doc_id", F.to_json(F.struct(*[c for c in meta.columns if c != "doc_id"])).alias("payload"))
    return outline.select("doc_id", F.lit("outline").alias("view"), "payload").unionByName(metadata.select("doc_id", F.lit("metadata").alias("view"), "payload"))


def extract_section(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks of each section (doc_id, start), its subsections included."""
    s = wanted.join(sections(blocks).select("doc_id", "start", "end"), ["doc_id", "start"])
    places = s.select("doc_id", "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("body_index"))
    return places.join(blocks, ["doc_id", "body_index"])


def extract_page(blocks: DataFrame, page: int) -> DataFrame:
    return pages(blocks).where(F.col("page") == page)


def chunk_places(chunks: DataFrame) -> DataFrame:
    """Blocks of each chunk: doc_id, section, piece, body_index."""
    return chunks.select("doc_id", "section", "piece", F.explode(F.sequence("first_block", "last_block")).alias("body_index"))


def chunk_footnotes(chunks: DataFrame, refs: DataFrame, notes: DataFrame) -> DataFrame:
    """The notes (doc_id, key, text) that a chunk's blocks refer to; refs: doc_id, body_index, key."""
    held = chunk_places(chunks).join(refs, ["doc_id", "body_index"]).select("doc_id", "section", "piece", "key").distinct()
    return held.join(notes, ["doc_id", "key"])


def chunk_annotations(chunks: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations with a target (doc_id, ann_id, body_index) in a chunk, once a chunk."""
    return chunk_places(chunks).join(annotations, ["doc_id", "body_index"]).select("doc_id", "section", "piece", "ann_id").distinct()


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One transform that runs its steps from left to right; none is the identity."""
    return lambda df: reduce(lambda d, f: f(d), steps, df)


def apply(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return compose(*steps)(df)


def table_infos(tables: dict[str, DataFrame]) -> DataFrame:
    """name, row_count, column_count, columns (name and logical type) of each table: the schema and one count."""
    out = None
    for name, df in tables.items():
        columns = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(logical_type(f)).alias("type")) for f in df.schema.fields])
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("name"), "row_count", F.lit(len(df.columns)).alias("column_count"), columns.alias("columns"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no table")
    return out


def table_schema(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, logical_type(f), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ord int, name string, type string, nullable boolean")


def summary_dict(tables: dict[str, DataFrame]) -> DataFrame:
    """table_count, total_rows, total_columns of a tabular document."""
    infos = table_infos(tables)
    return infos.agg(F.count(F.lit(1)).alias("table_count"), F.sum("row_count").alias("total_rows"), F.sum("column_count").alias("total_columns"))

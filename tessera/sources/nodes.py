"""Documents as tables: one row a node of the tree, keyed by its path; Spark has no recursive types.

A parser turns one text into a tree of `Node`; `parse` runs it over batches and emits the flat rows in one pass. Blocks
(`block_table`) are the slice of the tree directly under the body.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "doc_id long, ref string, parent_ref string, path array<int>, ord int, depth int, kind string, node_type string, value string, level int, attrs map<string,string>, classes array<string>, kv map<string,string>, page int, char_start int, char_end int"
INLINE = frozenset("text emphasis strong strikethrough code link image footnote_ref citation math raw_inline line_break soft_break span superscript subscript underline".split())


@dataclass
class Node:
    type: str
    value: str | None = None
    level: int | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)
    kv: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    span: tuple[int, int] | None = None

    def text(self) -> str:
        if self.type == "soft_break":
            return " "
        if self.type == "line_break":
            return "\n"
        return (self.value or "") + "".join(c.text() for c in self.children)


@dataclass
class Tree:
    body: list[Node] = field(default_factory=list)
    footnotes: dict[str, list[Node]] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)


def rows(doc_id: int, tree: Tree) -> Iterator[tuple]:
    n = 0
    roots = [("#/body", [0], tree.body)] + [(f"#/footnotes/{k}", [1, i], v) for i, (k, v) in enumerate(tree.footnotes.items())]
    for name, at, nodes in roots:
        stack = [(c, f"{name}/{i}", None if name == "#/body" else name, [*at, i], 1) for i, c in enumerate(nodes)][::-1]
        while stack:
            node, ref, parent, path, depth = stack.pop()
            a, b = node.span or (None, None)
            yield doc_id, ref, parent, path, n, depth, "inline" if node.type in INLINE else "block", node.type, node.value, node.level, node.attrs, node.classes, node.kv, None, a, b
            n += 1
            stack += [(c, f"{ref}/children/{i}", ref, [*path, i], depth + 1) for i, c in enumerate(node.children)][::-1]


def parse(df: DataFrame, parser: Callable[..., Tree], id_col: str, text_col: str, base_col: str | None = None) -> DataFrame:
    """Node rows of every text; null texts have none. base_col: URL that relative links are joined to."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, base in zip(batch["id"], batch["text"], batch["base"], strict=True):
                if text is not None:
                    out += rows(doc_id, parser(text, base=base) if base_col else parser(text))
                if len(out) > 20_000:
                    yield _frame(out, names)
                    out = []
            yield _frame(out, names)

    base = F.col(base_col) if base_col else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), base.alias("base")).mapInPandas(run, SCHEMA)


def _frame(out: list[tuple], names: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(out, columns=names)
    for c in ("ord", "depth", "level", "page", "char_start", "char_end"):
        df[c] = df[c].astype("Int32")
    return df


def extract_text(nodes: DataFrame, *by: str) -> DataFrame:
    """Leaf values in order, joined per group; breaks are a blank or a line's end."""
    leaf = F.when(F.col("node_type") == "soft_break", " ").when(F.col("node_type") == "line_break", "\n").otherwise(F.col("value"))
    got = F.array_sort(F.collect_list(F.when(leaf.isNotNull(), F.struct("path", leaf.alias("v")))))
    return nodes.groupBy(*by).agg(F.array_join(F.transform(got, lambda x: x["v"]), "").alias("text"))


def block_table(nodes: DataFrame) -> DataFrame:
    """doc_id, body_index, node_type, heading_depth, text, page, attrs of the blocks under the body; items of lists are blocks of their own."""
    body = nodes.where(F.col("path")[0] == 0).withColumn("body_index", F.col("path")[1])
    text = extract_text(body, "doc_id", "body_index")
    return body.where("depth = 1").select("doc_id", "body_index", "node_type", F.col("level").alias("heading_depth"), "page", "attrs", "kv").join(text, ["doc_id", "body_index"])


def content_hash(nodes: DataFrame) -> DataFrame:
    """SHA-256 over types, values and typed attributes in order; ids and provenance have no part in it."""
    one = F.concat_ws("\x1f", F.concat_ws(".", F.col("path").cast("array<string>")), "node_type", F.coalesce("value", F.lit("")), F.coalesce(F.col("level").cast("string"), F.lit("")), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs")))))
    return nodes.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", one.alias("v")))), lambda x: x["v"]), "\x1e"), 256).alias("content_hash"))


def walk(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes in document order (body, then footnotes); kind: block or inline only."""
    got = nodes if kind is None else nodes.where(F.col("kind") == kind)
    return got.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1)


def find_by_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*types))


def find_by_class(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.array_contains("classes", name))


def find_by_kv(nodes: DataFrame, key: str, value: str | None = None) -> DataFrame:
    return nodes.where(F.col("kv")[key].isNotNull() if value is None else F.col("kv")[key] == value)


def find_first(nodes: DataFrame, condition: object) -> DataFrame:
    """The first match of every document."""
    first = nodes.where(condition).groupBy("doc_id").agg(F.min_by(F.struct(*nodes.columns), F.col("ord")).alias("x"))
    return first.select("x.*")


def subtree(nodes: DataFrame, ref: str) -> DataFrame:
    return nodes.where((F.col("ref") == ref) | F.col("ref").startswith(ref + "/"))


def dangling(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Annotation targets that no node has."""
    return annotations.join(nodes.select("doc_id", F.col("ref").alias("node_ref")), ["doc_id", "node_ref"], "left_anti")


def annotations_at(annotations: DataFrame, points: DataFrame) -> DataFrame:
    """Annotations of a node that hold an offset: [start, end), null offsets hold all."""
    inside = (F.coalesce("start", F.lit(0)) <= F.col("offset")) & (F.col("end").isNull() | (F.col("offset") < F.col("end")))
    return annotations.join(points, ["doc_id", "node_ref"]).where(inside)


def table_cells(nodes: DataFrame) -> DataFrame:
    """Cells of top-level tables: doc_id, table_n, name (caption, else table_N), section, row, col, text. Rows count over sections."""
    tables = nodes.where("node_type = 'table' AND depth = 1").select("doc_id", F.col("path")[1].alias("at"), F.col("attrs")["caption"].alias("caption"))
    tables = tables.withColumn("table_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")))
    inside = nodes.where(F.col("path")[0] == 0).withColumn("at", F.col("path")[1])
    sections = inside.where("node_type = 'table_section' AND depth = 2").select("doc_id", "at", F.col("path")[2].alias("s"), F.col("attrs")["section"].alias("section"))
    cells = inside.where("node_type = 'cell' AND depth = 4").select("doc_id", "at", F.col("path")[2].alias("s"), F.col("path")[3].alias("r"), F.col("path")[4].alias("col"))
    text = extract_text(inside.where("depth >= 4").withColumn("s", F.col("path")[2]).withColumn("r", F.col("path")[3]).withColumn("col", F.col("path")[4]), "doc_id", "at", "s", "r", "col")
    row = F.dense_rank().over(Window.partitionBy("doc_id", "at").orderBy("s", "r")) - 1
    got = cells.join(tables, ["doc_id", "at"]).join(sections, ["doc_id", "at", "s"]).join(text, ["doc_id", "at", "s", "r", "col"])
    return got.select("doc_id", "table_n", F.coalesce("caption", F.concat(F.lit("table_"), F.col("table_n"))).alias("name"), "section", row.alias("row"), "col", F.trim("text").alias("text"))


def tabular(cells: DataFrame) -> DataFrame:
    """Columns of extracted tables: doc_id, table_n, name, col, header, type and values in row order; short rows are padded with nulls."""
    from tessera.functions.normalize import coerce_value
    from tessera.operators.tabular import value_type, widen

    heads = cells.where("section = 'head'").groupBy("doc_id", "table_n", "col").agg(F.max_by("text", "row").alias("header"))
    body = cells.where("section <> 'head'")
    grid = body.select("doc_id", "table_n", "name", "row").distinct().join(cells.select("doc_id", "table_n", "col").distinct(), ["doc_id", "table_n"])
    v = coerce_value(F.col("text"))
    full = grid.join(body.select("doc_id", "table_n", "row", "col", v["kind"].alias("kind"), v["value"].alias("value")), ["doc_id", "table_n", "row", "col"], "left")
    got = full.groupBy("doc_id", "table_n", "name", "col").agg(widen(F.collect_set(value_type(F.coalesce("kind", F.lit("null")), F.col("value")))).alias("type"), F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]).alias("values"))
    return got.join(heads, ["doc_id", "table_n", "col"], "left").withColumn("header", F.coalesce(F.nullif("header", F.lit("")), F.concat(F.lit("col_"), F.col("col") + 1)))

"""Tables and documents as text: CSV, TSV, JSON records, Markdown tables, plain text, Markdown and HTML documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.normalize import format_cell
from tessera.functions.text import safe_url


def csv_line(columns: list[tuple[str, str]], sep: str = ",") -> Column:
    """One row as a line; cells are quoted where they hold the separator, a quote or a line's end."""
    cells = []
    for name, kind in columns:
        c = format_cell(F.col(f"`{name}`"), kind)
        cells.append(F.when(c.rlike(f'[{sep}"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    return F.concat_ws(sep, *cells)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.select(*[format_cell(F.col(f"`{n}`"), k).alias(n) for n, k in df.dtypes]).write.csv(path, header=True, sep=sep)


def json_records(df: DataFrame, *order: str) -> DataFrame:
    """All records as one array, for small results; big tables are written with df.write.json."""
    cells = [format_cell(F.col(n), k).alias(n) if k in ("date", "binary") or k.startswith(("timestamp", "interval")) else (F.col(n).cast("string").alias(n) if k.startswith("decimal") else F.col(n)) for n, k in df.dtypes]
    rows = df.select(F.struct(*order).alias("o"), F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("j"))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "j"))), lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def markdown_table(df: DataFrame, *order: str, max_rows: int = 50) -> DataFrame:
    """Padded table of the first rows, and a note on how many were left out."""
    shown = df.orderBy(*order).limit(max_rows)
    cells = [F.replace(F.replace(format_cell(F.col(n), k), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")).alias(f"c{i}") for i, (n, k) in enumerate(df.dtypes)]
    text = shown.select(F.struct(*order).alias("o"), *cells)
    widths = text.agg(*[F.greatest(F.lit(3), F.lit(len(n)), F.max(F.length(f"c{i}"))).alias(f"w{i}") for i, n in enumerate(df.columns)])
    bar = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    k = range(len(df.columns))
    line = bar([F.rpad(F.col(f"c{i}"), F.col(f"w{i}"), F.lit(" ")) for i in k])
    lines = text.crossJoin(widths).groupBy(*[f"w{i}" for i in k]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    top = bar([F.rpad(F.lit(n), F.col(f"w{i}"), F.lit(" ")) for i, n in enumerate(df.columns)])
    rule = bar([F.repeat(F.lit("-"), F.col(f"w{i}")) for i in k])
    total = df.agg(F.count(F.lit(1)).alias("n"))
    note = F.when(F.col("n") > max_rows, F.format_string("\n\n*%d more rows*", F.col("n") - max_rows)).otherwise("")
    return lines.crossJoin(total).select(F.concat(top, F.lit("\n"), rule, F.lit("\n"), F.col("body"), note).alias("markdown"))


def tabular_summary(df: DataFrame, name: str) -> str:
    """Name, size and types, from the schema and one count."""
    from tessera.operators.tabular import logical_type

    return f"{name}: {df.count()} rows x {len(df.columns)} columns\n" + "\n".join(f"- {f.name} ({logical_type(f)})" for f in df.schema.fields)


ESCAPES = r"([\\`*_\[\]<~$])"


def escape_markdown(c: Column) -> Column:
    c = F.regexp_replace(c, ESCAPES, r"\\$1")
    c = F.regexp_replace(c, r"(?m)^(\s*)([#>+-])", r"$1\\$2")
    return F.regexp_replace(c, r"(?m)^(\s*\d+)([.)])", r"$1\\$2")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _fence(text: Column) -> Column:
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def block_markdown() -> Column:
    """Markdown of one block row (node_type, heading_depth, text, attrs)."""
    t, e = F.col("text"), escape_markdown(F.col("text"))
    return (
        F.when(F.col("node_type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("heading_depth")), F.lit(" "), F.replace(e, F.lit("\n"), F.lit(" "))))
        .when(F.col("node_type") == "codeblock", F.concat(_fence(t), F.coalesce(F.col("attrs")["language"], F.lit("")), F.lit("\n"), t, F.lit("\n"), _fence(t)))
        .when(F.col("node_type") == "blockquote", F.concat(F.lit("> "), F.replace(e, F.lit("\n"), F.lit("\n> "))))
        .when(F.col("node_type") == "list_item", F.concat(F.coalesce(F.concat(F.col("attrs")["number"], F.lit(". ")), F.lit("- ")), e))
        .when(F.col("node_type") == "thematic_break", "---").when(F.col("node_type") == "math_block", F.concat(F.lit("$$\n"), t, F.lit("\n$$")))
        .when(F.col("node_type") == "figure", F.concat(F.lit("!["), e, F.lit("]("), safe_url(F.coalesce(F.col("attrs")["src"], F.lit(""))), F.lit(")")))
        .when(F.col("node_type") == "page_break", "").when(F.col("node_type") == "table", t).when(F.col("node_type") == "raw_block", "").otherwise(e)
    )


def block_html() -> Column:
    e = escape_html(F.col("text"))
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(' data-page="'), F.col("page"), F.lit('"'))).otherwise("")
    tag = lambda name, inner=e: F.concat(F.lit(f"<{name}"), page, F.lit(">"), inner, F.lit(f"</{name.split()[0]}>"))
    out = F.when(F.col("node_type") == "thematic_break", "<hr>").when(F.col("node_type") == "raw_block", "")
    for d in range(1, 7):
        out = out.when((F.col("node_type") == "heading") & (F.col("heading_depth") == d), tag(f"h{d}"))
    return out.when(F.col("node_type") == "codeblock", F.concat(F.lit("<pre"), page, F.lit("><code>"), e, F.lit("</code></pre>"))).when(F.col("node_type") == "blockquote", tag("blockquote")).when(F.col("node_type") == "list_item", tag("li")).when(F.col("node_type") == "figure", F.concat(F.lit('<img src="'), escape_html(safe_url(F.coalesce(F.col("attrs")["src"], F.lit("")))), F.lit('" alt="'), e, F.lit('">'))).otherwise(tag("p"))


def table_texts(cells: DataFrame, kind: str = "markdown") -> DataFrame:
    """doc_id, table_n, name, text: each table of extracted cells (nodes.table_cells) as a pipe table or as HTML.

    Markdown: a pipe in a cell is escaped, a line's end is a blank, columns are padded, a table without a head gets an empty
    one, short rows are filled up. HTML: head cells are th, texts are escaped.
    """
    if kind == "markdown":
        cells = cells.withColumn("text", F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " "))
    table = ["doc_id", "table_n", "name"]
    size = cells.groupBy(*table).agg((F.max("col") + 1).alias("cols"), F.max(F.when(F.col("section") == "head", F.col("row"))).alias("top"))
    width = cells.groupBy(*table, "col").agg(F.greatest(F.lit(3), F.max(F.length("text"))).alias("w"))
    widths = width.groupBy(*table).agg(F.map_from_entries(F.collect_list(F.struct("col", "w"))).alias("w"))
    rows = cells.groupBy(*table, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("c"), F.max(F.col("section") == "head").alias("head"))
    got = rows.join(size, table).join(widths, table)
    each = F.sequence(F.lit(0), F.col("cols") - 1)
    if kind == "html":
        cell = lambda i: F.concat(F.when(F.col("head"), "<th>").otherwise("<td>"), escape_html(F.coalesce(F.col("c")[i], F.lit(""))), F.when(F.col("head"), "</th>").otherwise("</td>"))
        line = F.concat(F.lit("<tr>"), F.array_join(F.transform(each, cell), ""), F.lit("</tr>"))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("l")))), lambda x: x["l"]), "")
        return got.groupBy(*table).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("text"))
    bar = lambda f: F.concat(F.lit("| "), F.array_join(F.transform(each, f), " | "), F.lit(" |"))
    line = bar(lambda i: F.rpad(F.coalesce(F.col("c")[i], F.lit("")), F.coalesce(F.col("w")[i], F.lit(3)), F.lit(" ")))
    rule = bar(lambda i: F.repeat(F.lit("-"), F.coalesce(F.col("w")[i], F.lit(3))))
    blank = bar(lambda i: F.repeat(F.lit(" "), F.coalesce(F.col("w")[i], F.lit(3))))
    first = F.coalesce("top", F.lit(-1))
    texts = got.groupBy(*table, "cols", "w", "top").agg(F.array_sort(F.collect_list(F.struct("row", line.alias("l")))).alias("ls"))
    part = lambda cond: F.transform(F.filter("ls", cond), lambda x: x["l"])
    head = F.when(F.col("top").isNull(), F.array(blank)).otherwise(part(lambda x: x["row"] <= first))
    return texts.select(*table, F.array_join(F.concat(head, F.array(rule), part(lambda x: x["row"] > first)), "\n").alias("text"))


def redact(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """Blank out annotated stretches before anything reads the text; a mark without offsets hides its whole block."""
    spans = marks.groupBy("doc_id", "body_index").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("start", F.lit(0)).alias("s"), F.coalesce("end", F.lit(1 << 30)).alias("e")))).alias("spans"))
    hit = F.expr("aggregate(reverse(spans), text, (t, x) -> concat(substring(t, 1, x.s), '[REDACTED]', CASE WHEN x.e < length(t) THEN substring(t, x.e + 1) ELSE '' END))")
    return blocks.join(spans, ["doc_id", "body_index"], "left").withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(hit)).drop("spans")


def document(blocks: DataFrame, kind: str = "text") -> DataFrame:
    """(doc_id, <kind>) of ordered block rows; blocks are joined by a blank line, runs of blank lines are one."""
    part = {"text": F.col("text"), "markdown": block_markdown(), "html": block_html()}[kind]
    sep = "\n" if kind == "html" else "\n\n"
    rows = blocks.select("doc_id", "body_index", part.alias("part")).where("part <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("body_index", "part"))), lambda x: x["part"]), sep)
    end = F.lit("\n" if kind == "markdown" else "")
    return rows.groupBy("doc_id").agg(F.concat(F.regexp_replace(joined, "\n{3,}", "\n\n"), end).alias(kind))


def numbered(df: DataFrame, by: str, *order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)

"""Documents built block by block, for rows that no parser makes: fixtures, generated reports, converted formats.

    tree = Builder(title="Report").heading(1, "Results").paragraph("All is ", bold("well")).table([["a", "b"], ["1", "2"]]).build()
    nodes = documents(spark, {1: tree})

Methods chain; `begin(...)` opens a container (quote, list, list item, figure, div) until `end()`. Inline helpers make the
pieces of a paragraph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.nodes import SCHEMA, Node, Tree, rows


def text(value: str) -> Node:
    return Node("text", value)


def _mark(kind: str):  # noqa: ANN202
    def make(*parts: str | Node) -> Node:
        return Node(kind, children=inline(parts))

    return make


bold, italic, struck = _mark("strong"), _mark("emphasis"), _mark("strikethrough")


def code(value: str) -> Node:
    return Node("code", value)


def math(value: str) -> Node:
    return Node("math", value)


def link(url: str, *parts: str | Node) -> Node:
    return Node("link", attrs={"url": url}, children=inline(parts))


def footnote_ref(key: str) -> Node:
    return Node("footnote_ref", attrs={"key": key})


def inline(parts: tuple[str | Node, ...]) -> list[Node]:
    return [text(p) if isinstance(p, str) else p for p in parts]


class Builder:
    def __init__(self, **meta: str) -> None:
        self.tree = Tree(meta=dict(meta))
        self.open: list[list[Node]] = [self.tree.body]

    def add(self, node: Node) -> Builder:
        self.open[-1].append(node)
        return self

    def heading(self, level: int, *parts: str | Node) -> Builder:
        if not 1 <= level <= 6:
            raise ValueError("a heading's depth is 1 to 6")
        return self.add(Node("heading", level=level, children=inline(parts)))

    def paragraph(self, *parts: str | Node) -> Builder:
        return self.add(Node("paragraph", children=inline(parts)))

    def code_block(self, value: str, language: str | None = None) -> Builder:
        return self.add(Node("codeblock", value, attrs={"language": language} if language else {}))

    def math_block(self, value: str) -> Builder:
        return self.add(Node("math_block", value))

    def thematic_break(self) -> Builder:
        return self.add(Node("thematic_break"))

    def page_break(self) -> Builder:
        return self.add(Node("page_break"))

    def image(self, src: str, alt: str = "") -> Builder:
        return self.add(Node("figure", attrs={"src": src}, children=inline((alt,)) if alt else []))

    def raw(self, value: str, form: str = "html") -> Builder:
        return self.add(Node("raw_block", value, attrs={"format": form}))

    def table(self, cells: list[list[str]], head: int = 1, caption: str | None = None) -> Builder:
        """The first `head` rows are the head."""
        row = lambda r: Node("row", children=[Node("cell", children=inline((c,))) for c in r])
        parts = [("head", cells[:head]), ("body", cells[head:])]
        sections = [Node("table_section", attrs={"section": name}, children=[row(r) for r in some]) for name, some in parts if some]
        return self.add(Node("table", attrs={"caption": caption} if caption else {}, children=sections))

    def begin(self, kind: str, **attrs: str) -> Builder:
        node = Node(kind, attrs=dict(attrs))
        self.add(node)
        self.open.append(node.children)
        return self

    def end(self) -> Builder:
        if len(self.open) == 1:
            raise ValueError("nothing is open")
        self.open.pop()
        return self

    def footnote(self, key: str, *parts: str | Node) -> Builder:
        self.tree.footnotes[key] = [Node("paragraph", children=inline(parts))]
        return self

    def build(self) -> Tree:
        if len(self.open) != 1:
            raise ValueError("a container is still open")
        return self.tree


def documents(spark: SparkSession, trees: dict[int, Tree]) -> DataFrame:
    """Node rows of trees that were built here."""
    return spark.createDataFrame([r for i, t in trees.items() for r in rows(i, t)], SCHEMA)

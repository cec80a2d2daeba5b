"""Markdown to a tree: block scanner and inline scanner for the constructs that documents of this kind use.

Blocks: ATX and setext headings, paragraphs, quotes and [!KIND] admonitions, nested lists with task markers, fenced and
indented code, rules, pipe tables, definition lists, $$ formulas, HTML blocks (kept raw), footnotes, front matter.
Inlines: text, code, breaks, emphasis, strong, strike-through, links, images, footnote references, formulas,
<sup>, <sub>, <u>; other HTML is kept raw.
"""

from __future__ import annotations

import re

from tessera.sources.nodes import Node, Tree

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`\s]*)[^`]*$")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)(.*)$")
_TABLE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_NOTE = re.compile(r"\[\^([^\]]+)\]:[ \t]*(.*)$")
_HTML = re.compile(r" {0,3}</?[a-zA-Z!][^>]*>?")
_ADMONITION = re.compile(r"\[!(\w+)\][ \t]*(.*)$")
_FRONT = {"title": "title", "author": "authors", "authors": "authors", "date": "date", "lang": "language", "language": "language", "type": "document_type"}
_INLINE = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<ticks>`+)|(?P<img>!\[)|(?P<note>\[\^[^\]]+\])|(?P<link>\[)|(?P<strong>\*\*|__)|(?P<strike>~~)|(?P<em>\*|(?<!\w)_)|(?P<math>\$(?=\S))"
    r"|(?P<auto><[a-zA-Z][a-zA-Z0-9+.-]*:[^>\s]*>)|(?P<tag></?[a-zA-Z][^>]*>)|(?P<br>(?: {2,}|\\)\n)|(?P<nl>\n)"
)


def _close(s: str, at: int, open_: str, close: str) -> int:
    depth = 1
    while at < len(s):
        if s[at] == "\\":
            at += 1
        elif s[at] == open_:
            depth += 1
        elif s[at] == close:
            depth -= 1
            if not depth:
                return at
        at += 1
    return -1


def inlines(s: str) -> list[Node]:
    out: list[Node] = []

    def text(t: str) -> None:
        if t:
            if out and out[-1].type == "text":
                out[-1].value += t
            else:
                out.append(Node("text", t))

    at = 0
    while at < len(s):
        m = _INLINE.search(s, at)
        if not m:
            text(s[at:])
            break
        text(s[at : m.start()])
        kind, tok, at = m.lastgroup, m.group(), m.end()
        if kind == "esc":
            text(tok[1])
        elif kind == "ticks":
            end = re.compile(rf"(?<!`){tok}(?!`)").search(s, at)
            if end:
                body = s[at : end.start()].replace("\n", " ")
                out.append(Node("code", body[1:-1] if len(body) > 2 and body[0] == body[-1] == " " and body.strip() else body))
                at = end.end()
            else:
                text(tok)
        elif kind == "note":
            out.append(Node("footnote_ref", attrs={"key": tok[2:-1]}))
        elif kind in ("img", "link"):
            end = _close(s, at, "[", "]")
            dest = re.compile(r"\(\s*(<[^>]*>|[^\s()]*(?:\([^()]*\)[^\s()]*)*)(?:\s+[\"'(](.*?)[\"')])?\s*\)").match(s, end + 1) if end >= 0 else None
            if dest:
                url, inner = dest[1].strip("<>"), s[at:end]
                extra = {"title": dest[2]} if dest[2] else {}
                if kind == "img":
                    out.append(Node("image", attrs={"src": url, "alt": "".join(n.text() for n in inlines(inner))} | extra))
                else:
                    out.append(Node("link", attrs={"url": url} | extra, children=inlines(inner)))
                at = dest.end()
            else:
                text(tok)
        elif kind in ("strong", "strike", "em"):
            end = re.compile(rf"(?<![\s\\]){re.escape(tok)}" + ("" if kind != "em" else rf"(?!{re.escape(tok)})" + (r"(?!\w)" if tok == "_" else ""))).search(s, at)
            while end and kind == "em" and s[end.start() - 1] == tok and end.start() > at:
                end = re.compile(rf"(?<![\s\\]){re.escape(tok)}(?!{re.escape(tok)})").search(s, end.end())
            if end and end.start() > at and not s[at].isspace():
                out.append(Node({"strong": "strong", "strike": "strikethrough", "em": "emphasis"}[kind], children=inlines(s[at : end.start()])))
                at = end.end()
            else:
                text(tok)
        elif kind == "math":
            end = re.compile(r"(?<=\S)\$(?!\d)").search(s, at)
            if end:
                out.append(Node("math", s[at : end.start()]))
                at = end.end()
            else:
                text(tok)
        elif kind == "auto":
            out.append(Node("link", attrs={"url": tok[1:-1]}, children=[Node("text", tok[1:-1])]))
        elif kind == "tag":
            name = re.match(r"<(sup|sub|u)>$", tok)
            end = s.find(f"</{name[1]}>", at) if name else -1
            if end >= 0:
                out.append(Node({"sup": "superscript", "sub": "subscript", "u": "underline"}[name[1]], children=inlines(s[at:end])))
                at = end + len(name[1]) + 3
            else:
                out.append(Node("raw_inline", attrs={"raw": tok}))
        elif kind == "br":
            out.append(Node("line_break"))
        else:
            out.append(Node("soft_break"))
    return out


def _cells(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", line.strip())
    if parts and not parts[0].strip():
        parts = parts[1:]
    if parts and not parts[-1].strip():
        parts = parts[:-1]
    return [p.strip().replace("\\|", "|") for p in parts]


def _dedent(line: str, n: int) -> str:
    lead = len(line) - len(line.lstrip(" "))
    return line[min(lead, n) :]


def blocks(lines: list[str], notes: dict[str, list[Node]]) -> list[Node]:
    out: list[Node] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if m := _FENCE.match(line):
            end = next((k for k in range(i + 1, len(lines)) if re.match(rf" {{0,3}}{m[1][0]}{{{len(m[1])},}}[ \t]*$", lines[k])), len(lines))
            out.append(Node("codeblock", "\n".join(lines[i + 1 : end]), attrs={"language": m[2]} if m[2] else {}))
            i = end + 1
        elif m := _ATX.match(line):
            out.append(Node("heading", level=len(m[1]), children=inlines((m[2] or "").strip())))
            i += 1
        elif _RULE.match(line):
            out.append(Node("thematic_break"))
            i += 1
        elif line.strip().startswith("$$"):
            first = line.strip()[2:]
            if first.rstrip().endswith("$$"):
                out.append(Node("math_block", first.rstrip()[:-2].strip()))
                i += 1
            else:
                end = next((k for k in range(i + 1, len(lines)) if lines[k].rstrip().endswith("$$")), len(lines))
                tail = [lines[end].rstrip()[:-2]] if end < len(lines) else []
                out.append(Node("math_block", "\n".join([first, *lines[i + 1 : end], *tail]).strip()))
                i = end + 1
        elif line.startswith("    ") or line.startswith("\t"):
            j = i
            while j < len(lines) and (not lines[j].strip() or lines[j].startswith(("    ", "\t"))):
                j += 1
            out.append(Node("codeblock", "\n".join(x[4:] if x.startswith("    ") else x[1:] for x in lines[i:j]).rstrip("\n")))
            i = j
        elif m := _NOTE.match(line):
            j = i + 1
            while j < len(lines) and (lines[j].startswith("    ") or (not lines[j].strip() and j + 1 < len(lines) and lines[j + 1].startswith("    "))):
                j += 1
            notes[m[1]] = blocks([m[2], *(_dedent(x, 4) for x in lines[i + 1 : j])], notes)
            i = j
        elif line.lstrip().startswith(">"):
            j = i
            while j < len(lines) and lines[j].strip() and (lines[j].lstrip().startswith(">") or not _starts(lines[j])):
                j += 1
            inner = [re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:j]]
            if a := _ADMONITION.match(inner[0]):
                out.append(Node("admonition", attrs={"kind": a[1].lower()} | ({"title": a[2]} if a[2] else {}), children=blocks(inner[1:], notes)))
            else:
                out.append(Node("blockquote", children=blocks(inner, notes)))
            i = j
        elif _ITEM.match(line):
            node, i = _list(lines, i, notes)
            out.append(node)
        elif i + 1 < len(lines) and "|" in line and _TABLE.match(lines[i + 1]) and len(_cells(lines[i + 1])) == len(_cells(line)):
            marks = [("center" if c.startswith(":") and c.endswith(":") else "right" if c.endswith(":") else "left" if c.startswith(":") else "") for c in _cells(lines[i + 1])]
            j = i + 2
            while j < len(lines) and lines[j].strip() and "|" in lines[j]:
                j += 1

            def row(cells: list[str], marks: list[str] = marks) -> Node:
                cells = (cells + [""] * len(marks))[: len(marks)]
                return Node("row", children=[Node("cell", attrs={"align": a} if a else {}, children=[Node("paragraph", children=inlines(c))] if c else []) for c, a in zip(cells, marks, strict=True)])

            sections = [Node("table_section", attrs={"section": "head"}, children=[row(_cells(line))])]
            if j > i + 2:
                sections.append(Node("table_section", attrs={"section": "body"}, children=[row(_cells(x)) for x in lines[i + 2 : j]]))
            out.append(Node("table", children=sections))
            i = j
        elif _HTML.match(line):
            j = i
            while j < len(lines) and lines[j].strip():
                j += 1
            out.append(Node("raw_block", attrs={"format": "html", "raw": "\n".join(lines[i:j])}))
            i = j
        else:
            j = i + 1
            while j < len(lines) and lines[j].strip() and not _starts(lines[j]) and not re.match(r" {0,3}(=+|-+)[ \t]*$", lines[j]) and not lines[j].startswith(":"):
                j += 1
            body = "\n".join(x.lstrip() for x in lines[i:j])
            if j < len(lines) and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", lines[j])):
                out.append(Node("heading", level=1 if m[1][0] == "=" else 2, children=inlines(body.rstrip())))
                j += 1
            elif j < len(lines) and re.match(r":[ \t]+", lines[j]):
                items = []
                while j < len(lines) and re.match(r":[ \t]+", lines[j]):
                    items.append(Node("definition_item", attrs={"term": body}, children=[Node("paragraph", children=inlines(lines[j][1:].strip()))]))
                    j += 1
                if out and out[-1].type == "definition_list":
                    out[-1].children += items
                else:
                    out.append(Node("definition_list", children=items))
            else:
                out.append(Node("paragraph", children=inlines(body.rstrip())))
            i = j
    return out


def _starts(line: str) -> bool:
    """Whether a line begins a block that may interrupt a paragraph."""
    m = _ITEM.match(line)
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or line.lstrip().startswith((">", "$$")) or (m and m[4] and (not m[2][0].isdigit() or m[2][:-1] == "1")) or _NOTE.match(line))


def _list(lines: list[str], i: int, notes: dict[str, list[Node]]) -> tuple[Node, int]:
    first = _ITEM.match(lines[i])
    ordered = first[2][0].isdigit()
    same = lambda m: m and m[2][0].isdigit() == ordered and m[2][-1] == first[2][-1]
    items: list[Node] = []
    while i < len(lines) and same(m := _ITEM.match(lines[i])) and not _RULE.match(lines[i]):
        indent = len(m[1]) + len(m[2]) + max(1, min(len(m[3]), 4))
        body, j = [m[4]], i + 1
        while j < len(lines):
            x = lines[j]
            if not x.strip():
                if j + 1 < len(lines) and (lines[j + 1].startswith(" " * indent) or not lines[j + 1].strip()):
                    body.append("")
                    j += 1
                    continue
                break
            if len(x) - len(x.lstrip(" ")) >= min(indent, 2 if not ordered else 3) and (x.startswith(" " * min(indent, 2))):
                body.append(_dedent(x, indent))
            elif _starts(x) or _ITEM.match(x) or not body[-1].strip():
                break
            else:
                body.append(x)
            j += 1
        attrs = {}
        if t := re.match(r"\[([ xX])\][ \t]+", body[0]):
            attrs["checked"] = str(t[1] != " ").lower()
            body[0] = body[0][t.end() :]
        items.append(Node("list_item", attrs=attrs, children=blocks(body, notes)))
        i = j
        while i < len(lines) and not lines[i].strip():
            if i + 1 < len(lines) and same(_ITEM.match(lines[i + 1])):
                i += 1
                break
            if i + 1 < len(lines) and not lines[i + 1].strip():
                i += 1
                continue
            return Node("ordered_list" if ordered else "bullet_list", attrs={"start": first[2][:-1]} if ordered else {}, children=items), i
    return Node("ordered_list" if ordered else "bullet_list", attrs={"start": first[2][:-1]} if ordered else {}, children=items), i


def parse_markdown(text: str, base: str | None = None) -> Tree:
    lines = text.replace("\r\n", "\n").replace("\t", "    ").split("\n")
    meta: dict[str, str] = {}
    if lines and lines[0].strip() == "---":
        end = next((k for k in range(1, len(lines)) if lines[k].strip() in ("---", "...")), 0)
        for x in lines[1:end]:
            k, sep, v = x.partition(":")
            if sep and k.strip().lower() in _FRONT and v.strip():
                meta[_FRONT[k.strip().lower()]] = v.strip().strip("\"'")
        lines = lines[end + 1 :] if end else lines
    notes: dict[str, list[Node]] = {}
    return Tree(blocks(lines, notes), notes, meta)

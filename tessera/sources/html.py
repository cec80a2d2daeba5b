"""HTML to a tree, over the standard library's tolerant tokenizer.

Boilerplate elements and classes are dropped, white space collapses outside <pre>, unknown containers give their children,
stray inline content becomes a paragraph, a link to an unsafe place keeps its text, an image from one goes.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

from tessera.sources.nodes import Node, Tree

SKIP = frozenset("script style nav footer header form iframe embed object button svg noscript template".split())
SKIP_CLASSES = frozenset("mw-editsection mw-jump-link mw-cite-backlink sr-only visually-hidden screen-reader-text noprint".split())
VOID = frozenset("area base br col hr img input link meta param source track wbr".split())
MARKS = {"strong": "strong", "b": "strong", "em": "emphasis", "i": "emphasis", "s": "strikethrough", "del": "strikethrough", "strike": "strikethrough", "code": "code", "kbd": "code", "samp": "code", "sub": "subscript", "sup": "superscript", "u": "underline"}
PASS = frozenset("span mark abbr time small font bdi bdo cite q label ins var data wbr big tt".split())
INLINE_TAGS = PASS | set(MARKS) | {"a", "img", "br"}
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table figure hr div section article main aside body html details summary center address figcaption thead tbody tfoot tr td th caption fieldset".split())
_ACTION = re.compile(r"(^|[/?&=])(vote|hide|flag|reply|login|signup|share|fave|save|report)([?&=/]|$)", re.I)
_ORPHAN = frozenset("®©™°†‡§¶*")
_WS = re.compile(r"[ \t\n\r\f]+")


class _Element:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("html", {})
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",)}.get(tag, ())
        walls = ("ul", "ol", "dl", "table", "body", "html", "div")
        if tag in BLOCKS and tag not in ("html", "body"):
            self._close(("p",), (*walls, "td", "th", "li", "blockquote"))
        while closes and self.stack[-1].tag not in walls and any(e.tag in closes for e in self._until(walls)):
            self.stack.pop()
        e = _Element(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].kids.append(e)
        if tag not in VOID:
            self.stack.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.stack[-1].kids.append(_Element(tag, {k: v or "" for k, v in attrs}))

    def _until(self, walls: tuple) -> list:
        out = []
        for e in reversed(self.stack[1:]):
            if e.tag in walls:
                break
            out.append(e)
        return out

    def _close(self, tags: tuple, walls: tuple) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in walls:
                return

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1].kids.append(data)


def unsafe(url: str) -> bool:
    flat = re.sub(r"[\x00-\x20]", "", unquote(url)).lower()
    return flat.startswith(("javascript:", "data:", "vbscript:", "file:"))


def join_url(base: str | None, url: str) -> str:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//|#", url) or not base:
        return url
    if url.startswith("/"):
        p = urlsplit(base)
        return f"{p.scheme}://{p.netloc}{url}"
    return urljoin(base, url)


class _Reader:
    def __init__(self, base: str | None, pre: str) -> None:
        self.base, self.pre, self.title = base, pre, None

    def skipped(self, e: _Element) -> bool:
        return e.tag in SKIP or bool(SKIP_CLASSES & set(e.attrs.get("class", "").split()))

    def inlines(self, kids: list) -> list[Node]:
        out: list[Node] = []
        for k in kids:
            if isinstance(k, str):
                if k:
                    out.append(Node("text", _WS.sub(" ", k)))
            elif self.skipped(k):
                continue
            elif k.tag == "br":
                out.append(Node("line_break"))
            elif k.tag == "img":
                src = k.attrs.get("src", "")
                if src and not unsafe(src):
                    out.append(Node("image", attrs={"src": join_url(self.base, src), "alt": k.attrs.get("alt", "")}))
            elif k.tag == "a":
                href, inner = k.attrs.get("href", ""), self.inlines(k.kids)
                if href and _ACTION.search(href):
                    continue
                if not href or unsafe(href):
                    out.append(Node("span", children=inner))
                else:
                    out.append(Node("link", attrs={"url": join_url(self.base, href)} | ({"title": k.attrs["title"]} if "title" in k.attrs else {}), children=inner))
            elif k.tag == "code" or MARKS.get(k.tag) == "code":
                out.append(Node("code", "".join(n.text() for n in self.inlines(k.kids))))
            elif k.tag in MARKS:
                out.append(Node(MARKS[k.tag], children=self.inlines(k.kids)))
            else:
                out += self.inlines(k.kids)
        return out

    def paragraph(self, inner: list[Node]) -> list[Node]:
        while inner and inner[0].type in ("text", "line_break") and not (inner[0].value or "").strip():
            inner = inner[1:]
        while inner and inner[-1].type in ("text", "line_break") and not (inner[-1].value or "").strip():
            inner = inner[:-1]
        if inner and inner[0].type == "text":
            inner[0].value = inner[0].value.lstrip()
        if inner and inner[-1].type == "text":
            inner[-1].value = inner[-1].value.rstrip()
        if not inner or not ("".join(n.text() for n in inner).strip() or any(n.type == "image" for n in inner)):
            return []
        return [Node("paragraph", children=inner)]

    def has_block(self, e: _Element) -> bool:
        return any(not isinstance(k, str) and (k.tag in BLOCKS or (k.tag not in INLINE_TAGS and self.has_block(k)) or (k.tag in PASS and self.has_block(k))) for k in e.kids)

    def blocks(self, kids: list) -> list[Node]:
        out, loose = [], []

        def flush() -> None:
            nonlocal loose
            out.extend(self.paragraph(self.inlines(loose)))
            loose = []

        for k in kids:
            if isinstance(k, str) or (k.tag in INLINE_TAGS and not self.has_block(k)):
                loose.append(k)
                continue
            flush()
            if not self.skipped(k):
                out += self.block(k)
        flush()
        return merge_orphans(out)

    def block(self, e: _Element) -> list[Node]:
        t = e.tag
        classes = e.attrs.get("class", "").split()
        if t == "title":
            self.title = self.title or _WS.sub(" ", "".join(k for k in e.kids if isinstance(k, str))).strip()
            return []
        if t in ("head", "meta", "link", "base"):
            return [n for k in e.kids if not isinstance(k, str) and k.tag == "title" for n in self.block(k)]
        if re.fullmatch("h[1-6]", t):
            got = self.paragraph(self.inlines(e.kids))
            return [Node("heading", level=int(t[1]), children=g.children) for g in got]
        if t == "p":
            return self.blocks(e.kids) if self.has_block(e) else self.paragraph(self.inlines(e.kids))
        if t in ("ul", "ol"):
            items = [Node("list_item", children=self.blocks(k.kids)) for k in e.kids if not isinstance(k, str) and k.tag == "li" and not self.skipped(k)]
            return [Node("bullet_list" if t == "ul" else "ordered_list", attrs={"start": e.attrs["start"]} if e.attrs.get("start", "").isdigit() else {}, children=items)] if items else []
        if t == "dl":
            items, term = [], None
            for k in (k for k in e.kids if not isinstance(k, str)):
                if k.tag == "dt":
                    term = "".join(n.text() for n in self.inlines(k.kids)).strip()
                elif k.tag == "dd":
                    items.append(Node("definition_item", attrs={"term": term or ""}, children=self.blocks(k.kids)))
            return [Node("definition_list", children=items)] if items else []
        if t == "blockquote":
            inner = self.blocks(e.kids)
            return [Node("blockquote", children=inner)] if inner else []
        if t == "pre":
            raw = "".join(self.raw(e)).strip("\n")
            if self.pre == "prose":
                return [Node("paragraph", children=[Node("text", _WS.sub(" ", p).strip())]) for p in re.split(r"\n\s*\n", raw) if p.strip()]
            marks = " ".join([e.attrs.get("class", "")] + [k.attrs.get("class", "") for k in e.kids if not isinstance(k, str)])
            lang = re.search(r"(?:language|lang|highlight)-([\w+#.-]+)", marks)
            return [Node("codeblock", raw, attrs={"language": lang[1]} if lang else {})]
        if t == "table":
            return [self.table(e)]
        if t == "figure":
            inner = self.blocks([k for k in e.kids if isinstance(k, str) or k.tag != "figcaption"])
            cap = next((k for k in e.kids if not isinstance(k, str) and k.tag == "figcaption"), None)
            return [Node("figure", attrs={"caption": "".join(n.text() for n in self.inlines(cap.kids)).strip()} if cap else {}, children=inner)]
        if t == "hr":
            return [Node("thematic_break")]
        if t == "img":
            return self.paragraph(self.inlines([e]))
        inner = self.blocks(e.kids)
        if t == "div" and classes and len(inner) > 1:
            return [Node("div", classes=classes, children=inner)]
        return inner

    def raw(self, e: _Element) -> list[str]:
        return [x for k in e.kids for x in ([k] if isinstance(k, str) else ["\n"] if k.tag == "br" else self.raw(k))]

    def table(self, e: _Element) -> Node:
        sections: list[Node] = []
        caption = None

        def rows(kids: list, section: str) -> None:
            nonlocal caption
            for k in (k for k in kids if not isinstance(k, str)):
                if k.tag in ("thead", "tbody", "tfoot"):
                    rows(k.kids, k.tag[1:])
                elif k.tag == "caption":
                    caption = "".join(n.text() for n in self.inlines(k.kids)).strip()
                elif k.tag == "tr":
                    cells = [c for c in k.kids if not isinstance(c, str) and c.tag in ("td", "th")]
                    kind = "head" if section == "head" or (section == "" and not sections and cells and all(c.tag == "th" for c in cells)) else section or "body"
                    if not sections or sections[-1].attrs["section"] != kind:
                        sections.append(Node("table_section", attrs={"section": kind}))
                    row = Node("row")
                    for c in cells:
                        spans = {s: str(max(1, int(c.attrs[s]))) for s in ("colspan", "rowspan") if c.attrs.get(s, "").isdigit()}
                        row.children.append(Node("cell", attrs=spans, children=self.blocks(c.kids)))
                    sections[-1].children.append(row)

        rows(e.kids, "")
        return Node("table", attrs={"caption": caption} if caption else {}, children=sections)


def merge_orphans(blocks: list[Node]) -> list[Node]:
    """A paragraph of nothing but a mark like ® joins the paragraph before; the text that follows the mark does as well."""
    out: list[Node] = []
    joined = False
    for b in blocks:
        text = b.text().strip() if b.type == "paragraph" else ""
        if out and out[-1].type == "paragraph" and b.type == "paragraph":
            if 0 < len(text) <= 3 and all(c in _ORPHAN for c in text):
                out[-1].children += b.children
                joined = True
                continue
            if joined and b.children and b.children[0].type == "text" and (b.children[0].value[:1].islower() or b.children[0].value[:1] in " ,.;:"):
                out[-1].children += [Node("text", " "), *b.children]
                joined = False
                continue
        joined = False
        out.append(b)
    return out


def parse_html(text: str, base: str | None = None, pre: str = "code") -> Tree:
    b = _Builder()
    b.feed(text)
    b.close()
    r = _Reader(base, pre)
    body = r.blocks(b.root.kids)
    return Tree(body, meta={"title": r.title} if r.title else {})

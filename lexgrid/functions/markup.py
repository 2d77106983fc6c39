"""HTML and XHTML to Markdown or text.

A document becomes a small tree (void and implied end tags are handled, stray end tags ignored), which is rendered
block by block. Functions work on one text; `markdown_udf` and `text_udf` apply them to columns by Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Scheme of links that lead to another document of the engine.
READ = "corpus-read://read"
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "head", "title", "svg"}
#: A start tag of the key ends open elements of these kinds.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "tr": {"td", "th", "tr"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", "body", "html", "form", "address", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}
SCOPES = {"table", "ul", "ol", "dl"}


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ended = ENDS.get(tag, {"p"} if tag in BLOCKS else set())
        while len(self.open) > 1 and self.open[-1].tag in ended:
            self.open.pop()
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in SCOPES and tag not in SCOPES and tag not in BLOCKS:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Element:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text)


class Writer:
    """link: href to the target that is shown; None drops the link and keeps its text."""

    def __init__(self, link=lambda href: href) -> None:
        self.link = link

    def inline(self, nodes: list) -> str:
        return re.sub(r"[ \t]+", " ", "".join(self.one(n) for n in nodes))

    def one(self, node) -> str:
        if isinstance(node, str):
            return _flat(node)
        tag, inner = node.tag, lambda: self.inline(node.children)
        if tag in DROPPED:
            return ""
        if tag == "br":
            return "  \n"
        if tag == "img":
            alt = node.attributes.get("alt", "").strip()
            return f"![{alt}]({node.attributes['src']})" if node.attributes.get("src") else alt
        if tag == "a":
            text, href = inner().strip(), node.attributes.get("href", "").strip()
            target = self.link(href) if href else None
            return f"[{escape(text)}]({target})" if text and target else text
        if tag in ("b", "strong", "i", "em", "code", "tt", "kbd", "samp"):
            text = inner()
            mark = "**" if tag in ("b", "strong") else "*" if tag in ("i", "em") else "`"
            core = text.strip()
            return f"{text[: len(text) - len(text.lstrip())]}{mark}{core}{mark}{text[len(text.rstrip()) :]}" if core else text
        if tag in ("sup", "sub"):
            return f"<{tag}>{inner()}</{tag}>"
        return inner()

    def blocks(self, nodes: list) -> list[str]:
        out, run = [], []

        def close():
            text = self.inline(run).strip()
            if text:
                out.append(text)
            run.clear()

        for n in nodes:
            if isinstance(n, Element) and n.tag in DROPPED:
                continue
            if isinstance(n, Element) and (n.tag in BLOCKS or any(isinstance(c, Element) and c.tag in BLOCKS for c in n.children)) and n.tag != "a":
                close()
                out += self.block(n)
            else:
                run.append(n)
        close()
        return out

    def block(self, node: Element) -> list[str]:
        tag = node.tag
        if re.fullmatch("h[1-6]", tag):
            text = self.inline(node.children).strip()
            return [f"{'#' * int(tag[1])} {text}"] if text else []
        if tag == "hr":
            return ["---"]
        if tag == "pre":
            return ["```\n" + _text(node, raw=True).strip("\n") + "\n```"]
        if tag == "blockquote":
            return ["\n".join(f"> {line}".rstrip() for line in "\n\n".join(self.blocks(node.children)).split("\n"))]
        if tag in ("ul", "ol"):
            return [self.items(node)]
        if tag == "table":
            return self.table(node)
        return self.blocks(node.children)

    def items(self, node: Element) -> str:
        lines, number = [], 0
        for item in node.children:
            if not isinstance(item, Element):
                continue
            number += 1
            mark = f"{number}. " if node.tag == "ol" else "- "
            inner = [b.replace("\n", "\n  ") for b in self.blocks(item.children)]
            lines.append(mark + "\n  ".join(inner))
        return "\n".join(lines)

    def table(self, node: Element) -> list[str]:
        rows, caption = [], []

        def walk(n: Element):
            for c in n.children:
                if isinstance(c, Element):
                    if c.tag == "tr":
                        rows.append([(x.tag == "th", self.inline(x.children).replace("\n", " ").strip().replace("|", "\\|")) for x in c.children if isinstance(x, Element) and x.tag in ("td", "th")])
                    elif c.tag == "caption":
                        caption.append(self.inline(c.children).strip())
                    else:
                        walk(c)

        walk(node)
        return [f"**{c}**" for c in caption if c] + pipe_table([r for r in rows if r])


def pipe_table(rows: list[list[tuple[bool, str]]]) -> list[str]:
    """Rows of (is header, text) as a pipe table; without a header row, columns are numbered."""
    if not rows:
        return []
    width = max(map(len, rows))
    head = [t for _, t in rows[0]] if any(h for h, _ in rows[0]) else [f"Column {i + 1}" for i in range(width)]
    body = rows[1:] if any(h for h, _ in rows[0]) else rows
    line = lambda cells: "|" + "|".join(f" {c} " if c else " " for c in [*cells, *[""] * (width - len(cells))]) + "|"
    return ["\n".join([line(head), line(["---"] * width), *(line([t for _, t in r]) for r in body)])]


def escape(text: str) -> str:
    return re.sub(r"([\[\]])", r"\\\1", text)


def _text(node, raw: bool = False) -> str:
    if isinstance(node, str):
        return node if raw else _flat(node)
    if node.tag in DROPPED:
        return ""
    inner = "".join(_text(c, raw) for c in node.children)
    return inner if raw else (f" {inner} " if node.tag in BLOCKS or node.tag in ("br", "li", "td", "th", "tr") else inner)


def html_to_text(html: str | None) -> str:
    return _flat(_text(parse(html or ""))).strip()


def html_to_markdown(html: str | None, link=lambda href: href) -> str:
    blocks = Writer(link).blocks(parse(html or "").children)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(blocks)).strip()


def archive_link(path: str, dataset: str, id_of) -> object:
    """Link rewriter of an archive's page: relative targets become read links by id_of(path); others stay."""

    def link(href: str) -> str:
        parts = urlsplit(href)
        if parts.scheme or parts.netloc or not parts.path:
            return href
        target = unquote(urlsplit(urljoin(f"http://x/{path}", parts.path)).path.lstrip("/"))
        return f"{READ}?dataset={dataset}&id={id_of(target)}" + (f"#{parts.fragment}" if parts.fragment else "")

    return link


def legal_link(dataset: str):
    """Links that carry a CELEX number become read links."""

    def link(href: str) -> str:
        found = re.search(r"(?i)celex[:/=]([0-9][0-9A-Za-z()]+)", unquote(href))
        return f"{READ}?dataset={dataset}&id={found[1].upper()}" if found else href

    return link


@pandas_udf(StringType())
def _markdown(html: pd.Series) -> pd.Series:
    return html.map(html_to_markdown)


@pandas_udf(StringType())
def _plain(html: pd.Series) -> pd.Series:
    return html.map(html_to_text)


def markdown_udf(column: str | Column) -> Column:
    return _markdown(F.col(column) if isinstance(column, str) else column)


def text_udf(column: str | Column) -> Column:
    return _plain(F.col(column) if isinstance(column, str) else column)

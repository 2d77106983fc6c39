"""Wikitext to plain text and to Markdown with footnotes.

A scanner turns markup into nodes (text, template, link, external link, reference, table, tag); renderers walk them.
Nesting deeper than `DEEPEST` is kept as text, so no input recurses without end.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from urllib.parse import quote

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lexgrid.functions.markup import escape, pipe_table

DEEPEST = 40
#: Namespaces of media and of categories, options of media links, tags whose content is not prose.
MEDIA = {"file", "image", "media"}
CATEGORIES = {"category"}
MEDIA_OPTION = re.compile(r"(?i)^(thumb|thumbnail|frame|frameless|border|left|right|center|none|baseline|middle|sub|super|top|bottom|upright(=.*)?|\d*x?\d+px|alt=.*|link=.*|page=.*|lang=.*|class=.*)$")
HIDDEN = {"ref", "gallery", "timeline", "score", "templatestyles", "imagemap"}
VERBATIM = {"nowiki", "pre", "code", "syntaxhighlight", "source", "math"}


@dataclass
class Template:
    parts: list[list]


@dataclass
class Link:
    parts: list[list]


@dataclass
class External:
    url: str
    label: list


@dataclass
class Table:
    source: str


@dataclass
class Tag:
    name: str
    attributes: str
    children: list = field(default_factory=list)


_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*?)?)(/?)>")


def closing(source: str, at: int, opening: str, ending: str) -> int:
    """Place after the end that belongs to the opening mark at `at`; -1 without one."""
    depth, i = 0, at
    marks = re.compile(f"{re.escape(opening)}|{re.escape(ending)}")
    for m in marks.finditer(source, i):
        depth += 1 if m[0] == opening else -1
        if depth == 0:
            return m.end()
    return -1


def split_top(source: str, mark: str) -> list[str]:
    """Pieces between marks that stand outside templates, links and tables."""
    out, depth, last = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}|\[\[|\]\]|\{\||\|\}|" + re.escape(mark), source):
        if m[0] in ("{{", "[[", "{|"):
            depth += 1
        elif m[0] in ("}}", "]]", "|}") and (m[0] != mark or depth):
            depth = max(0, depth - 1)
        elif m[0] == mark and not depth:
            out.append(source[last : m.start()])
            last = m.end()
    return [*out, source[last:]]


def scan(source: str, depth: int = 0) -> list:
    """Nodes of a source without comments."""
    if depth > DEEPEST:
        return [source]
    out: list = []
    i, plain = 0, 0
    start = re.compile(r"\{\{|\{\||\[\[|\[(?=https?://|//|mailto:)|<")

    def text(to: int) -> None:
        if to > plain:
            out.append(source[plain:to])

    while m := start.search(source, i):
        at, node, end = m.start(), None, -1
        if m[0] == "{{" and (end := closing(source, at, "{{", "}}")) > 0:
            node = Template([scan(p, depth + 1) for p in split_top(source[at + 2 : end - 2], "|")])
        elif m[0] == "{|" and (end := closing(source, at, "{|", "|}")) > 0:
            node = Table(source[at + 2 : end - 2])
        elif m[0] == "[[" and (end := closing(source, at, "[[", "]]")) > 0:
            node = Link([scan(p, depth + 1) for p in split_top(source[at + 2 : end - 2], "|")])
        elif m[0] == "[" and (end := source.find("]", at) + 1) > 0:
            url, _, label = source[at + 1 : end - 1].partition(" ")
            node = External(url, scan(label.strip(), depth + 1))
        elif m[0] == "<" and (t := _TAG.match(source, at)) and not t[1]:
            name = t[2].lower()
            if t[4] or name in ("br", "hr", "wbr"):
                node, end = Tag(name, t[3]), t.end()
            elif found := re.compile(rf"</{name}\s*>", re.I).search(source, t.end()):
                inner = source[t.end() : found.start()]
                node, end = Tag(name, t[3], [inner] if name in VERBATIM else scan(inner, depth + 1)), found.end()
            else:
                node, end = Tag(name, t[3]), t.end()
        elif m[0] == "<" and (t := _TAG.match(source, at)):
            node, end = Tag("/" + t[2].lower(), ""), t.end()
        if node is None:
            i = at + len(m[0])
            continue
        text(at)
        out.append(node)
        i = plain = end
    text(len(source))
    return out


def without_comments(source: str) -> str:
    return re.sub(r"<!--.*?(?:-->|\Z)", "", source, flags=re.S)


def namespace(target: str) -> str:
    return target.strip().lstrip(":").partition(":")[0].strip().lower() if ":" in target.lstrip(":") else ""


# plain text


def _plain(nodes: list) -> str:
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append(n)
        elif isinstance(n, (Template, Table)):
            out.append(" ")
        elif isinstance(n, Link):
            target = _plain(n.parts[0])
            if namespace(target) not in MEDIA | CATEGORIES:
                out.append(_plain(n.parts[-1]) if len(n.parts) > 1 else target.lstrip(":"))
        elif isinstance(n, External):
            out.append(_plain(n.label))
        elif n.name in HIDDEN:
            out.append(" ")
        else:
            out.append(" " + _plain(n.children) + " " if n.name in ("br", "hr", "p", "div", "li", "td", "tr", "th") else _plain(n.children))
    return "".join(out)


def plain_text(source: str | None) -> str:
    text = _plain(scan(without_comments(source or "")))
    text = re.sub(r"'{2,5}", "", text)
    text = re.sub(r"__[A-Z]+__", " ", text)
    text = re.sub(r"(?m)^\s*=+\s*(.*?)\s*=+(?=\s|$)", r"\1", text)
    text = re.sub(r"(?m)^[*#:;]+\s*", "", text)
    return re.sub(r"\s+", " ", html.unescape(text)).strip()


# Markdown


class Renderer:
    def __init__(self, base: str) -> None:
        self.base, self.notes, self.named = base.rstrip("/"), [], {}

    def url(self, target: str) -> str:
        title, _, fragment = target.strip().lstrip(":").partition("#")
        path = quote(title.strip().replace(" ", "_"), safe="/:@!$&'()*+,;=-._~") if title else ""
        return f"{self.base}/wiki/{path}" + (f"#{quote(fragment.strip().replace(' ', '_'))}" if fragment else "")

    def note(self, tag: Tag) -> str:
        name = re.search(r"""name\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s/>]+))""", tag.attributes)
        key = next((x for x in name.groups() if x), "") if name else ""
        content = self.inline(tag.children).strip()
        if key and key in self.named:
            number = self.named[key]
            if content and not self.notes[number - 1][1]:
                self.notes[number - 1] = (key, content)
        else:
            self.notes.append((key, content))
            number = len(self.notes)
            if key:
                self.named[key] = number
        return f"[^{number}]"

    def parameters(self, template: Template) -> tuple[str, list[str], dict[str, str]]:
        name = re.sub(r"\s+", " ", _plain(template.parts[0])).strip().replace("_", " ")
        positional, named = [], {}
        for part in template.parts[1:]:
            head = part[0] if part and isinstance(part[0], str) else ""
            key, mark, rest = head.partition("=")
            if mark and re.fullmatch(r"\s*[\w .\-]+\s*", key):
                named[key.strip().lower()] = self.inline([rest, *part[1:]]).strip()
            else:
                positional.append(self.inline(part).strip())
        return name, positional, {k: v for k, v in named.items() if v}

    def template(self, t: Template) -> str:
        name, args, named = self.parameters(t)
        low = name.lower()
        first = args[0] if args else ""
        if low in ("reflist", "references", "notelist", "short description", "use dmy dates", "use mdy dates", "pp", "clear", "toc", "authority control", "defaultsort") or low.startswith(("pp-", "use ", "defaultsort:", "#")):
            return f"*{first}*\n\n" if low == "short description" and first else ""
        if low.startswith(("cite ", "citation")):
            return self.citation(named)
        if low.startswith("infobox"):
            rows = [[(True, name), (True, "")], *([(False, k), (False, v.replace("\n", " "))] for k, v in named.items())]
            return "\n\n" + pipe_table(rows)[0] + "\n\n"
        if low in ("efn", "refn", "notetag"):
            self.notes.append(("", first))
            return f"[^{len(self.notes)}]"
        if low in ("sfn", "harvnb", "harv"):
            return f"({' '.join(args)})" if args else ""
        if low in ("main", "see also", "further", "about"):
            return f"*{'Main article' if low == 'main' else 'See also'}: " + ", ".join(f"[{a}]({self.url(a)})" for a in args) + "*\n\n"
        if low in ("url", "official website"):
            return f"[{args[1] if len(args) > 1 else first}]({first})" if first else ""
        if low in ("convert", "cvt"):
            return " ".join(args[:2])
        if low in ("lang", "transl", "transliteration"):
            return args[-1] if args else ""
        if low.startswith(("lang-", "ipa", "nowrap", "nobr", "small", "big", "abbr", "center", "flag", "icon", "nihongo", "as of", "circa", "c.")):
            return f"c. {first}" if low in ("circa", "c.") else f"As of {' '.join(args)}" if low == "as of" else first
        if low in ("spaced ndash", "snd", "ndash", "mdash", "dash"):
            return " – "
        if low in ("birth date", "birth date and age", "death date", "death date and age", "start date", "end date", "date"):
            return "-".join(a.zfill(2) for a in args[:3] if a.isdigit())
        if low in ("quote", "blockquote", "cquote"):
            return f"\n\n> {named.get('text', first)}\n\n"
        values = args + [f"{k}: {v}" for k, v in named.items()]
        return f"**{name}:** " + "; ".join(v for v in values if v) if any(values) else ""

    def citation(self, p: dict[str, str]) -> str:
        author = p.get("author") or ", ".join(x for x in (p.get("last") or p.get("last1"), p.get("first") or p.get("first1")) if x)
        title = p.get("title", "")
        shown = f"[{escape(title)}]({p['url']})" if title and p.get("url") else title or p.get("url", "")
        rest = [p.get(k) for k in ("website", "work", "journal", "newspaper", "publisher", "date", "year") if p.get(k)]
        return ". ".join(x for x in (author, shown, *rest) if x)

    def link(self, n: Link) -> str:
        target = _plain(n.parts[0]).strip()
        space = namespace(target)
        if space in MEDIA and not target.startswith(":"):
            caption = next((c for p in reversed(n.parts[1:]) if (c := _plain(p).strip()) and not MEDIA_OPTION.match(c)), target.partition(":")[2])
            return f"[Image: {escape(caption)}]({self.url(target)})"
        if space in CATEGORIES and not target.startswith(":"):
            return ""
        label = self.inline(n.parts[-1]).strip() if len(n.parts) > 1 else target.lstrip(":")
        return f"[{escape(label or target)}]({self.url(target)})"

    def inline(self, nodes: list) -> str:
        out = []
        for n in nodes:
            if isinstance(n, str):
                text = re.sub(r"'''''(.*?)'''''", r"***\1***", n)
                text = re.sub(r"'''(.*?)'''", r"**\1**", text)
                out.append(html.unescape(re.sub(r"''(.*?)''", r"*\1*", text)))
            elif isinstance(n, Template):
                out.append(self.template(n))
            elif isinstance(n, Link):
                out.append(self.link(n))
            elif isinstance(n, External):
                label = self.inline(n.label).strip()
                out.append(f"[{escape(label)}]({n.url})" if label else f"<{n.url}>")
            elif isinstance(n, Table):
                out.append("\n\n" + "\n\n".join(self.table(n.source)) + "\n\n")
            elif n.name == "ref":
                out.append(self.note(n))
            elif n.name == "br":
                out.append("  \n")
            elif n.name in ("pre", "syntaxhighlight", "source"):
                out.append("\n\n```\n" + "".join(n.children).strip("\n") + "\n```\n\n")
            elif n.name in ("code", "math"):
                out.append(f"`{''.join(n.children)}`" if n.name == "code" else f"${''.join(n.children)}$")
            elif n.name in ("b", "strong", "i", "em"):
                mark = "**" if n.name in ("b", "strong") else "*"
                out.append(f"{mark}{self.inline(n.children).strip()}{mark}")
            elif n.name in HIDDEN or n.name.startswith("/"):
                continue
            else:
                out.append(self.inline(n.children))
        return "".join(out)

    def table(self, source: str) -> list[str]:
        caption, rows, row = "", [], []
        lines: list[str] = []
        for line in source.split("\n")[1:]:
            if re.match(r"\s*[|!]", line) or not lines:
                lines.append(line.strip())
            else:
                lines[-1] += "\n" + line
        for line in lines:
            if line.startswith("|+"):
                caption = self.inline(scan(self.value(line[2:]))).strip()
            elif line.startswith("|-"):
                rows, row = [*rows, row] if row else rows, []
            elif line.startswith(("|", "!")):
                head = line[0] == "!"
                cells = [c for p in split_top(line[1:], "||") for c in (split_top(p, "!!") if head else [p])]
                row += [(head, self.inline(scan(self.value(c))).strip().replace("\n", " ").replace("|", "\\|")) for c in cells]
        rows = [*rows, row] if row else rows
        rows = [[(h, f"**{t}**" if h and t else t) for h, t in r] for r in rows]
        return [f"**{caption}**"] * bool(caption) + pipe_table(rows)

    @staticmethod
    def value(cell: str) -> str:
        """A cell without its attributes."""
        parts = split_top(cell, "|")
        return "|".join(parts[1:]) if len(parts) > 1 and "=" in parts[0] and "[[" not in parts[0] else cell

    def blocks(self, text: str) -> str:
        out = []
        for line in text.split("\n"):
            if m := re.fullmatch(r"\s*(={1,6})\s*(.*?)\s*\1\s*", line):
                out += ["", "#" * max(2, len(m[1])) + " " + m[2], ""]
            elif m := re.match(r"([*#;:]+)\s*(.*)", line):
                marks, rest = m[1], m[2]
                lead = "  " * (len(marks) - 1)
                out.append({"*": f"{lead}- {rest}", "#": f"{lead}1. {rest}", ";": f"**{rest}**", ":": f"{lead}> {rest}" if rest else ""}[marks[-1]])
            elif re.fullmatch(r"-{4,}\s*", line):
                out += ["", "---", ""]
            else:
                out.append(re.sub(r"__[A-Z]+__", "", line))
        return "\n".join(out)

    def document(self, source: str) -> str:
        text = self.inline(scan(self.blocks_first(without_comments(source))))
        text = re.sub(r"[ \t]+\n", "\n", text)
        return re.sub(r"\n{3,}", "\n\n", text).strip()

    def blocks_first(self, source: str) -> str:
        """Line markup is rewritten outside templates and tables, whose lines have their own meaning."""
        out, at = [], 0
        for m in re.finditer(r"\{\||\{\{|<(?:pre|syntaxhighlight|source|nowiki)\b", source):
            if m.start() < at:
                continue
            mark = m[0]
            end = closing(source, m.start(), "{|", "|}") if mark == "{|" else closing(source, m.start(), "{{", "}}") if mark == "{{" else (source.find("</", m.end()) if "</" in source[m.end() :] else -1)
            if end < 0:
                continue
            out += [self.blocks(source[at : m.start()]), source[m.start() : end]]
            at = end
        return "".join([*out, self.blocks(source[at:])])


def render(source: str | None, base: str) -> tuple[str, list[dict]]:
    """(Markdown without the footnotes, footnotes as id, name, content)."""
    r = Renderer(base)
    text = r.document(source or "")
    return text, [{"id": i, "name": n, "content": c} for i, (n, c) in enumerate(r.notes, 1)]


def markdown(source: str | None, base: str) -> str:
    text, notes = render(source, base)
    return "\n\n".join([text, *(["\n".join(f"[^{n['id']}]: {n['content']}" for n in notes)] if notes else [])])


def referenced(excerpt: str, notes: list[dict]) -> list[dict]:
    """The footnotes whose marks stand in an excerpt."""
    return [n for n in notes if f"[^{n['id']}]" in excerpt]


@pandas_udf(StringType())
def plain_text_udf(source: pd.Series) -> pd.Series:
    return source.map(plain_text)


@pandas_udf(StringType())
def markdown_udf(source: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([markdown(s, b) for s, b in zip(source, base, strict=True)])
